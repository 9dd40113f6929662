"""Incremental maintenance of the point table: what changed, purge, upsert, migration, batches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """files (relative_path, branch, file_hash, ...) whose hash isn't stored for their path and branch."""
    return files.join(state.select("relative_path", "branch", "file_hash"), ["relative_path", "branch", "file_hash"], "left_anti")


def purge(points: DataFrame, files: DataFrame) -> DataFrame:
    """points without those of the given (relative_path, branch)."""
    return points.join(files.select("relative_path", "branch"), ["relative_path", "branch"], "left_anti")


def deleted_files(state: DataFrame, files: DataFrame) -> DataFrame:
    """Stored (relative_path, branch) that are no longer there."""
    return state.select("relative_path", "branch").distinct().join(files.select("relative_path", "branch"), ["relative_path", "branch"], "left_anti")


def upsert(points: DataFrame, new: DataFrame) -> DataFrame:
    """points with new rows put in by (branch, point_id); of several the latest update stays, and new ones win ties."""
    both = points.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("branch", "point_id").orderBy(F.desc("updated"), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def migrate_branch(points: DataFrame, branch: str, default: str) -> DataFrame:
    """Points of no branch get one, and the default branch."""
    none = F.coalesce(F.col("branch"), F.lit("")) == ""
    return points.withColumns({"default_branch": F.when(none, F.lit(default)).otherwise(F.col("default_branch")), "branch": F.when(none, F.lit(branch)).otherwise(F.col("branch"))})


#: Ranges of the order column in which rows are numbered.
RANGES = 64


def write_batches(points: DataFrame, size: int, order: str, ranges: int = RANGES) -> DataFrame:
    """Rows numbered into batches of `size` within each branch, in the order of a number column; ties as they come.

    Rows are numbered within ranges of that column, whose bounds are quantiles, and each range begins where the counts of those
    before it end. So a branch is many tasks.
    """
    cuts = points.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 1000)).first()[0] or []
    own = points.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda b: b < F.col(order))) if cuts else F.lit(0))
    w = Window.partitionBy("branch").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy("branch", "__range").agg(F.count("*").alias("__n")).select("branch", "__range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    numbered = own.withColumn("__i", F.row_number().over(Window.partitionBy("branch", "__range").orderBy(order)))
    out = numbered.join(before, ["branch", "__range"])
    return out.withColumn("batch", F.ceil((F.col("__before") + F.col("__i")) / F.lit(size)).cast("bigint")).drop("__range", "__before", "__i")


class PointTable:
    """Points and their posting blocks by branch and bucket, of which each has a version; a manifest names the versions that count.

    A commit writes new versions of some buckets beside the old ones and then puts the next manifest in place by one rename, so
    readers see all of a commit or none of it, and one that is broken off leaves nothing that counts. What a commit replaces is
    deleted behind it; a reader that has begun before may have to begin again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> int:
        pattern, fs = self._fs(f"{self.path}/manifest-*.json")
        found = fs.globStatus(pattern) or []
        return max((int(x.getPath().getName()[len("manifest-") : -len(".json")]) for x in found), default=0)

    def versions(self) -> dict[tuple[str, int], str]:
        """The version of each (branch, bucket)."""
        n = self._latest()
        if not n:
            return {}
        text = self.spark.read.text(f"{self.path}/manifest-{n}.json", wholetext=True).first()[0]
        return {(b, k): v for b, k, v in json.loads(text)}

    def read(self, schema: str, what: str = "points", branch: str | None = None) -> DataFrame | None:
        """The current rows (schema without bucket and version); None before the first commit."""
        if not self._latest():
            return None
        own = [(b, k, v) for (b, k), v in self.versions().items() if branch is None or b == branch]
        names = [f.name for f in self.spark.createDataFrame([], schema).schema]
        if not own:
            return self.spark.createDataFrame([], schema)
        at = [f"{self.path}/{what}/branch={escaped(b)}/bucket={k}/version={v}" for b, k, v in own]
        return self.spark.read.schema(f"{schema}, bucket int, version string").option("basePath", f"{self.path}/{what}").parquet(*at).select(*names)

    def commit(self, touched: list[tuple[str, int]], rows_per_file: int = 1_000_000, **tables: DataFrame) -> None:
        """Puts rows (with branch and bucket) in place of all that the touched (branch, bucket) hold; those without rows go."""
        version, old, kept = uuid.uuid4().hex, self.versions(), set()
        for what, rows in tables.items():
            dealt = rows.withColumn("version", F.lit(version)).repartition("branch", "bucket")
            dealt.write.partitionBy("branch", "bucket", "version").option("maxRecordsPerFile", rows_per_file).mode("append").parquet(f"{self.path}/{what}")
        kept = {(r["branch"], r["bucket"]) for r in tables["points"].select("branch", "bucket").distinct().collect()}  # buckets are few
        now = {key: v for key, v in old.items() if key not in touched} | {key: version for key in kept}
        self._publish(now)
        for key in touched:
            if old.get(key) and now.get(key) != old[key]:
                for what in tables:
                    p, fs = self._fs(f"{self.path}/{what}/branch={escaped(key[0])}/bucket={key[1]}/version={old[key]}")
                    fs.delete(p, True)

    def _publish(self, now: dict[tuple[str, int], str]) -> None:
        n = self._latest()
        part, fs = self._fs(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps([[b, k, v] for (b, k), v in sorted(now.items())]).encode()))
        out.close()
        to, _ = self._fs(f"{self.path}/manifest-{n + 1}.json")
        if fs.exists(to) or not fs.rename(part, to):
            raise RuntimeError("another commit came first")
        if n > 1:
            fs.delete(self._fs(f"{self.path}/manifest-{n - 1}.json")[0], False)


def escaped(branch: str) -> str:
    """A branch as Spark writes it in the name of a partition."""
    return "".join(f"%{ord(c):02X}" if c in "/\\:*?\"<>|%#='{}[]^" else c for c in branch)
