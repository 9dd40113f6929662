"""A Merkle manifest of a dataset: leaves, subtrees by key, one root, and proofs.

Leaves of a key stand in order; while several nodes remain, every `fanout` consecutive ones (the last run may be shorter)
become their hash. The roots of all keys, in the keys' order, are the leaves of one more tree like that, which gives the root.

Rows are dealt out by ranges of (key, order), so a large key is many partitions. Counts by partition give every row its
index. A task walks its rows with a stack, a mountain range of at most fanout - 1 nodes a level: a run that is full, or that
the key's count says is the last, carries its hash to the next level and is on record. Runs that the task's rows cover only in
part, at either edge, go on as open nodes; these meet by their run, level by level, in short exchanges of at most
2 x (fanout - 1) rows a level and task. No level is padded. Proofs go down from the root: each run of nodes meets the path of
its parent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, released, stored

FANOUT = 8

_NODES = "key string, n bigint, level int, idx bigint, digest string, open boolean"


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as it goes into a leaf: `-` for null, else its length in bytes, a colon and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def indexed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (key string, never null, ...) with idx, their place in their key by `order`, and n, the key's rows."""
    spark, names = rows.sparkSession, rows.columns
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def place(batches):
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, at, begin = pc.run_end_encode(b.column("key")), [], 0
            for key, end in zip(keys.values.to_pylist(), keys.run_ends.to_pylist()):
                held = held if key == last else 0
                at.append(np.arange(held, held + end - begin))
                last, held, begin = key, held + end - begin, end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(np.concatenate(at))], [*names, "part", "pos"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = stored(rows.repartitionByRange(tasks, "key", *order).sortWithinPartitions("key", *order).mapInArrow(lean(place), f"{schema}, part bigint, pos bigint"), "ranged")
    counts = ranged.groupBy("key", "part").agg(F.count("*").alias("c"))  # a row for each key and task
    w = Window.partitionBy("key")
    before = F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(counts.select("key", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(w).alias("n")), "offsets")
    return ranged.join(offsets, ["key", "part"]).select(*names, (F.col("pos") + F.col("before")).alias("idx"), "n")


class Range:
    """The mountain range over consecutive leaves of one key: its stack, and what it puts on record."""

    def __init__(self, key: str, n: int, fanout: int, emit):
        self.key, self.n, self.fanout, self.emit, self.stack = key, n, fanout, emit, []

    def add(self, level: int, idx: int, node: str) -> None:
        count = -(-self.n // self.fanout**level)
        if count == 1:
            return
        if level == len(self.stack):
            self.stack.append([])
        held = self.stack[level]
        held.append((idx, node))
        if (idx + 1) % self.fanout == 0 or idx + 1 == count:
            self.stack[level] = []
            if held[0][0] % self.fanout:  # it begins in another task
                self._open(level, held)
            else:
                up = digest(*(h for _, h in held))
                self.emit((self.key, self.n, level + 1, idx // self.fanout, up, False))
                self.add(level + 1, idx // self.fanout, up)

    def _open(self, level: int, held: list) -> None:
        for idx, node in held:
            self.emit((self.key, self.n, level, idx, node, True))

    def close(self) -> None:
        for level, held in enumerate(self.stack):
            self._open(level, held)


def nodes(placed: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(key, n, level, idx, digest) of all nodes above the leaves, of placed rows (key, idx, n, digest)."""
    names = [x.split()[0] for x in _NODES.split(", ")]

    def walk(batches):
        out: list[tuple] = []
        now, nxt = None, None

        def batch():
            rows = list(zip(*out)) or [[]] * len(names)
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

        for b in batches:
            for key, idx, n, node in zip(*(b.column(c).to_pylist() for c in ("key", "idx", "n", "digest"))):
                if now is None or (key, idx) != nxt:
                    if now:
                        now.close()
                    now = Range(key, n, fanout, out.append)
                now.add(0, idx, node)
                nxt = (key, idx + 1)
            yield batch()
        if now:
            now.close()
        yield batch()

    found = stored(placed.select("key", "idx", "n", "digest").sortWithinPartitions("key", "idx").mapInArrow(lean(walk), _NODES), "peaks")
    waiting = {r["level"]: r["n"] for r in found.where("open").groupBy("level").agg(F.max("n").alias("n")).collect()}
    done, last, level, most = [found.where("not open").drop("open")], None, 0, max(waiting.values(), default=0)
    while fanout**level < most:
        if last is not None or level in waiting:
            work = found.where(f"open and level = {level}").drop("open")
            work = work if last is None else work.unionByName(last.where(f"n > {fanout ** level}L"))
            run = F.array_sort(F.collect_list(F.struct("idx", "digest")))  # of one parent: fanout at most
            up = work.groupBy("key", "n", F.floor(F.col("idx") / fanout).alias("up")).agg(run.alias("run"))
            up = up.select("key", "n", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), F.sha2(F.array_join(F.col("run.digest"), ""), 256).alias("digest"))
            last = stored(up, "merged")
            done.append(last)
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def tops(placed: DataFrame, nodes_: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(key, n, level, digest): the root of each key; a lone leaf is its own."""
    alone = placed.where("n = 1").select("key", "n", F.lit(0).alias("level"), "digest")
    return alone.unionByName(nodes_.where(f"power({fanout}D, level) >= n").select("key", "n", "level", "digest"))


def _below(runs: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes of runs (key, up, run) with the path of their parents in `above` (key, idx, path, top) and their own place before it."""
    met = runs.join(above.select("key", F.col("idx").alias("up"), "path", "top"), ["key", "up"])
    met = met.select("key", "path", "top", "run", F.posexplode("run").alias("at", "node"))
    left, right = (F.array_join(x, "") for x in (F.expr("slice(run.digest, 1, at)"), F.expr("slice(run.digest, at + 2, size(run))")))
    own = F.array(F.struct(left.alias("l"), right.alias("r")))
    return met.select("key", F.col("node.idx").alias("idx"), F.concat(own, "path").alias("path"), "top")


def paths(nodes_: DataFrame, start: DataFrame, height: int, fanout: int = FANOUT) -> DataFrame:
    """(key, idx, path, top) of the parents of leaves: their siblings (l, r) of each level upward, behind those of `start`.

    start: (key, level, path, top), what stands above the root of each key. Keys of one leaf have theirs with idx -1.
    """
    above = None
    for level in range(height, -1, -1):
        here = start.where(F.col("level") == level).select("key", F.lit(0 if level else -1).cast("bigint").alias("idx"), "path", "top")
        if above is not None:
            if not level:
                return above.unionByName(here)
            below = nodes_.where(F.col("level") == level).where(f"power({fanout}D, level) < n")
            runs = below.groupBy("key", F.floor(F.col("idx") / fanout).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
            last, here = above, stored(here.unionByName(_below(runs, above)), "paths")  # short plans, whatever the height
            released(last)
        above = here
    return above


def prove(placed: DataFrame, above: DataFrame, root: str, *keep: str, fanout: int = FANOUT) -> DataFrame:
    """Of each leaf (digest; tampered, null where it isn't): keep, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves = placed.withColumn("up", F.when(F.col("n") == 1, F.lit(-1)).otherwise(F.floor(F.col("idx") / fanout)).cast("bigint"))
    runs = leaves.groupBy("key", "up").agg(F.array_sort(F.collect_list(F.struct("idx", F.struct(*keep).alias("keep"), "digest", "tampered"))).alias("run"))
    met = runs.join(above.withColumnRenamed("idx", "up"), ["key", "up"]).select("up", "run", "path", "top")
    kinds = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"keep struct<{', '.join(f'`{k}`:' + placed.schema[k].dataType.simpleString() for k in keep)}>, leaf string, subroot string, proof_sha256 string, folded_root string" if kinds else ""

    def run(batches):
        for b in batches:
            keeps, out = [], []
            for up, leaves_, path, top in zip(*(b.column(c).to_pylist() for c in ("up", "run", "path", "top"))):
                own = [x["digest"] for x in leaves_]
                rest = "".join(p["l"] + p["r"] for p in path)
                for i, x in enumerate(leaves_):
                    left, right = "".join(own[:i]), "".join(own[i + 1 :])
                    now = x["tampered"] or x["digest"]
                    now = now if up < 0 else digest(left, now, right)
                    for p in path:
                        now = digest(p["l"], now, p["r"])
                    keeps.append(x["keep"])
                    out.append((x["digest"], top, digest(left, right, rest), now))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keeps, b.schema.field("run").type.value_type.field("keep").type), *(pa.array(c, pa.string()) for c in cols)], ["keep", "leaf", "subroot", "proof_sha256", "folded_root"])

    out = met.mapInArrow(lean(run), schema)
    return out.select("keep.*", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _height(placed: DataFrame, fanout: int) -> int:
    most, height = placed.agg(F.max("n")).first()[0] or 1, 0
    while fanout**height < most:
        height += 1
    return height


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of each row, and folded_root and verified of the row as it was tampered with.

    tampered: a condition for rows whose text is taken with A-Z in lower case when roots are folded anew from proofs (default:
    unsigned crc32 of the decimal id is a multiple of 3). A null key is a key of its own, the first. Rows of equal ids stand by
    their leaves, null ids first; equal rows each have a leaf. No rows give no rows. Texts of any length are hashed where they
    are read; only digests move. Columns besides those named are not looked at.
    """
    ident, text = F.col(id_col), F.col(text_col)
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if tampered is None:
        tampered = F.crc32(ident.cast("string").cast("binary")) % 3 == 0
    change = F.when(tampered, leaf_digest(*(lowered if c == text_col else F.col(c) for c in columns)))
    key = F.coalesce(F.concat(F.lit("="), F.col(key_col).cast("string")), F.lit(""))  # null before all others
    leaves = docs.select(ident.alias("id"), key.alias("key"), leaf_digest(*map(F.col, columns)).alias("digest"), change.alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    leaves = stored(leaves, "leaves")  # hashes are made once; the tie deals out rows that are equal
    placed = indexed(leaves, "id", "digest", "tie")
    inner = nodes(placed, fanout)
    roots = stored(tops(placed, inner, fanout), "subroots")
    over = indexed(roots.select(F.lit("").alias("key"), F.col("key").alias("of"), "n", "level", "digest").withColumnsRenamed({"n": "leaves", "level": "height"}), "of")
    outer = nodes(over, fanout)
    top = tops(over, outer, fanout).first()
    whole = top["digest"] if top else None
    start = F.array().cast("array<struct<l:string,r:string>>")
    last = outer.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(top["level"] if top else 0).alias("level"), start.alias("path"), F.lit(whole).alias("top"))
    above = paths(outer, last, top["level"] if top else 0, fanout)
    # the subroots as leaves of the upper tree: their own runs stand below what is above
    up = F.when(F.col("n") == 1, F.lit(-1)).otherwise(F.floor(F.col("idx") / fanout)).cast("bigint")
    met = over.withColumn("up", up).join(above.select(F.col("idx").alias("up"), "path"), "up")
    beside = over.withColumn("up", up).groupBy("up").agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
    met = met.join(beside, "up").withColumn("at", F.col("idx") % fanout)
    own = F.expr(f"CASE WHEN n = 1 THEN path ELSE concat(array(struct(array_join(slice(run.digest, 1, CAST(at AS INT)), '') AS l, array_join(slice(run.digest, CAST(at AS INT) + 2, {fanout}), '') AS r)), path) END")
    begin = stored(met.select(F.col("of").alias("key"), F.col("height").alias("level"), own.alias("path"), F.col("digest").alias("top")), "begin")
    released(leaves)
    return prove(placed, paths(inner, begin, _height(placed, fanout), fanout), whole, "id", fanout=fanout).withColumnRenamed("id", id_col)
