"""Changes of a workspace as events, debounced, and what to do with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from . import timed

DEBOUNCE = "800 milliseconds"


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relative_path, op) between two snapshots (relative_path, modified, length): create, write or remove."""
    b = before.select("relative_path", F.struct("modified", "length").alias("was"))
    a = after.select("relative_path", F.struct("modified", "length").alias("now"))
    op = F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "remove").otherwise("write")
    return a.join(b, "relative_path", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("relative_path", op.alias("op"))


def debounce(events: DataFrame, path: str = "path", ts: str = "ts", quiet: str = DEBOUNCE, late: str = "1 minute") -> DataFrame:
    """One row for each path and burst of its events, once `quiet` has passed; for streams and tables alike."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(path, F.session_window(ts, quiet).alias("s")).agg(F.count("*").alias("n_events")).select(path, F.col("s.start").alias("first_ts"), "n_events")


def sessions(events: DataFrame, path: str, ts: str, gap_seconds: int) -> DataFrame:
    """The same over a table, by gaps between neighbours: (path, session, first_ts, last_ts, n_events)."""
    w = Window.partitionBy(path).orderBy(ts)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((t - F.lag(t).over(w) >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = events.withColumn("session", F.sum(new).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(path, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))


class Progress(StreamingQueryListener):
    """What a query's batches have told: whether it runs, its last batch and error, and rows read so far."""

    def __init__(self, query_id: str):
        self.query_id, self.running, self.batch, self.rows, self.error = query_id, True, -1, 0, None

    def _own(self, event) -> bool:
        return str(event.id) == self.query_id

    def onQueryStarted(self, event) -> None:
        self.running = self.running or self._own(event)

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.query_id:
            self.batch = event.progress.batchId
            self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._own(event):
            self.running, self.error = False, event.exception


def start(events: DataFrame, sync: Callable[[DataFrame, int], None], checkpoint: str, every: str = "250 milliseconds", quiet: int = 800, size: int = 100, wait: int = 200, tasks: int = 4):
    """A running query that hands settled paths (path, first_ts, n_events) to sync(paths, batch_id), and the Progress of its batches.

    A path settles `quiet` milliseconds after its last event. Settled paths are handed on in batches, once there are `size` of
    them or the first has waited for `wait` milliseconds; a sync gets all batches that are released at once. State is
    dealt to `tasks` tasks: changes of one workspace are few.
    """
    spark = events.sparkSession
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        settled = timed.batches(timed.settle(events.where("path <> ''"), quiet), size, wait, by="path")
        out = settled.writeStream.outputMode("append").foreachBatch(lambda df, n: None if df.isEmpty() else sync(df.drop("shard", "batch"), n))
        query = out.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    progress = Progress(str(query.id))
    spark.streams.addListener(progress)
    return query, progress


def sync_status(events: DataFrame) -> DataFrame:
    """Events by state, and whether any is not done yet."""
    by = events.groupBy("state").agg(F.count("*").alias("n"))
    return by.withColumn("syncing", F.col("state").isin("pending", "active") & (F.col("n") > 0))
