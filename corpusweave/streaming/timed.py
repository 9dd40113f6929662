"""State with processing-time timers: changes that settle, and batches by size or time.

Both are stateful processors, so what waits is in the stream's checkpoint: a restarted query goes on with it, and it can be read
as a table. Timers fire without any later row, as Spark runs batches for them. The state needs the RocksDB store.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTLED = "path string, first_ts timestamp, n_events bigint"


def timed_session(spark: SparkSession) -> SparkSession:
    """Sets the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def caught_up(query) -> None:
    """Returns once a batch that began after this call is done, so all that was there before it is taken in. (Queries with timers run on without data; they are never idle.)"""
    since = datetime.datetime.now(datetime.timezone.utc)
    while query.isActive:
        p = query.lastProgress
        if p and datetime.datetime.fromisoformat(p["timestamp"]) > since:
            return
        time.sleep(0.05)
    if e := query.exception():
        raise e


class Settling(StatefulProcessor):
    """Rows of a path wait until none has come for `quiet` milliseconds; then the burst is one row."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "first_us bigint, n_events bigint, due bigint")
        self.done = handle.getValueState("done", "bursts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = [r["us"] for r in rows]
        first, n = min(times), len(times)
        if self.pending.exists():
            was_first, was_n, was_due = self.pending.get()
            first, n = min(first, was_first), n + was_n
            self.handle.deleteTimer(was_due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.handle.registerTimer(due)
        self.pending.update((first, n, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.pending.exists():
            return
        first, n, due = self.pending.get()
        if due > expiredTimerInfo.getExpiryTimeInMs():  # another event has come meanwhile
            return
        self.pending.clear()
        self.done.update(((self.done.get()[0] if self.done.exists() else 0) + 1,))
        yield Row(path=key[0], first_us=first, n_events=n)

    def close(self) -> None:
        pass


def settle(events: DataFrame, quiet: int = 800) -> DataFrame:
    """(path, first_ts, n_events) of each burst of a stream of (path, ts), `quiet` milliseconds after its last event."""
    timed_session(events.sparkSession)
    own = events.select("path", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).groupBy("path")
    found = own.transformWithState(Settling(quiet), "path string, first_us bigint, n_events bigint", "Append", "ProcessingTime")
    return found.select("path", F.timestamp_micros("first_us").alias("first_ts"), "n_events")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path, first_ts, n_events) of what waits to settle, from the state of the query with that checkpoint; none before its first batch."""
    none = spark.createDataFrame([], _SETTLED)
    found = _state(spark, checkpoint, "pending")
    return none if found is None else found.select(F.col("key.path").alias("path"), F.timestamp_micros("value.first_us").alias("first_ts"), "value.n_events")


def counts(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """How many paths wait, and how many bursts have been handed on, by the state."""
    done = _state(spark, checkpoint, "done")
    total = 0 if done is None else done.agg(F.coalesce(F.sum("value.bursts"), F.lit(0))).first()[0]
    return {"pending": waiting(spark, checkpoint).count(), "total": total}


def _state(spark: SparkSession, checkpoint: str, name: str, operator: int = 0) -> DataFrame | None:
    try:
        found = spark.read.format("statestore").option("stateVarName", name).option("operatorId", operator).load(checkpoint)
        return found.where("value is not null")
    except AnalysisException:  # no batch has been committed yet
        return None
    except Exception as e:
        if "STDS" in str(e) or "does not exist" in str(e):
            return None
        raise


class Batching(StatefulProcessor):
    """Rows of a shard wait until `size` of them, `wait` milliseconds since the first, or a row that says flush, release them as a batch."""

    def __init__(self, schema: str, names: list[str], size: int, wait: int):
        self.schema, self.names, self.size, self.wait = schema, names, size, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.mark = handle.getValueState("mark", "n bigint, due bigint, batch bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, due, batch = self.mark.get() if self.mark.exists() else (0, 0, 0)
        had = n
        held = list(self.rows.get()) if n else []
        flush, fresh = False, []
        for r in rows:
            if r["__flush"]:
                flush = True
            else:
                fresh.append(tuple(r[c] for c in self.names))
        held = [tuple(x) for x in held] + fresh
        whole = len(held) if flush else len(held) // self.size * self.size
        for k in range(0, whole, self.size):
            yield from self._release(key, batch, held[k : min(k + self.size, whole)])
            batch += 1
        left = held[whole:]
        if had and (whole or not left):
            self.handle.deleteTimer(due)
        if left and (whole or not had):
            due = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(due)
        if whole and left:
            self.rows.put(left)
        elif whole:
            self.rows.clear()
        elif fresh:
            self.rows.appendList(fresh)
        self.mark.update((len(left), due, batch))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, due, batch = self.mark.get() if self.mark.exists() else (0, 0, 0)
        if not n or due > expiredTimerInfo.getExpiryTimeInMs():
            return
        yield from self._release(key, batch, [tuple(x) for x in self.rows.get()])
        self.rows.clear()
        self.mark.update((0, 0, batch + 1))

    def _release(self, key, batch: int, rows: list[tuple]) -> Iterator[Row]:
        for r in rows:
            yield Row(**dict(zip(self.names, r)), shard=key[0], batch=batch)

    def close(self) -> None:
        pass


def batches(rows: DataFrame, size: int = 100, wait: int = 200, shards: int = 1, by: str | None = None) -> DataFrame:
    """The rows of a stream with shard and batch, once their batch is released: by `size`, or `wait` milliseconds after its first row.

    by: the column whose hash gives the shard; a shard holds less than `size` rows between batches of the stream, all in its
    state. Rows may have a boolean column __flush: where it is true the row is none itself, but releases its shard's (column __shard).
    """
    timed_session(rows.sparkSession)
    names = [c for c in rows.columns if c not in ("__flush", "__shard")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    own = F.pmod(F.xxhash64(by or names[0]), F.lit(shards)).cast("int")
    flush = F.coalesce(F.col("__flush"), F.lit(False)) if "__flush" in rows.columns else F.lit(False)
    to = F.coalesce(F.col("__shard"), own) if "__shard" in rows.columns else own
    keyed = rows.select(*names, flush.alias("__flush"), to.alias("shard"))
    return keyed.groupBy("shard").transformWithState(Batching(schema, names, max(1, size), max(1, wait)), f"{schema}, shard int, batch bigint", "Append", "ProcessingTime")


class BatchWriter:
    """Rows that are added go to `sink` in batches, by size or time; flush() releases what waits, close() that too, and ends.

    Rows wait in a folder and in the state of a stream, so none is lost with the driver: the writer made anew with the same
    folder goes on. sink gets a DataFrame with shard and batch, and a number that is the same if it gets it again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, sink: Callable[[DataFrame, int], None], size: int = 100, wait: int = 200, shards: int = 1, by: str | None = None):
        self.spark, self.folder, self.schema, self.shards = spark, folder.rstrip("/"), schema, shards
        spark.createDataFrame([], f"{schema}, __flush boolean, __shard int").write.mode("append").parquet(f"{self.folder}/inbox")
        found = spark.readStream.schema(f"{schema}, __flush boolean, __shard int").parquet(f"{self.folder}/inbox")
        out = batches(found, size, wait, shards, by).writeStream.outputMode("append").foreachBatch(lambda df, n: None if df.isEmpty() else sink(df, n))
        self.query = out.option("checkpointLocation", f"{self.folder}/state").trigger(processingTime=f"{min(1000, max(50, wait // 4))} milliseconds").start()

    def add(self, rows: DataFrame) -> None:
        rows.withColumns({"__flush": F.lit(False), "__shard": F.lit(None).cast("int")}).write.mode("append").parquet(f"{self.folder}/inbox")

    def flush(self) -> None:
        """Returns once all rows that were added before are with the sink."""
        none = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in self.spark.createDataFrame([], self.schema).schema)
        self.spark.sql(f"SELECT {none}, true AS __flush, CAST(id AS INT) AS __shard FROM range({self.shards})").coalesce(1).write.mode("append").parquet(f"{self.folder}/inbox")
        caught_up(self.query)

    def close(self) -> None:
        if self.query.isActive:
            self.flush()
            self.query.stop()
