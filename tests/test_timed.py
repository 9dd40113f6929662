"""Timers of streams: bursts that settle, batches by size, time, flush and close."""

import datetime
import time

from pyspark.sql import functions as F

from corpusweave.streaming import timed


def until(test, query=None, seconds=60):
    for _ in range(seconds * 10):
        if query is not None and query.exception():
            raise query.exception()
        if test():
            return True
        time.sleep(0.1)
    return False


class Sink:
    def __init__(self):
        self.calls = []

    def __call__(self, df, n):
        for r in df.groupBy("shard", "batch").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("shard", "batch").collect():
            self.calls.append(r["ids"])


def writer(spark, folder, sink, **how):
    return timed.BatchWriter(spark, str(folder), "id bigint, v string", sink, **how)


def rows(spark, *ids):
    return spark.createDataFrame([(i, "x") for i in ids], "id bigint, v string").coalesce(1)


def test_batch_by_size(spark, tmp_path):
    sink = Sink()
    w = writer(spark, tmp_path, sink, size=3, wait=600_000)
    try:
        w.add(rows(spark, 1, 2))
        timed.caught_up(w.query)
        assert sink.calls == []
        w.add(rows(spark, 3))
        assert until(lambda: sink.calls == [[1, 2, 3]], w.query)
        w.add(rows(spark, 4, 5, 6, 7, 8, 9, 10))
        assert until(lambda: sum(map(len, sink.calls)) == 9 and max(map(len, sink.calls)) == 3, w.query)
    finally:
        w.close()
    assert sorted(sum(sink.calls, [])) == list(range(1, 11)) and len(sink.calls[-1]) == 1


def test_batch_by_time(spark, tmp_path):
    sink = Sink()
    w = writer(spark, tmp_path, sink, size=10, wait=300)
    try:
        w.add(rows(spark, 1, 2))
        assert until(lambda: sink.calls == [[1, 2]], w.query)
        w.add(rows(spark, 3))
        assert until(lambda: sink.calls == [[1, 2], [3]], w.query)
    finally:
        w.query.stop()


def test_batch_by_flush_of_all_shards_close_and_restart(spark, tmp_path):
    sink = Sink()
    w = writer(spark, tmp_path, sink, size=10, wait=600_000, shards=3)
    w.add(rows(spark, *range(12)))
    timed.caught_up(w.query)
    assert sink.calls == []
    w.flush()
    assert sorted(sum(sink.calls, [])) == list(range(12)) and len(sink.calls) <= 3
    w.flush()  # nothing waits
    w.add(rows(spark, 20, 21))
    timed.caught_up(w.query)
    w.query.stop()  # as if the driver were gone: rows wait in the state
    w = writer(spark, tmp_path, sink, size=10, wait=600_000, shards=3)
    w.add(rows(spark, 22))
    w.close()
    assert sorted(x for x in sum(sink.calls, []) if x >= 20) == [20, 21, 22] and not w.query.isActive


def test_bursts_settle_without_later_events(spark, tmp_path):
    inbox, seen = tmp_path / "inbox", []
    at = datetime.datetime(2026, 1, 1)

    def put(*paths):
        spark.createDataFrame([(p, at) for p in paths], "path string, ts timestamp").coalesce(1).write.mode("append").parquet(str(inbox))

    put("a", "a", "b")
    events = spark.readStream.schema("path string, ts timestamp").parquet(str(inbox))
    state = str(tmp_path / "state")
    assert timed.counts(spark, state) == {"pending": 0, "total": 0}
    q = timed.settle(events, 15_000).writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend((r["path"], r["n_events"]) for r in df.collect())).option("checkpointLocation", state).trigger(processingTime="100 milliseconds").start()
    try:
        assert until(lambda: timed.counts(spark, state)["pending"] == 2, q)
        assert {r["path"] for r in timed.waiting(spark, state).collect()} == {"a", "b"} or seen
        put("a")  # goes on with the burst
        assert until(lambda: sorted(seen) == [("a", 3), ("b", 1)], q)
        time.sleep(1)
        assert until(lambda: timed.counts(spark, state) == {"pending": 0, "total": 2}, q) and len(seen) == 2
        put("a")
        assert until(lambda: len(seen) == 3, q) and seen[-1] == ("a", 1)
    finally:
        q.stop()
