"""Dense embeddings from a model server, with retries and an adaptive number of calls at once."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import urllib.request
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS, FIRST_WAIT, FAST_MS, STREAK, WORKERS = 3, 0.1, 1500.0, 5, 5
#: Calls at once of a task, about, where all tasks share one server.
TASK_CALLS = 5


class Limit:
    """Calls at once: one more after STREAK fast ones, half after a slow or failed one, never under one."""

    def __init__(self, most: int = WORKERS, fast_ms: float = FAST_MS):
        self.most, self.fast_ms, self.now, self.streak, self.lock = most, fast_ms, most, 0, threading.Lock()

    def success(self, ms: float) -> None:
        if ms >= self.fast_ms:
            self.failure()
            return
        with self.lock:
            self.streak += 1
            if self.streak >= STREAK:
                self.now, self.streak = min(self.most, self.now + 1), 0

    def failure(self) -> None:
        with self.lock:
            self.now, self.streak = max(1, self.now // 2), 0


def limit_trace(events: DataFrame, key: str, ok: Column, ms: Column, order: list[str], most: int = WORKERS, fast: float = FAST_MS) -> DataFrame:
    """(key, worker_limit): where Limit stands after each key's calls, as an ordered fold in the JVM."""
    calls = F.array_sort(F.collect_list(F.struct(*order, ok.alias("__ok"), ms.cast("double").alias("__ms"))))
    start = F.struct(F.lit(most).alias("n"), F.lit(0).alias("k"))

    def step(s, x):
        slow = F.struct(F.greatest(F.lit(1), F.floor(s["n"] / 2).cast("int")).alias("n"), F.lit(0).alias("k"))
        more = F.struct(F.least(F.lit(most), s["n"] + 1).alias("n"), F.lit(0).alias("k"))
        return F.when(~x["__ok"] | (x["__ms"] >= fast), slow).when(s["k"] + 1 >= STREAK, more).otherwise(F.struct(s["n"].alias("n"), (s["k"] + 1).alias("k")))

    return events.groupBy(key).agg(F.aggregate(calls, start, step, lambda s: s["n"]).alias("worker_limit"))


def http_call(url: str, model: str, context: int = 8192, timeout: float = 120) -> Callable[[str], list[float]]:
    """One call of a server that takes {model, prompt, options} and gives {embedding}."""

    def call(prompt: str) -> list[float]:
        body = json.dumps({"model": model, "prompt": prompt, "options": {"num_ctx": context}}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{url}/api/embeddings", body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return json.load(r)["embedding"]

    return call


def hashed(dim: int = 64) -> Callable[[str], list[float]]:
    """A stand-in without a server: unit vectors from hashed words, the same on every run."""

    def call(prompt: str) -> list[float]:
        v = np.zeros(dim)
        for w in prompt.lower().split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return call


def with_retries(call: Callable[[str], list[float]], limit: Limit | None = None, sleep=time.sleep) -> Callable[[str], list[float]]:
    """Up to ATTEMPTS calls, waiting twice as long after each failure; the last failure is raised."""

    def run(prompt: str) -> list[float]:
        wait = FIRST_WAIT
        for k in range(ATTEMPTS):
            began = time.monotonic()
            try:
                out = call(prompt)
            except Exception:
                if limit:
                    limit.failure()
                if k + 1 == ATTEMPTS:
                    raise
                sleep(wait)
                wait *= 2
                continue
            if limit:
                limit.success((time.monotonic() - began) * 1000)
            return out
        raise AssertionError

    return run


class Gate:
    """Lets no more calls run at once than its Limit allows just now; those that wait go on in the order they came."""

    def __init__(self, limit: Limit):
        self.limit, self.active, self.queue, self.lock = limit, 0, deque(), threading.Condition()

    def __call__(self, call: Callable[[str], list[float]], prompt: str) -> list[float]:
        ticket = object()
        with self.lock:
            self.queue.append(ticket)
            while self.queue[0] is not ticket or self.active >= self.limit.now:
                self.lock.wait()
            self.queue.popleft()
            self.active += 1
            self.lock.notify_all()
        try:
            return call(prompt)
        finally:
            with self.lock:
                self.active -= 1
                self.lock.notify_all()


def shares(workers: int) -> list[int]:
    """Calls at once of each of the tasks that share `workers` of them: as even as can be, about TASK_CALLS each, one at least."""
    tasks = max(1, -(-workers // TASK_CALLS))
    return [max(1, workers // tasks + (k < workers % tasks)) for k in range(tasks)]


def embed(points: DataFrame, text_col: str, call: Callable[[str], list[float]], workers: int = WORKERS, shared: bool = False) -> DataFrame:
    """points with dense array<float>; a call that fails for good fails the task, so no file is stored in part.

    A task has up to `workers` calls at once, fewer while the server is slow or fails. If shared, that bounds all tasks
    together: points are dealt to a fixed number of tasks, each of which has a share of the calls and lowers that share by what
    it sees itself. Only a second attempt that runs beside the first (speculation) comes on top.
    """
    kept = points.columns
    schema = points.withColumn("dense", F.lit(None).cast("array<float>")).schema
    most = shares(workers) if shared else [workers]
    if shared:
        points = points.repartition(len(most))

    def run(batches):
        own = most[TaskContext.get().partitionId() % len(most)]
        limit = Limit(own)
        gate, ask = Gate(limit), with_retries(call, limit)
        with ThreadPoolExecutor(own) as pool:
            for b in batches:
                dense = list(pool.map(lambda t: gate(ask, t or ""), b.column(text_col).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(dense, pa.list_(pa.float32()))], [*kept, "dense"])

    return points.mapInArrow(run, schema)
