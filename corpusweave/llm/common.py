"""Helpers that the operators share: shared-folder tables, text columns, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (tests) gets one of its own.

    A cluster without it is an error: a local folder there would be another one on each machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='corpusweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and has a known size for the planner."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for t in tables:
        if path := t.__dict__.get("_stored_at"):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps now; it does so only once the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run):
    """run for mapInArrow, after which a worker gives back what it has freed: workers stay, and their next task may be another step's."""

    def then_trim(batches):
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return then_trim


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Edges of a graph that one task reduces at once, about.
PIECE = 1 << 18


def _stars(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, changed) for edges v > u: each node with the smallest that these edges reach, and whether that edge was not among them."""
    nodes, at = np.unique(np.concatenate((v, u)), return_inverse=True)
    a, b = at[: len(v)], at[len(v) :]
    root = np.arange(len(nodes))
    while (live := root[a] != root[b]).any():
        a, b = root[a[live]], root[b[live]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    known = np.full(len(nodes), -1)
    np.maximum.at(known, at[: len(v)], at[len(v) :])
    lower = np.full(len(nodes), len(nodes))
    np.minimum.at(lower, at[: len(v)], at[len(v) :])
    return nodes[own], nodes[root[own]], (known[own] != root[own]) | (lower[own] != root[own])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node that each node of an undirected graph reaches.

    edges: columns a, b (bigint, never null). Returns (node, root) for each node that has an edge; a node without edges is
    its own component and isn't returned. Edges are first cut into pieces of about PIECE, each of which one task reduces to stars;
    if there is more than one piece, rounds follow. A round sends each edge to both its ends, in one exchange; a task puts in place of
    the edges of the nodes dealt to it one from each node to the smallest that they reach. So paths shrink from both ends, and
    by all that a task happens to hold. Ends when no task changes an edge: then no node has two edges down, or an end of one
    that has one itself. A task holds 16 bytes for each edge of its nodes, at last those of a component's root; no texts.
    """
    spark = edges.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shrink(batches):
        held = [(b.column("v").to_numpy(), b.column("u").to_numpy()) for b in batches]
        if held:
            node, root, changed = _stars(*(np.concatenate(x) for x in zip(*held)))
            for k in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (node, root, changed)], ["v", "u", "changed"])

    given = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u"), "given")
    pieces = max(1, -(-given.count() // PIECE))
    schema = "v bigint, u bigint, changed boolean"
    e = stored(given.coalesce(pieces).mapInArrow(lean(shrink), schema), "edges")
    released(given)
    for _ in range(rounds if pieces > 1 else 0):
        both = e.select(F.explode(F.array("v", "u")).alias("at"), "v", "u").repartition(tasks, "at").select("v", "u")
        now = stored(both.mapInArrow(lean(shrink), schema), "edges")
        settled = now.where("changed").isEmpty()
        released(e)
        e = now
        if settled:
            break
    else:
        if pieces > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = e.select("v", "u").distinct()
    return out.select(F.col("v").alias("node"), F.col("u").alias("root")).union(out.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
