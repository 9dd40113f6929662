"""Nearest neighbours by inner product over a forest of random-projection trees.

Trees are fitted on SAMPLE vectors (chosen by a hash): a node splits its vectors at the median along the difference of two
of them, down to leaves of about LEAF of n vectors. Every vector is then sent to its leaf in each tree. A query's leaves of
all trees stand in one priority queue, by its inner product with the mean of the leaf, and it takes as many of them as give
RECALL of the true neighbours in the whole table, which ASKED queries are scanned against all rows for: few where vectors have
structure, over half of all where they have none. Leaves meet queries in calls of up to BLOCK of either.
Leaves and queries meet by an equality join on the leaf, where candidates are ranked by the exact inner product in double
precision; a candidate that an earlier tree has shown the query isn't shown again. Vectors get one more component, so that the
largest inner product is the smallest angle.

Equal vectors are one class that carries its smallest ids, as many as a result can show, so no leaf grows with copies.
Null, zero, non-finite or odd-sized vectors (other than the most common length) take no part. Ties go to the smaller id;
rows of one id are ranked each. Columns besides id and vector are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

#: Vectors on which trees are fitted, at most; trees; sampled vectors of a leaf, about; of them that ask for the number of leaves.
SAMPLE, TREES, LEAF, ASKED = 16384, 2, 20, 256
#: The recall that the number of leaves is set for.
RECALL = 0.95
#: Vectors, and queries, that meet in one call, about.
BLOCK = 8192
SEED = 7


class Forest:
    """Random-projection trees as arrays: node i splits on normals[i], offsets[i] into children[i]; leaf k is the child -1 - k, with means[k]."""

    def __init__(self, sample: np.ndarray, leaf: int = LEAF, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.roots, self.normals, self.offsets, self.children, self.means = [], [], [], [], []
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), max(2, leaf), rng))
        self.normals = np.array(self.normals).reshape(len(self.normals), sample.shape[1])
        self.offsets, self.means = np.array(self.offsets), np.array(self.means)
        self.leaves, self.probes = len(self.means), len(self.means)

    def _grow(self, x: np.ndarray, idx: np.ndarray, least: int, rng) -> int:
        if len(idx) >= 2 * least:
            for _ in range(4):
                a, b = rng.choice(len(idx), 2, replace=False)
                v = x[idx[a]] - x[idx[b]]
                norm = np.sqrt((v * v).sum())
                if norm == 0:
                    continue
                d = x[idx] @ (v / norm)
                cut = float(np.median(d))
                right = d > cut
                if 0 < right.sum() < len(idx):
                    node = len(self.normals)
                    self.normals.append(v / norm)
                    self.offsets.append(cut)
                    self.children.append((0, 0))
                    low = self._grow(x, idx[~right], least, rng)
                    self.children[node] = (low, self._grow(x, idx[right], least, rng))
                    return node
        self.means.append(x[idx].mean(axis=0) if len(idx) else np.zeros(x.shape[1]))
        return -len(self.means)

    def places(self, q: np.ndarray) -> np.ndarray:
        """(queries, leaves): the place of each leaf in each query's queue."""
        place = np.empty((len(q), self.leaves), np.int64)
        np.put_along_axis(place, np.argsort(-(q @ self.means.T), axis=1), np.arange(self.leaves)[None, :], 1)
        return place

    @classmethod
    def of(cls, arrays: dict) -> Forest:
        """A forest from its arrays: tasks get these, as a broadcast object would need its class on executors."""
        f = cls.__new__(cls)
        f.__dict__.update(arrays)
        return f

    def assign(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the leaf of each row in each tree."""
        out = np.empty((len(self.roots), len(x)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, idx = todo.pop()
                if node < 0 or not len(idx):
                    out[t, idx] = node
                    continue
                right = (x[idx] * self.normals[node]).sum(axis=1) > self.offsets[node]
                todo += [(self.children[node][0], idx[~right]), (self.children[node][1], idx[right])]
        return out

    def probe(self, q: np.ndarray) -> np.ndarray:
        """(queries, leaves): whether each query takes each leaf, the first `probes` of one queue for all trees."""
        taken = np.zeros((len(q), self.leaves), bool)
        for lo in range(0, len(q), 1024):
            best = np.argpartition(-(q[lo : lo + 1024] @ self.means.T), self.probes - 1, axis=1)[:, : self.probes]
            np.put_along_axis(taken[lo : lo + 1024], best, True, 1)
        return taken


def _settled(forest: Forest, norm: float, classes: DataFrame, queries: np.ndarray, k: int, recall: float) -> int:
    """How many leaves show `queries` (lifted rows) that share of their k nearest of the whole table, found by a scan for these queries."""
    q = _asking(queries)
    if not len(q):
        return forest.probes
    sent = classes.sparkSession.sparkContext.broadcast((forest.__dict__, norm, q, forest.places(q)))

    def scan(batches):
        arrays, norm, q, place = sent.value
        f, best = Forest.of(arrays), (np.full((len(q), k), -np.inf), np.full((len(q), k), -1))
        for b in batches:
            rows = _lifted(np.asarray(b.column("vec").flatten()).reshape(b.num_rows, -1), norm)
            leaf = -1 - f.assign(rows)
            near = q @ rows.T
            near[near >= 1 - 1e-12] = -np.inf  # itself
            first = np.min([place[:, t] for t in leaf], axis=0)
            score, at = np.concatenate((best[0], near), axis=1), np.concatenate((best[1], first), axis=1)
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(score, top, 1), np.take_along_axis(at, top, 1)
        i, j = np.nonzero(best[1] >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[0][i, j]), pa.array(best[1][i, j])], ["q", "score", "place"])

    found = classes.select("vec").mapInArrow(lean(scan), "q bigint, score double, place bigint")  # k rows a query and task
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "place"))).where(F.col("r") <= k)
    at = found.select("place").toArrow()["place"].to_numpy()  # ASKED x k rows at most
    return min(forest.leaves, int(np.quantile(at, recall)) + 1) if len(at) else forest.probes


def _asking(x: np.ndarray) -> np.ndarray:
    """Rows as queries: unit vectors without the last component."""
    x = x.copy()
    x[:, -1] = 0.0
    return x / np.maximum(1e-300, np.sqrt((x * x).sum(axis=1, keepdims=True)))


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.maximum(0.0, norm * norm - (x * x).sum(axis=1))
    return np.column_stack([x / norm, np.sqrt(rest) / norm])


def _classes(vectors: DataFrame, id_col: str, vec_col: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """(cid, vec, ids), each distinct usable vector with its `keep` smallest ids; and the usable rows (vec_id, vec)."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    v = v.where("vec_id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    size = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    v = v.where(F.size("vec") == (size["d"] if size else 0)).withColumn("vec", F.expr("transform(vec, x -> x + 0.0D)"))

    def gather(batches):
        for b in batches:
            ids: dict[bytes, list] = {}
            x = np.asarray(b.column("vec").flatten()).reshape(b.num_rows, -1)
            for i, row in zip(b.column("vec_id").to_pylist(), x):
                ids.setdefault(row.tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.frombuffer(k) for k in ids], pa.list_(pa.float64())), pa.array([sorted(x)[:keep] for x in ids.values()], pa.list_(pa.int64()))], ["vec", "ids"]
            )

    part = v.mapInArrow(lean(gather), "vec array<double>, ids array<bigint>").groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    return stored(part.select(F.xxhash64("vec").alias("cid"), "vec", "ids"), "classes"), v


def nearest(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to each row that `queries` (a condition on vec_id) picks, itself left out.

    Nearest first, ties to the smaller id. No usable vectors give no rows; fewer candidates than k give what there is.
    """
    classes, v = _classes(vectors, id_col, vec_col, k + 1)
    asked = v.where(queries).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("qid"))
    n, norm = classes.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + x * x))"))).first()
    fitted = classes.orderBy(F.xxhash64("cid", F.lit(seed)), "cid").limit(sample).select("vec").toArrow()["vec"].to_numpy() if n else []
    norm = norm or 1.0
    x = _lifted(np.stack(fitted) if len(fitted) else np.zeros((1, 1)), norm)
    forest = Forest(x, leaf, trees, seed)
    if n > k + 1:
        forest.probes = _settled(forest, norm, classes, x[:ASKED], k, recall)
    asking = stored(asked.select("qid").distinct().join(classes.select(F.col("cid").alias("qid"), "vec"), "qid"), "asking")
    parts = max(1, math.ceil(asking.count() / block))  # queries of a call
    # neighbouring leaves share a task, up to `block` vectors; a leaf of more is cut into blocks
    size = n * trees / forest.leaves
    together, blocks = max(1, int(block / max(size, 1))), max(1, math.ceil(size / block))
    sent = vectors.sparkSession.sparkContext.broadcast((forest.__dict__, norm))

    def index(batches):
        f, norm = Forest.of(sent.value[0]), sent.value[1]
        for b in batches:
            rows = np.asarray(b.column("vec").flatten()).reshape(b.num_rows, -1)
            at = -1 - f.assign(_lifted(rows, norm)) if b.num_rows else np.zeros((trees, 0), np.int64)
            before = pa.FixedSizeListArray.from_arrays(pa.array(at.T.ravel()), trees).cast(pa.list_(pa.int64()))
            for t in range(len(at)):
                yield pa.RecordBatch.from_arrays([pa.array(at[t] // together), pa.array(np.full(len(at[t]), t, np.int32)), b.column("cid"), b.column("first"), b.column("vec"), before], ["leaf", "tree", "cid", "first", "vec", "leaves"])

    def walk(batches):
        f = Forest.of(sent.value[0])
        for b in batches:
            rows = np.asarray(b.column("vec").flatten()).reshape(b.num_rows, -1)
            taken = f.probe(_asking(np.column_stack([rows, np.zeros(len(rows))])))
            bits = pa.array([x.tobytes() for x in np.packbits(taken, axis=1)], pa.binary())
            for lo in range(0, len(rows), 256):  # a batch of results for some queries at a time
                q, leaf_ = np.nonzero(np.logical_or.reduceat(taken[lo : lo + 256], np.arange(0, f.leaves, together), axis=1))
                take = pa.array(q + lo)
                yield pa.RecordBatch.from_arrays([pa.array(leaf_), b.column("qid").take(take), b.column("vec").take(take), bits.take(take)], ["leaf", "qid", "vec", "taken"])

    indexed = classes.select("cid", F.col("ids")[0].alias("first"), "vec").mapInArrow(lean(index), "leaf bigint, tree int, cid bigint, first bigint, vec array<double>, leaves array<bigint>").withColumn("block", F.pmod("cid", F.lit(blocks)).cast("bigint")).withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    asking = asking.mapInArrow(lean(walk), "leaf bigint, qid bigint, vec array<double>, taken binary").withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).withColumn("part", F.pmod("qid", F.lit(parts)).cast("bigint"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            c, ids, first, at, tree = np.stack(left["vec"].to_numpy()), left["cid"].to_numpy(), left["first"].to_numpy(), np.stack(left["leaves"].to_numpy()), left["tree"].to_numpy()
            own = at[np.arange(len(at)), tree]
            order = np.argsort(own, kind="stable")
            c, ids, first, at, tree, own = (x[order] for x in (c, ids, first, at, tree, own))
            ends = np.flatnonzero(np.concatenate((own[1:] != own[:-1], [True]))) + 1
            q, qid, bits = np.stack(right["vec"].to_numpy()), right["qid"].to_numpy(), right["taken"].to_numpy()
            for lo in range(0, len(q), 256):
                taken = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in bits[lo : lo + 256]]), axis=1).astype(bool)
                s = np.full((len(taken), len(ids)), -np.inf)
                for a, b in zip(np.concatenate(([0], ends[:-1])), ends):  # leaf by leaf, for the queries that take it
                    some = np.flatnonzero(taken[:, own[a]])
                    s[some, a:b] = q[lo + some] @ c[a:b].T
                for t in range(int(tree.max())):  # an earlier tree has shown these
                    s[taken[:, at[:, t]] & (tree > t)] = -np.inf
                for j in range(len(s)):
                    near = np.flatnonzero(s[j] > -np.inf)
                    if len(near) > k + 1:
                        least = np.partition(s[j], len(ids) - k - 1)[len(ids) - k - 1]
                        near = np.flatnonzero(s[j] >= least - 1e-9 * max(1.0, abs(least)))
                    exact = (c[near] * q[lo + j]).sum(axis=1)
                    best = np.lexsort((first[near], -exact))[: k + 1]
                    out.append((np.full(len(best), qid[lo + j]), ids[near[best]], exact[best]))
        a, b, s = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
        return pd.DataFrame({"qid": np.asarray(a, np.int64), "cid": np.asarray(b, np.int64), "score": np.asarray(s, float)})

    found = indexed.groupBy("leaf", "block", "part").cogroup(asking.groupBy("leaf", "block", "part")).applyInPandas(rank, "qid bigint, cid bigint, score double")
    # of each query class the k + 1 best classes, pruned before and after the exchange; a class counts with its smallest id
    found = found.join(classes.select("cid", F.col("ids")[0].alias("first")), "cid")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first"))).where(F.col("r") <= k + 1)
    best = best.join(classes.select("cid", "ids"), "cid").groupBy("qid").agg(F.collect_list(F.struct("score", "ids")).alias("c"))
    best = best.select("qid", F.expr(f"slice(array_sort(flatten(transform(c, x -> transform(x.ids, i -> named_struct('d', -x.score, 'vec_id', i))))), 1, {k + 1})").alias("c"))
    best = stored(best, "nearest")
    rows = asked.join(best, "qid").select("query_id", F.expr("transform(c, x -> x.vec_id)").alias("ids"), "c")
    own = F.array_position("ids", F.col("query_id"))
    rows = rows.select("query_id", "c", own.alias("own"))
    rows = rows.select("query_id", F.posexplode(F.expr(f"slice(filter(c, (x, i) -> own = 0 or i <> own - 1), 1, {k})")).alias("i", "x"))
    return rows.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.d")).alias("score"))
