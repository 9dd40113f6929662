"""Mixing sources to target weights by the cube method (balanced sampling).

Each source gets a target of words; a document of that source enters target / size-of-source times on average: the whole
part surely, the rest with an inclusion probability. The flight moves these probabilities three documents at a time along
the one direction that changes neither the expected words nor the expected number of documents, until one of the three is
0 or 1. A block of a source ends with at most two open documents; the open ones of all blocks of a source meet in fewer
blocks, and so on, until each source has one block. Only its last one or two are left for the landing: first the number
of documents is given up as a constraint, then the last document is rounded to the nearer side. What words that leaves over
or short is made good in the last block: by leaving one document out for another, or alone, or taking one in.

A block holds BLOCK documents at most on average, so a source with a third of all rows is many blocks. All choices follow
from hashes of the row (its id, size and content key) and SEED: reruns agree, and so do runs on other partitions. The landing
keeps the words near their target and not the probabilities of the few documents that it changes.

Null and empty texts have size 0 and count as documents; a null source is one of its own; no rows give no rows; equal rows are
separate documents that share their copies out. Texts of any length only count by their words. Columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: Words of the whole mix for each word of the input; most copies of a source on average.
TOTAL, MOST = 1.5, 2.0
#: Documents of a block, on average.
BLOCK = 1024
SEED = 20
#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of (source, size): shares by weight, at most `most` times the source's size.

    Resharing the excess until no source is above its cap gives the least level at which min(cap, level x weight) sums to
    the total; sorted by cap / weight, the capped sources come first.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = by.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    first = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("goal", F.sum("source_size").over(every) * F.lit(float(total)))
    by = by.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(first.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(every).getField("level"))
    return by.select("source", "source_size", "n_docs", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, u: np.ndarray, last: bool) -> np.ndarray:
    """Inclusion probabilities after the flight (and the landing, if last); u: a uniform number for each document."""
    out, p, size = p, p.tolist(), size.tolist()
    open_: list[int] = []

    def move(idx: list[int], v: list[float], x: float) -> None:
        up = min(((1 - p[i]) if c > 0 else p[i]) / abs(c) for i, c in zip(idx, v) if c)
        down = min((p[i] if c > 0 else (1 - p[i])) / abs(c) for i, c in zip(idx, v) if c)
        step = up if x * (up + down) < down else -down
        for i, c in zip(idx, v):
            p[i] += step * c
            p[i] = 0.0 if p[i] < _NEAR else 1.0 if p[i] > 1 - _NEAR else p[i]

    for k in range(len(p)):
        if _NEAR < p[k] < 1 - _NEAR:
            open_.append(k)
        while len(open_) == 3:
            a, b, c = open_
            v = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
            top = max(map(abs, v))
            move(open_, [x / top for x in v] if top else [1.0, -1.0, 0.0], u[k])
            open_ = [i for i in open_ if 0.0 < p[i] < 1.0]
    if last and len(open_) == 2:
        a, b = open_
        if size[a] or size[b]:
            top = max(size[a], size[b])
            move(open_, [size[b] / top, -size[a] / top], u[a])
        open_ = [i for i in open_ if 0.0 < p[i] < 1.0]
    if last:
        for i in open_:
            p[i] = float(p[i] >= 0.5)
        return _made_good(np.array(p), out, np.array(size), u)
    return np.array(p)


def _made_good(p: np.ndarray, before: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """p after exchanges of one document for another (or for none) that bring the expected words of `before` back, the best first."""
    free = np.flatnonzero((before > _NEAR) & (before < 1 - _NEAR))
    free = free[np.lexsort((u[free], size[free]))]
    while True:  # sizes are whole, so each exchange brings the words nearer by one at least
        over = float((size * (p - before)).sum())
        way = 1.0 if over > 0 else 0.0  # what is in and may go where there are too many words, else the other way round
        gone, come = free[p[free] == way], free[p[free] != way]
        sizes = np.concatenate([[0.0], size[come]])
        want = size[gone] - abs(over)
        at = np.clip(np.searchsorted(sizes, want), 1, len(sizes)) - 1
        at = np.where(np.abs(sizes[np.minimum(at + 1, len(sizes) - 1)] - want) < np.abs(sizes[at] - want), at + 1, at)
        left = np.abs(sizes[at] - want)
        if not len(gone) or left.min() >= abs(over) - _NEAR:
            break
        best = int(left.argmin())
        p[gone[best]] = 1.0 - way
        if at[best]:
            p[come[at[best] - 1]] = way
    return p


def _block_flight(turn: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id", "key", "size"], kind="stable").reset_index(drop=True)
        x = (pdf["h"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        u = ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(11)).astype(float) / 2.0**53
        pdf["p"] = flight(pdf["p"].to_numpy(float), pdf["size"].to_numpy(float), u, last)
        return pdf

    return run


def allocate(sized: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(id, key, source, size) rows -> the same with source_size bigint, target double, copies bigint. key: a hash of the row's content.

    No rows give no rows; a source of size 0 has target 0 and no copies; a null source is a source of its own; equal rows
    are separate documents.
    """
    sized = stored(sized.withColumn("size", F.coalesce("size", F.lit(0).cast("bigint"))), "sizes")
    targets = stored(source_targets(sized, weights, total, most), "targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    t = targets.withColumnRenamed("source", "t_source")
    rows = sized.join(t, sized.source.eqNullSafe(t.t_source)).drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    h = F.xxhash64("id", "key", "size", F.lit(seed))
    rows = rows.select(
        "id", "key", "source", "size", "source_size", "n_docs", "target", F.floor(rate + _NEAR).alias("whole"),
        F.greatest(F.lit(0.0), rate - F.floor(rate + _NEAR)).alias("p"), h.alias("h"),
    )
    done, n = None, largest
    for turn in range(60):
        last = n <= 4 * block
        blocks = F.lit(1) if last else F.ceil(F.col("n_docs") * (n / max(largest, 1)) / F.lit(block))
        rows = rows.withColumn("b", F.pmod(F.xxhash64("h", F.lit(turn)), F.greatest(blocks, F.lit(1))))
        rows = stored(rows.groupBy("source", "b").applyInPandas(_block_flight(turn, last), rows.schema), "flight")
        settled = rows if last else rows.where(f"p <= {_NEAR} or p >= 1 - {_NEAR}")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        rows, n = rows.where(f"p > {_NEAR} and p < 1 - {_NEAR}"), math.ceil(n / block) * 2
    return done.select("id", "key", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("bigint")).alias("copies"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes from each document, repeats counted."""
    sized = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col, F.col(source_col).cast("string")).alias("key"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    return allocate(sized, **how).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix: each row of docs as often as it is taken, with the columns of docs. Equal rows share their copies out among them."""
    key = docs.withColumns({"__cw_id": F.col(id_col), "__cw_key": F.xxhash64(text_col, F.col(source_col).cast("string"))})
    sized = key.select(F.col("__cw_id").alias("id"), F.col("__cw_key").alias("key"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    got = stored(allocate(sized, **how).groupBy("id", "key").agg(F.sum("copies").alias("__cw_copies"), F.count("*").alias("__cw_rows")), "copies")
    got = got.select(F.col("id").alias("__cw_gid"), F.col("key").alias("__cw_gkey"), "__cw_copies", "__cw_rows")
    both = key.join(got, key["__cw_id"].eqNullSafe(got["__cw_gid"]) & (key["__cw_key"] == got["__cw_gkey"]))
    one = both.where("__cw_rows = 1").withColumn("__cw_n", F.col("__cw_copies"))
    w = Window.partitionBy("__cw_gid", "__cw_gkey").orderBy(F.to_json(F.struct(*docs.columns)))  # rows that differ elsewhere, in an order of their own
    more = both.where("__cw_rows > 1").withColumn("__cw_n", F.floor(F.col("__cw_copies") / F.col("__cw_rows")) + (F.row_number().over(w) <= F.col("__cw_copies") % F.col("__cw_rows")).cast("bigint"))
    out = one.unionByName(more).where("__cw_n > 0")
    return out.withColumn("__cw_i", F.explode(F.expr("sequence(1L, __cw_n)"))).select(*docs.columns)
