"""Search of the stored points: intent, variants, both indexes, fusion, boosts and branch priority in one plan for many queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables, text
from ..operators import embedding, search, vectors


def _ranked(points: DataFrame, asked: DataFrame, mode: str, call: Callable[[str], list[float]] | None, stop, postings: DataFrame | None = None) -> DataFrame:
    """(vid, pid, rank, score): the candidates of each variant. Only dense and hybrid search embed anything."""
    lists = []
    if mode in ("dense", "hybrid"):
        vecs = embedding.embed(asked.select("vid", "variant"), "variant", call or embedding.hashed()).select("vid", F.col("dense").alias("qvec"))
        lists.append(vectors.dense_search(points.where("dense is not null").select("pid", "dense"), vecs, "pid", "vid"))
    if mode in ("sparse", "hybrid"):
        own = vectors.sparse_entries(asked, "vid", "variant", stop)
        if postings is None:
            entries = points.select("pid", F.col("sparse.idx").alias("idx"), F.col("sparse.w").alias("w"))
            lists.append(vectors.sparse_search(entries, own, "pid", "vid"))
        else:
            lists.append(vectors.SparseIndex(postings, "pid").search(own, "vid", among=points.select("pid")))
    return lists[0] if len(lists) == 1 else vectors.rrf(lists, "vid", "pid")


def _of_branch(postings: DataFrame | None, branch: str) -> DataFrame | None:
    """Posting blocks of a branch, or of all, by the ids that one_pass gives points."""
    if postings is None:
        return None
    own = postings.where(F.col("branch") == branch) if branch else postings
    return own.withColumn("ids", F.transform("ids", lambda i: F.concat_ws("\0", F.col("branch"), i)))


def one_pass(points: DataFrame, intents: DataFrame, asked: DataFrame, mode: str, call=None, prefix: str = "", stop=tables.STOP_WORDS, postings: DataFrame | None = None) -> DataFrame:
    """points (filtered) with query_id, fused, point_score, reasons and score for each query that they answer."""
    named = points.withColumn("pid", F.concat_ws("\0", "branch", "point_id"))
    hits = _ranked(named, asked, mode, call, stop, postings).join(asked.select("vid", "query_id", "variant"), "vid")
    fused = search.fuse(hits.select("query_id", "variant", "rank", F.col("pid").alias("point_id"), F.col("score").alias("point_score"))).withColumnRenamed("point_id", "pid")
    own = intents.select("query_id", "tokens", *(F.col(c).alias(f"q_{c}") for c in ("tags", "symbols", "frameworks", "layers", "prefer_tests", "prefer_exact")))
    full = fused.join(named.drop("dense", "sparse"), "pid").join(own, "query_id").withColumn("max_modified", F.expr("max(modified) over (partition by query_id)"))
    c = {k: F.col(f"q_{k}") for k in ("tags", "symbols", "frameworks", "layers", "prefer_tests", "prefer_exact")}
    c |= {k: F.coalesce(F.col(k), F.lit("")) for k in ("name", "container", "namespace", "relative_path")}
    c |= {k: text.payload_list(F.col(v)) for k, v in (("point_tags", "tags"), ("point_symbols", "symbol_names"), ("point_frameworks", "framework_tags"), ("point_layers", "layer_tags"))} | {"is_test": F.col("is_test")}
    c |= {"tokens": F.col("tokens"), "prefix": F.lit(prefix.strip("/")), "modified": F.col("modified"), "max_modified": F.col("max_modified")}
    full = full.withColumn("score", F.round(F.col("fused") + search.boost(c), 6))
    return full.withColumn("reasons", F.array_distinct(F.concat("reasons", search.reasons(c))))


def understand(queries: DataFrame, exts: list[str] | None = None, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Intents and variants of the stated queries, as local rows: a few for each query, worked out once."""
    spark, p = queries.sparkSession, F.lit(prefix.strip("/"))
    own = [e.lower().removeprefix(".") for e in exts or ()]
    intents = search.intent(queries, exts=F.array(*map(F.lit, own)).cast("array<string>"), prefix=p)
    intents = intents.withColumn("tokens", text.tag_tokens(F.array_join(F.concat("tags", "symbols"), " ")))
    intents = spark.createDataFrame(intents.collect(), intents.schema)
    asked = search.variants(intents, prefix=p).select("query_id", "variant", F.concat_ws(":", "query_id", "variant_id").alias("vid"))
    return intents, spark.createDataFrame(asked.collect(), asked.schema)


def find(points: DataFrame, queries: DataFrame, mode: str = "dense", call=None, exts: list[str] | None = None, prefix: str = "", branch: str = "", default: str = "main", k: int = search.FINAL, stop=tables.STOP_WORDS, postings: DataFrame | None = None) -> DataFrame:
    """The k best points of each of `queries` (query_id, query), a stated and small set, with `position` from 1.

    With a branch, its points come first; points of the default branch stand in for files that the first pass didn't find.
    The default branch is the one that the last hit of the first pass names, if it names one. postings: the stored posting
    blocks of the points, of which a sparse search reads a part; without them it reads all sparse vectors.
    """
    intents, asked = understand(queries, exts, prefix)

    def ranked(of: str) -> DataFrame:
        return one_pass(points.where(search.search_filter(exts, prefix, of or None)), intents, asked, mode, call, prefix, stop, _of_branch(postings, of))

    hits = ranked(branch)
    if branch:
        last = hits.where("default_branch <> ''").agg(F.min_by("default_branch", F.struct("score", "point_score", "point_id"))).first()[0]
        default = last or default
        if default != branch:
            hits = search.branch_priority(hits, ranked(default))
    return search.best(hits, k)


def answer(points: DataFrame, query: str, mode: str = "dense", call=None, exts: list[str] | None = None, prefix: str = "", branch: str = "", default: str = "main", stop=tables.STOP_WORDS, postings: DataFrame | None = None) -> str:
    """Markdown of the best hits of one query."""
    spark = points.sparkSession
    q = spark.createDataFrame([(0, query)], "query_id int, query string")
    intents, asked = understand(q, exts, prefix)
    return search.render(find(points, q, mode, call, exts, prefix, branch, default, stop=stop, postings=postings), query, intents.first().asDict(), asked.count(), branch)


def evaluate(points: DataFrame, cases: list[dict], mode: str = "dense", call=None, stop=tables.STOP_WORDS, postings: DataFrame | None = None) -> list[tuple[str, bool]]:
    """(query, whether the answer holds the expected text) of each case: query, expect, and perhaps exts and prefix."""
    return [(c["query"], c["expect"].lower() in answer(points, c["query"], mode, call, c.get("exts"), c.get("prefix", ""), stop=stop, postings=postings).lower()) for c in cases]
