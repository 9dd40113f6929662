"""Query intent, variants, fusion, boosts, branch priority and rendering, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

FINAL, FUSE_K = 5, 10


def intent(queries: DataFrame, query: str = "query", exts: Column | None = None, prefix: Column | None = None) -> DataFrame:
    """queries with tags, symbols, frameworks, layers, prefer_tests and prefer_exact."""
    q, p = F.col(query), prefix if prefix is not None else F.lit("")
    e = exts if exts is not None else F.array().cast("array<string>")
    tags = text.unique_sorted(F.concat(text.tag_tokens(q), text.role_tags(q), text.framework_tags(q), e, text.tag_tokens(p), text.role_tags(p)))
    layers = text.unique_sorted(F.concat(text.role_tags(q), text.role_tags(p)))
    return queries.withColumns({"tags": tags, "symbols": text.symbol_candidates(q), "frameworks": text.framework_tags(q), "layers": layers}).withColumns(
        {"prefer_tests": F.array_contains("tags", "test"), "prefer_exact": text.looks_exact(q)}
    )


def variants(intents: DataFrame, query: str = "query", prefix: Column | None = None) -> DataFrame:
    """One row for each variant (variant_id from 0) of each intent."""
    q, p = text.trim(F.col(query)), prefix if prefix is not None else F.lit("")
    own = F.array(
        q, F.array_join("symbols", " "), F.when(F.col("prefer_tests"), F.concat(q, F.lit(" unit test"))).otherwise(""),
        F.when(F.size("frameworks") > 0, F.concat(q, F.lit(" "), F.array_join("frameworks", " "))).otherwise(""), F.when(p != "", F.concat(q, F.lit(" "), p)).otherwise(""),
    )
    return intents.select("*", F.posexplode(F.array_distinct(F.filter(F.transform(own, text.trim), lambda x: x != ""))).alias("variant_id", "variant"))


def search_filter(exts: list[str] | None = None, prefix: str | None = None, branch: str | None = None) -> Column:
    """Extension, path or ancestor, and branch; conditions that Parquet and partitions can prune by."""
    out = F.lit(True)
    if exts:
        out &= F.col("extension").isin([e.lower().removeprefix(".") for e in exts])
    if prefix and prefix.strip("/"):
        p = prefix.strip("/")
        out &= (F.col("relative_path") == p) | F.array_contains("relative_dirs", p)
    return out & (F.col("branch") == branch) if branch else out


def fuse(hits: DataFrame) -> DataFrame:
    """hits (query_id, variant, rank from 1, point_id, point_score) to one row a point: sum of 1 / (rank + 9), best score, variants."""
    return hits.groupBy("query_id", "point_id").agg(
        F.sum(1.0 / (F.col("rank") - 1 + FUSE_K)).alias("fused"), F.max("point_score").alias("point_score"),
        F.array_sort(F.collect_set(F.concat(F.lit("variant:"), F.col("variant")))).alias("reasons"),
    )


#: What each shared value, each token within a field, and each condition adds to a score.
SHARED = {"tags": ("tag-match", 0.25), "frameworks": ("framework-match", 0.45), "layers": ("layer-match", 0.45), "symbols": ("symbol-match", 0.9)}
WITHIN = {"name": ("name", 0.4), "container": ("container", 0.35), "namespace": ("namespace", 0.25), "relative_path": ("path", 0.15)}
IF_TEST, IF_PREFIX, IF_EXACT, FRESH = 0.75, 0.5, 0.75, 0.15


def _conditions(c: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """By reason, whether a point gets it and what it adds."""
    fresh = (c["max_modified"] > 0) & (c["modified"] > 0)
    return {
        "intent:test": (c["prefer_tests"] & c["is_test"], F.lit(IF_TEST)),
        "path-prefix": ((c["prefix"] != "") & F.contains(F.lower(c["relative_path"]), F.lower(c["prefix"])), F.lit(IF_PREFIX)),
        "freshness": (fresh, c["modified"] / c["max_modified"] * FRESH),
        "intent:exact": (c["prefer_exact"] & (F.size(F.array_intersect(c["symbols"], c["point_symbols"])) > 0), F.lit(IF_EXACT)),
    }


def _found(c: dict[str, Column], field: str) -> Column:
    return F.filter(c["tokens"], lambda t: F.contains(F.lower(c[field]), t))


def boost(c: dict[str, Column]) -> Column:
    """What a point's payload adds to its score, given its query's intent; c: the columns by role."""
    parts = [w * F.size(F.array_intersect(c[k], c[f"point_{k}"])) for k, (_, w) in SHARED.items()]
    parts += [w * F.size(_found(c, k)) for k, (_, w) in WITHIN.items()]
    parts += [F.when(F.coalesce(on, F.lit(False)), w).otherwise(0.0) for on, w in _conditions(c).values()]
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def _prefixed(prefix: str, words: Column) -> Column:
    return F.transform(words, lambda t: F.concat(F.lit(prefix), t))


def reasons(c: dict[str, Column]) -> Column:
    """Why: a sorted list, such as symbol-match:2, name:order, intent:test."""
    n = {name: F.size(F.array_intersect(c[k], c[f"point_{k}"])) for k, (name, _) in SHARED.items()}
    lists = [F.when(x > 0, F.array(F.concat(F.lit(f"{name}:"), x.cast("string")))) for name, x in n.items()]
    lists += [_prefixed(f"{name}:", _found(c, k)) for k, (name, _) in WITHIN.items()]
    lists += [F.when(on, F.array(F.lit(name))) for name, (on, _) in _conditions(c).items()]
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(x, none) for x in lists))))


def best(ranked: DataFrame, k: int = FINAL) -> DataFrame:
    """The k best of each query: score, then point score, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("point_score"), "point_id")
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def branch_priority(own: DataFrame, fallback: DataFrame) -> DataFrame:
    """Hits of the branch, and hits of the default branch in files that the first have none in."""
    rest = fallback.where("relative_path <> ''").join(own.select("query_id", "relative_path").distinct(), ["query_id", "relative_path"], "left_anti")
    return own.unionByName(rest)


def heading() -> Column:
    """The line above a hit, by its kind."""
    c = F.col
    tail = F.concat(F.lit(" [branch: "), c("branch"), F.lit("] (Match Score: "), F.format_string("%.2f", c("score")), F.lit(" | Last Synced: "), F.date_format(F.timestamp_seconds("updated"), "yyyy-MM-dd HH:mm:ss"), F.lit(")")  )
    lines = F.concat(F.lit(" (Lines "), c("start_line"), F.lit("-"), c("end_line"), F.lit(")"))
    start = F.concat(F.lit("#### ["), c("position"), F.lit("] "))
    body = (
        F.when((c("kind") == "function") & (c("receiver") != ""), F.concat(F.lit("Function: `("), c("receiver"), F.lit(")."), c("name"), F.lit("` in "), c("relative_path"), lines))
        .when((c("kind") == "function") & (c("container") != ""), F.concat(F.lit("Method: `"), c("container"), F.lit("."), c("name"), F.lit("` in "), c("relative_path"), lines))
        .when(c("kind") == "function", F.concat(F.lit("Function: `"), c("name"), F.lit("` in "), c("relative_path"), lines))
        .when((c("kind") == "doc_chunk") & (c("page_number") > 0), F.concat(F.lit("Doc Chunk (Page/Section "), c("page_number"), F.lit(") in "), c("relative_path")))
        .when(c("kind") == "doc_chunk", F.concat(F.lit("Doc Chunk in "), c("relative_path")))
        .otherwise(F.concat(F.lit("File Chunk: "), c("relative_path")))
    )
    return F.concat(start, body, tail)


#: Fixed output text: the line for no hits and the title.
NO_HITS = "No relevant structural code blocks or reference components were found matching your query scope."
TITLE = '### Core Codebase Reference Snippets for: "{}"'


def intent_line(intent_: dict, branch: str, n_variants: int) -> str:
    """What the query was taken to mean; lists that are empty are left out."""
    def listed(xs):
        return "`" + "`, `".join(xs) + "`"

    parts = [f"Search intent: tags={listed(intent_['tags'])}"]
    parts += [f"{k}={listed(intent_[k])}" for k in ("frameworks", "layers") if intent_[k]]
    parts += [f"branch=`{branch}`"] if branch else []
    return " | ".join([*parts, f"variants={n_variants}"])


def render(hits: DataFrame, query: str, intent_: dict, n_variants: int, branch: str = "") -> str:
    """Markdown of the few best hits of one query (a bounded result)."""
    rows = hits.orderBy("position").withColumn("heading", heading()).withColumn("fence", text.language_label(F.col("relative_path"))).collect()
    if not rows:
        return NO_HITS
    out = [TITLE.format(query), "", intent_line(intent_, branch, n_variants), ""]
    for r in rows:
        out.append(r["heading"])
        out += [f"Namespace: `{r['namespace']}`"] if r["namespace"] else []
        out += [f"{label}: `{'`, `'.join(r[k])}`" for label, k in (("Tags", "tags"), ("Signals", "reasons")) if r[k]]
        content = r["content"] or ""
        out += [f"```{r['fence']}", content.removesuffix("\n"), "```", ""]
    return "\n".join([*out, ""])
