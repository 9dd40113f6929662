"""The engine's queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables, text
from ..operators import chunking, code, index, search, vectors
from ..sources import ignore
from ..streaming import watch
from . import shapes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# The corpus: documents as files of two branches. The expressions are the same in Spark and DuckDB.
_EXT = "CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' ELSE 'csv' END"
_REL = f"source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || '.' || {_EXT}"
_MOD = "1700000000 + 60 * doc_id"
_FILES = f"SELECT doc_id, {_REL} AS relative_path, {_EXT} AS extension, 'main' AS branch, text AS content, {_MOD} AS modified FROM documents"
_CORPUS = f"{_FILES} UNION ALL SELECT doc_id, {_REL}, {_EXT}, 'feature/x', text || ' branch', {_MOD} FROM documents WHERE doc_id % 5 = 0"
_DUCK_FILES, _DUCK_CORPUS = (x.replace("AS STRING", "AS VARCHAR") for x in (_FILES, _CORPUS))


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    return d.selectExpr("doc_id", f"{_REL} AS relative_path", f"{_EXT} AS extension", "'main' AS branch", "text AS content", f"{_MOD} AS modified")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    other = files(spark, sf).where("doc_id % 5 = 0").withColumns({"branch": F.lit("feature/x"), "content": F.concat("content", F.lit(" branch"))})
    return files(spark, sf).unionByName(other)


# index maintenance
_STATE = "SELECT relative_path, branch, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(content) END AS file_hash FROM corpus WHERE doc_id % 11 <> 0"


def _state(c: DataFrame) -> DataFrame:
    return c.where("doc_id % 11 <> 0").select("relative_path", "branch", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.sha2("content", 256)).alias("file_hash"))


def _points(c: DataFrame) -> DataFrame:
    seed = F.concat("relative_path", F.lit("_chunk_0"))
    return c.select("relative_path", "branch", text.point_id(seed).alias("point_id"), F.col("modified").alias("updated"))


_ID = "regexp_replace(substr(sha1(relative_path || '_chunk_0'), 1, 32), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5')"


@_query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


@_query(f"WITH corpus AS ({_DUCK_CORPUS}) SELECT relative_path, branch, {_ID} AS point_id FROM corpus")
def point_id(spark, sf):
    return _points(corpus(spark, sf)).select("relative_path", "branch", "point_id")


@_query(f"WITH corpus AS ({_DUCK_CORPUS}), state AS ({_STATE}) SELECT c.relative_path, c.branch FROM corpus c ANTI JOIN state s ON c.relative_path = s.relative_path AND c.branch = s.branch AND sha256(c.content) = s.file_hash")
def hash_skip(spark, sf):
    c = corpus(spark, sf)
    now = c.select("relative_path", "branch", F.sha2("content", 256).alias("file_hash"))
    return index.changed_files(now, _state(c)).select("relative_path", "branch")


@_query(f"WITH corpus AS ({_DUCK_CORPUS}) SELECT relative_path, branch, {_ID} AS point_id FROM corpus WHERE NOT (doc_id % 7 = 0 AND branch = 'main')")
def purge(spark, sf):
    c = corpus(spark, sf)
    return index.purge(_points(c), c.where("doc_id % 7 = 0 AND branch = 'main'")).select("relative_path", "branch", "point_id")


@_query(f"WITH corpus AS ({_DUCK_CORPUS}) SELECT relative_path, branch, {_ID} AS point_id, modified + CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END AS updated FROM corpus WHERE doc_id % 13 <> 0 OR doc_id % 7 = 0")
def upsert(spark, sf):
    c = corpus(spark, sf)
    new = _points(c.where("doc_id % 7 = 0")).withColumn("updated", F.col("updated") + 5)
    return index.upsert(_points(c.where("doc_id % 13 <> 0")), new).select("relative_path", "branch", "point_id", "updated")


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'main' ELSE 'feature/x' END AS branch, CASE WHEN doc_id % 3 = 0 THEN 'main' ELSE 'dev' END AS default_branch FROM documents")
def migrate_branch(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise("feature/x").alias("branch"), F.when(F.col("doc_id") % 3 != 0, "dev").alias("default_branch"))
    return index.migrate_branch(d, "main", "main")


@_query(f"WITH corpus AS ({_DUCK_CORPUS}) SELECT DISTINCT relative_path, branch FROM corpus WHERE doc_id % 9 = 0")
def reconcile_deletes(spark, sf):
    c = corpus(spark, sf)
    return index.deleted_files(c, c.where("doc_id % 9 <> 0"))


@_query(f"WITH corpus AS ({_DUCK_CORPUS}) SELECT relative_path, branch, CAST(ceil(row_number() OVER (PARTITION BY branch ORDER BY doc_id) / 100.0) AS BIGINT) AS batch FROM corpus")
def write_batches(spark, sf):
    return index.write_batches(corpus(spark, sf), 100, "doc_id").select("relative_path", "branch", "batch")


# scans, filters, paths
@_query("SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) BETWEEN 1 AND 8192")
def size_guard(spark, sf):
    n = F.octet_length("text").cast("bigint")
    return _table(spark, sf, "documents").select("doc_id", n.alias("n_bytes")).where("n_bytes between 1 and 8192")


_ANY_EXT = "element_at({}('go', 'js', 'py', 'md', 'pdf', 'bin', 'CS', 'tsx', 'json', 'docx', 'csv', 'php', 'txt', ''), CAST(doc_id % 14 + 1 AS INT))"
_ANY_PATH = "source || '/f' || CAST(doc_id AS {}) || CASE WHEN doc_id % 14 = 13 THEN '' ELSE '.' || {} END"
_DUCK_EXT = "(['go', 'js', 'py', 'md', 'pdf', 'bin', 'CS', 'tsx', 'json', 'docx', 'csv', 'php', 'txt', ''])[CAST(doc_id % 14 + 1 AS INT)]"


@_query(f"SELECT relative_path, e AS extension, CASE WHEN e IN {tables.CODE} THEN 'code' WHEN e IN {tables.DOCUMENTS} THEN 'document' ELSE 'raw' END AS kind FROM (SELECT {_ANY_PATH.format('VARCHAR', _DUCK_EXT)} AS relative_path, lower({_DUCK_EXT}) AS e FROM documents)")
def route_kind(spark, sf):
    f = _table(spark, sf, "documents").selectExpr(_ANY_PATH.format("STRING", _ANY_EXT.format("array")) + " AS relative_path")
    e = text.extension(F.col("relative_path"))
    return f.select("relative_path", e.alias("extension"), text.file_kind(e).alias("kind"))


@_query(f"SELECT relative_path, branch FROM ({_DUCK_CORPUS}) WHERE extension IN ('md', 'csv') AND starts_with(relative_path, 'src3/en/') AND branch = 'main'")
def ext_path_filter(spark, sf):
    c = corpus(spark, sf).withColumn("relative_dirs", text.parent_dirs(F.col("relative_path")))
    return c.where(search.search_filter([".MD", "csv"], "/src3/en/", "main")).select("relative_path", "branch")


@_query(f"SELECT relative_path, array_to_string([source || '/' || lang, source], ';') AS dirs FROM (SELECT *, {_REL.replace('AS STRING', 'AS VARCHAR')} AS relative_path FROM documents)")
def parent_dirs(spark, sf):
    return files(spark, sf).select("relative_path", F.array_join(text.parent_dirs(F.col("relative_path")), ";").alias("dirs"))


_URL = "regexp_replace(url, '^[a-z]+://', '')"
_BASE = f"regexp_extract({_URL}, '([^/]*)$', 1)"


@_query(
    f"""SELECT page_id, contains(lower(p), '/migrations/') OR (starts_with(b, '.') AND length(b) > 1) OR starts_with(b, '~') OR ends_with(b, '.tmp') OR contains(b, '.tmp.')
    OR regexp_extract(lower(p), '(\\.[^./]*)$', 1) IN ('.html', '.php') {''.join(f" OR ends_with(lower(p), '{s}')" for s in ignore.SUFFIXES)} AS ignored
    FROM (SELECT page_id, {_URL} AS p, {_BASE} AS b FROM pages)"""
)
def ignore_rules(spark, sf):
    p = _table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    return p.select("page_id", ignore.should_ignore(F.col("p"), F.lit(False), exclude_exts=("html", ".php")).alias("ignored"))


_RULES = ("*.csv", "src1/", "/src2/en", "!src2/en/doc_2.md", "src3/**/doc_1*", "src1?/de/")


@_query(
    f"""SELECT relative_path, ends_with(relative_path, '.csv') OR source = 'src1' OR (starts_with(relative_path, 'src2/en/'))
    OR (source = 'src3' AND regexp_matches(relative_path, '/doc_1[^/]*$')) OR regexp_matches(relative_path, '^src1[^/]/de/') AS ignored
    FROM (SELECT *, {_REL.replace('AS STRING', 'AS VARCHAR')} AS relative_path FROM documents)"""
)
def gitignore(spark, sf):
    rules = [r for k, line in enumerate(_RULES) if (r := ignore.compile_rule(line, k))]
    paths = files(spark, sf).select(F.col("relative_path").alias("path"), F.lit(False).alias("is_dir"))
    return ignore.ignored_by_rules(paths, ignore.rules_frame(spark, rules)).select(F.col("path").alias("relative_path"), "ignored")


# text
_SP = text.SPACE


def _trim(e: str) -> str:
    return f"regexp_replace({e}, '^{_SP}+|{_SP}+$', '', 'g')"


def _lines(e: str) -> str:
    return f"list_transform(string_split({e}, chr(10)), lambda x: {_trim('x')})"


_NEW = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"


def _noisy(e: str) -> str:
    kept, full = "length(regexp_replace(x, '[^\\p{L}\\p{Nd}]', '', 'g'))", f"length(regexp_replace(x, '{_SP}', '', 'g'))"
    return f"array_to_string(list_filter({_lines(e)}, lambda x: x = '' OR {kept} >= 0.2 * {full}), chr(10))"


@_query(f"SELECT doc_id, sha256({_NEW}) AS h FROM documents")
def normalize(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2(text.normalize_newlines(F.col("text")), 256).alias("h"))


@_query(f"SELECT doc_id, sha256({_noisy('text')}) AS h FROM documents")
def noisy_lines(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2(text.drop_noisy_lines(F.col("text")), 256).alias("h"))


def _merged(e: str) -> str:
    """Runs of lines that aren't blank as one line, by a fold over the trimmed lines."""
    empty = "CAST([] AS VARCHAR[])"
    lines = f"list_transform({_lines(e)}, lambda l: {{'o': {empty}, 'c': '', 'x': l}})"
    step = "lambda s, r: CASE WHEN r.x = '' THEN {'o': CASE WHEN s.c <> '' THEN list_concat(s.o, [s.c, '']) ELSE list_append(s.o, '') END, 'c': '', 'x': ''} ELSE {'o': s.o, 'c': CASE WHEN s.c = '' THEN r.x ELSE s.c || ' ' || r.x END, 'x': ''} END"
    return f"list_reduce(list_prepend({{'o': {empty}, 'c': '', 'x': ''}}, {lines}), {step})"


_JOINED = "array_to_string(CASE WHEN r.c <> '' THEN list_append(r.o, r.c) ELSE r.o END, chr(10))"
# every third text gets blank lines, noise and returns, which the table has none of
_PARAGRAPHS = "CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10) || ' -- == 1 ' || chr(10)) || chr(10) ELSE text END"


@_query(f"SELECT doc_id, sha256({_JOINED}) AS h FROM (SELECT doc_id, {_merged('t')} AS r FROM (SELECT doc_id, {_PARAGRAPHS} AS t FROM documents))")
def soft_breaks(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2(text.merge_soft_breaks(F.expr(_PARAGRAPHS)), 256).alias("h"))


@_query(f"SELECT doc_id, sha256({_trim(_JOINED)}) AS h FROM (SELECT doc_id, {_merged('t')} AS r FROM (SELECT doc_id, {_noisy(_NEW)} AS t FROM (SELECT doc_id, {_PARAGRAPHS} AS text FROM documents)))")
def clean_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2(text.clean_text(F.expr(_PARAGRAPHS)), 256).alias("h"))


@_query(
    f"""SELECT doc_id, length(t) > 0 AND length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 0.5 * length(t)
    AND length(regexp_replace(t, '[^\\x{{FFFD}}\\p{{Cc}}]|[\\n\\t\\r]', '', 'g')) <= 0.02 * length(t) AS clean FROM (SELECT doc_id, {_trim('text')} AS t FROM documents)"""
)
def quality(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.is_clean(F.col("text")).alias("clean"))


_PACK = (
    "list_reduce(list_prepend({'o': CAST([] AS VARCHAR[]), 'c': '', 'x': ''}, list_transform(string_split(text, chr(10)), lambda l: {'o': CAST([] AS VARCHAR[]), 'c': '', 'x': l})), "
    "lambda s, r: CASE WHEN strlen(s.c) + strlen(r.x) > 1000 THEN {'o': list_append(s.o, s.c), 'c': r.x || chr(10), 'x': ''} ELSE {'o': s.o, 'c': s.c || r.x || chr(10), 'x': ''} END)"
)


@_query(f"SELECT doc_id, CAST(i AS INTEGER) - 1 AS chunk_idx, sha256(a[i]) AS h FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, CASE WHEN r.c <> '' THEN list_append(r.o, r.c) ELSE r.o END AS a FROM (SELECT doc_id, {_PACK} AS r FROM documents)))")
def line_chunks(spark, sf):
    c = _table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.line_chunks(F.col("text"))).alias("chunk_idx", "chunk"))
    return c.select("doc_id", "chunk_idx", F.sha2("chunk", 256).alias("h"))


@_query()
def para_chunks(spark, sf):
    return chunking.paragraph_chunks(_table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "page_number", "k", "hash")


# tags and symbols
def _set(e: str) -> str:
    return f"array_to_string(list_sort(list_distinct({e})), ',')"


_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(tables.STOP_WORDS)) + ")"


def _tokens(e: str) -> str:
    words = f"regexp_split_to_array(regexp_replace(regexp_replace(coalesce({e}, ''), '{text.SEPARATORS}', ' ', 'g'), '{text.CAMEL}', '\\1 \\2', 'g'), '\\s+')"
    return f"list_filter(list_transform({words}, lambda x: lower(x)), lambda x: strlen(x) >= 2 AND x NOT IN {_STOP})"


def _roles(e: str) -> str:
    t = _tokens(e)
    return "list_filter([" + ", ".join(f"CASE WHEN list_has_any(__T, [{', '.join(repr(w) for w in ws)}]) THEN '{r}' END" for r, ws in tables.ROLES.items()).replace("__T", t) + "], lambda x: x IS NOT NULL)"


@_query(f"SELECT page_id, {_set(_tokens('url'))} AS tags FROM pages")
def path_tokens(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.array_join(text.tag_tokens(F.col("url")), ",").alias("tags"))


@_query(f"SELECT item_id, array_to_string(regexp_split_to_array(regexp_replace(replace(initcap_, ' ', ''), '{text.CAMEL}', '\\1 \\2', 'g'), '\\s+'), '|') AS words FROM (SELECT item_id, array_to_string(list_transform(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS initcap_ FROM benchmark)")
def camel_split(spark, sf):
    name = F.array_join(F.transform(F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " "), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")
    return _table(spark, sf, "benchmark").select("item_id", F.regexp_replace(F.regexp_replace(name, F.lit(text.CAMEL), F.lit("$1 $2")), r"\s+", "|").alias("words"))


_ROLE_TEXT = "props || ' ' || event_type || CASE event_id % 4 WHEN 0 THEN '/OrderServiceTests' WHEN 1 THEN '/api/user_repository' WHEN 2 THEN '.config.model' ELSE '' END"


@_query(f"SELECT event_id, {_set(_roles(_ROLE_TEXT))} AS roles FROM events")
def role_tags(spark, sf):
    return _table(spark, sf, "events").select("event_id", F.array_join(text.role_tags(F.expr(_ROLE_TEXT)), ",").alias("roles"))


def _frameworks(e: str) -> str:
    found = [f"CASE WHEN {' OR '.join(f'contains({e}, {w!r})' for w in ws)} THEN [{', '.join(repr(x) for x in ((t, 'test') if t in tables.TEST_FRAMEWORKS else (t,)))}] ELSE [] END" for t, ws in tables.FREE_FRAMEWORKS.items()]
    return f"flatten([{', '.join(found)}])"


_FREE = "text || CASE conv_id % 5 WHEN 0 THEN ' with pytest and Django' WHEN 1 THEN ' asp.net core, xUnit' WHEN 2 THEN ' react engine' ELSE '' END"


@_query(f"SELECT conv_id, turn, {_set(_frameworks(f'lower({_FREE})'))} AS frameworks FROM conversations")
def framework_tags(spark, sf):
    return _table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.framework_tags(F.expr(_FREE)), ",").alias("frameworks"))


@_query(f"SELECT conv_id, turn, CASE WHEN f LIKE '%xunit%' THEN 'xunit' WHEN f LIKE '%pytest%' THEN 'pytest' ELSE '' END AS framework FROM (SELECT conv_id, turn, lower({_FREE}) AS f FROM conversations)")
def test_framework(spark, sf):
    return _table(spark, sf, "conversations").select("conv_id", "turn", text.test_framework(text.framework_tags(F.expr(_FREE))).alias("framework"))


def _variants(e: str) -> str:
    base = f"regexp_replace(regexp_extract(replace({_trim(e)}, chr(92), '/'), '([^/]*)/*$', 1), '\\.[^.]*$', '')"
    own = f"[lower({base}), lower(replace({base}, '_', '')), lower(replace(replace({base}, '_', ' '), '.', ' '))]"
    return f"CASE WHEN {_trim(e)} = '' THEN [] ELSE list_filter(list_transform(list_concat({own}, {_tokens(base)}), lambda x: {_trim('x')}), lambda x: x <> '') END"


@_query(f"SELECT page_id, {_set(_variants('url'))} AS variants FROM pages")
def symbol_variants(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.array_join(text.symbol_variants(F.col("url")), ",").alias("variants"))


@_query(f"SELECT relative_path, {_set(f'list_concat([{chr(39)}file{chr(39)}, {chr(39)}.{chr(39)} || extension, CASE extension WHEN {chr(39)}md{chr(39)} THEN {chr(39)}markdown{chr(39)} ELSE extension END], list_concat({_tokens(chr(114) + "elative_path")}, {_roles("relative_path")}))')} AS tags FROM ({_DUCK_FILES})")
def file_tags(spark, sf):
    return files(spark, sf).select("relative_path", F.array_join(text.file_tags(F.col("relative_path")), ",").alias("tags"))


# intent
_Q = "SELECT conv_id * 100 + turn AS query_id, text || CASE conv_id % 4 WHEN 0 THEN ' UserService tests' WHEN 1 THEN ' pkg/order_api.go' WHEN 2 THEN ' with pytest' ELSE '' END AS query FROM conversations WHERE role = 'user'"
_CANDS = f"flatten(list_transform(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_./-]*'), lambda m: {_variants('m')}))"


def user_queries(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "conversations").where("role = 'user'")
    return c.selectExpr("conv_id * 100 + turn AS query_id", "text || CASE conv_id % 4 WHEN 0 THEN ' UserService tests' WHEN 1 THEN ' pkg/order_api.go' WHEN 2 THEN ' with pytest' ELSE '' END AS query")


_EXACT = "regexp_matches(query, '[/._]|[a-z][A-Z]|[A-Z][a-z]+[A-Z]')"
_TAGS = f"list_concat(list_concat({_tokens('query')}, {_roles('query')}), {_frameworks('lower(query)')})"


@_query(f"SELECT query_id, {_set(_TAGS)} AS tags, {_set(_CANDS)} AS symbols, {_set(_frameworks('lower(query)'))} AS frameworks, {_set(_roles('query'))} AS layers, list_contains({_TAGS}, 'test') AS prefer_tests, {_EXACT} AS prefer_exact FROM ({_Q})")
def intent(spark, sf):
    i = search.intent(user_queries(spark, sf))
    return i.select("query_id", *(F.array_join(c, ",").alias(c) for c in ("tags", "symbols", "frameworks", "layers")), "prefer_tests", "prefer_exact")


@_query(f"SELECT query_id, {_EXACT} AS exact FROM ({_Q})")
def exact_query(spark, sf):
    return user_queries(spark, sf).select("query_id", text.looks_exact(F.col("query")).alias("exact"))


_VARS = f"""SELECT query_id, list_filter([{_trim('query')}, array_to_string(list_sort(list_distinct({_CANDS})), ' '), CASE WHEN list_contains({_TAGS}, 'test') THEN {_trim('query')} || ' unit test' ELSE '' END,
 CASE WHEN len({_frameworks('lower(query)')}) > 0 THEN {_trim('query')} || ' ' || array_to_string(list_sort(list_distinct({_frameworks('lower(query)')})), ' ') ELSE '' END], lambda x: x <> '') AS v FROM ({_Q})"""


@_query(f"SELECT query_id, v[i] AS variant FROM (SELECT query_id, v, unnest(range(1, len(v) + 1)) AS i FROM ({_VARS})) WHERE list_position(v, v[i]) = i")
def query_variants(spark, sf):
    return search.variants(search.intent(user_queries(spark, sf))).select("query_id", "variant")


# vectors
_TERMS = f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents) WHERE token NOT IN {_STOP} GROUP BY ALL"
_FNV = (
    "list_reduce(list_prepend({'h': CAST(3421674724 AS BIGINT), 'l': CAST(2216829733 AS BIGINT), 'b': CAST(0 AS BIGINT)}, list_transform(range(1, strlen(token) + 1), lambda i: {'h': CAST(0 AS BIGINT), 'l': CAST(0 AS BIGINT), 'b': CAST(ascii(substr(token, CAST(i AS BIGINT), 1)) AS BIGINT)})), "
    "lambda s, r: {'h': (s.h * 435 + ((xor(s.l, r.b) * 435) // 4294967296) + xor(s.l, r.b) * 256) % 4294967296, 'l': (xor(s.l, r.b) * 435) % 4294967296, 'b': CAST(0 AS BIGINT)})"
)
_ENTRIES = f"SELECT doc_id, idx, sum(tf * ln(1 + strlen(token))) AS w FROM (SELECT *, xor(f.h, f.l) AS idx FROM (SELECT *, {_FNV} AS f FROM ({_TERMS}) JOIN (SELECT DISTINCT token AS t2 FROM ({_TERMS})) ON token = t2)) GROUP BY ALL"


@_query(f"SELECT doc_id, token, tf FROM ({_TERMS})")
def sparse_terms(spark, sf):
    return vectors.terms(_table(spark, sf, "documents"), "doc_id", "text")


@_query(f"WITH terms AS MATERIALIZED ({_TERMS}), names AS MATERIALIZED (SELECT token, {_FNV} AS f FROM (SELECT DISTINCT token FROM terms)) SELECT doc_id, xor(f.h, f.l) AS idx, round(sum(tf * ln(1 + strlen(t.token))), 6) AS w FROM terms t JOIN names n ON t.token = n.token GROUP BY ALL")
def sparse_vector(spark, sf):
    return vectors.sparse_entries(_table(spark, sf, "documents"), "doc_id", "text").withColumn("w", F.round("w", 6))


_QTERMS = _TERMS.replace("documents", "benchmark").replace("doc_id", "item_id")


def _sparse_hits(spark, sf, k=vectors.CANDIDATES):
    d, q = _table(spark, sf, "documents"), _table(spark, sf, "benchmark")
    return vectors.sparse_search(vectors.sparse_arrays(d, "doc_id", "text", hashed=False), vectors.sparse_entries(q, "item_id", "text", hashed=False), "doc_id", "item_id", k)


_SPARSE = f"SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT item_id, doc_id, round(sum(d.tf * q.tf * ln(1 + strlen(d.token)) * ln(1 + strlen(d.token))), 6) AS score FROM ({_TERMS}) d JOIN ({_QTERMS}) q ON d.token = q.token GROUP BY ALL)) WHERE rank <= 40"


@_query(_SPARSE)
def sparse_search(spark, sf):
    index = vectors.SparseIndex.of(vectors.sparse_arrays(_table(spark, sf, "documents"), "doc_id", "text", hashed=False), "doc_id")
    return index.search(vectors.sparse_entries(_table(spark, sf, "benchmark"), "item_id", "text", hashed=False), "item_id").select("item_id", "doc_id", "score", "rank")


def _dense_hits(spark, sf, k=vectors.CANDIDATES):
    e = _table(spark, sf, "embeddings")
    return vectors.dense_search(e.select("vec_id", F.col("embedding").alias("dense")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "vec_id", "query_id", k)


_DENSE = "SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 40"


@_query(_DENSE)
def dense_search(spark, sf):
    return _dense_hits(spark, sf)


_HYBRID = f"SELECT query_id, point_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS INTEGER) AS rank FROM (SELECT query_id, point_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, vec_id AS point_id, rank FROM ({_DENSE}) UNION ALL SELECT item_id, doc_id, rank FROM ({_SPARSE})) GROUP BY ALL)) WHERE rank <= 40"


@_query(_HYBRID)
def hybrid_rrf(spark, sf):
    dense = _dense_hits(spark, sf).withColumnRenamed("vec_id", "point_id")
    sparse = _sparse_hits(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("point_id"), "rank")
    return vectors.rrf([dense, sparse], "query_id", "point_id")


# ranking
def _variant_hits(spark, sf):
    h = _sparse_hits(spark, sf)
    return h.select((F.col("item_id") % 10).alias("query_id"), F.concat(F.lit("v"), F.col("item_id")).alias("variant"), "rank", F.col("doc_id").alias("point_id"), F.col("score").alias("point_score"))


_FUSED = f"SELECT item_id % 10 AS query_id, doc_id AS point_id, sum(1.0 / (rank - 1 + 10)) AS fused, max(score) AS point_score, array_to_string(list_sort(list(DISTINCT 'variant:v' || item_id)), ',') AS reasons FROM ({_SPARSE}) GROUP BY 1, 2"


@_query(f"SELECT query_id, point_id, round(fused, 6) AS fused, point_score, reasons FROM ({_FUSED})")
def variant_fusion(spark, sf):
    return search.fuse(_variant_hits(spark, sf)).select("query_id", "point_id", F.round("fused", 6).alias("fused"), "point_score", F.array_join("reasons", ",").alias("reasons"))


_ASK = "'where is doc_1 of src1 service' || CASE WHEN query_id % 2 = 0 THEN ' tested with pytest' ELSE '' END || CASE WHEN query_id % 3 = 0 THEN ' in en' ELSE ' and OrderStore' END"
# a point's payload by columns of its document; the expressions are the same in Spark and DuckDB
_PAYLOAD = {
    "name": "CASE WHEN doc_id % 3 = 0 THEN 'ServiceDoc' ELSE 'load' END", "container": "CASE WHEN doc_id % 4 = 0 THEN 'OrderStore' ELSE '' END", "namespace": "'app.' || lang",
    "framework": "CASE WHEN doc_id % 5 < 2 THEN 'pytest' ELSE 'django' END", "is_test": "doc_id % 7 < 3",
}
_HITS = f"SELECT f.*, d.* EXCLUDE (content), {_ASK} AS query FROM ({_FUSED}) f JOIN (SELECT f.*, {', '.join(f'{v} AS {k}' for k, v in _PAYLOAD.items())} FROM ({_DUCK_FILES.replace('FROM documents', ', source, lang FROM documents')}) f) d ON d.doc_id = f.point_id"
_OF_QUERY = f"SELECT query_id, list_distinct({_TAGS}) AS tags, list_distinct({_CANDS}) AS symbols, list_distinct({_frameworks('lower(query)')}) AS frameworks, list_distinct({_roles('query')}) AS layers, {_EXACT} AS exact FROM (SELECT DISTINCT query_id, query FROM ({_HITS}))"
_OF_POINT = f"SELECT *, max(modified) OVER (PARTITION BY query_id) AS max_modified, list_distinct({_tokens('relative_path')}) AS p_tags, list_distinct({_roles('relative_path')}) AS p_layers, list_distinct({_variants('container')}) AS p_symbols FROM ({_HITS})"
_PATTERN_TOKENS = _tokens("array_to_string(list_concat(tags, symbols), ' ')")


def _in(field: str, weight: float) -> str:
    return f"{weight} * len(list_filter(tokens, lambda t: contains(lower({field}), t)))"


_BOOST = f"""SELECT query_id, point_id, point_score, relative_path, round(fused + 0.25 * len(list_intersect(tags, p_tags)) + 0.45 * len(list_intersect(frameworks, [framework])) + 0.45 * len(list_intersect(layers, p_layers))
 + 0.9 * len(list_intersect(symbols, p_symbols)) + {_in('name', 0.4)} + {_in('container', 0.35)} + {_in('namespace', 0.25)} + {_in('relative_path', 0.15)}
 + CASE WHEN list_contains(tags, 'test') AND is_test THEN 0.75 ELSE 0 END + CASE WHEN contains(relative_path, 'src1') THEN 0.5 ELSE 0 END + modified / max_modified * 0.15
 + CASE WHEN exact AND len(list_intersect(symbols, p_symbols)) > 0 THEN 0.75 ELSE 0 END, 6) AS score
 FROM (SELECT p.*, q.* EXCLUDE (query_id), list_distinct({_PATTERN_TOKENS}) AS tokens FROM ({_OF_POINT}) p JOIN ({_OF_QUERY}) q ON p.query_id = q.query_id)"""


def _boosted(spark, sf):
    d = _table(spark, sf, "documents").selectExpr("doc_id AS point_id", f"{_REL} AS relative_path", f"{_MOD} AS modified", *(f"{v} AS {k}" for k, v in _PAYLOAD.items()))
    f = search.fuse(_variant_hits(spark, sf)).withColumn("query", F.expr(_ASK))
    own = search.intent(f.select("query_id", "query").distinct())
    own = own.select("query_id", *(F.col(c).alias(f"q_{c}") for c in ("tags", "symbols", "frameworks", "layers", "prefer_tests", "prefer_exact")))
    own = own.withColumn("tokens", text.tag_tokens(F.array_join(F.concat("q_tags", "q_symbols"), " ")))
    f = f.join(d, "point_id").join(own, "query_id").withColumn("max_modified", F.expr("max(modified) over (partition by query_id)"))
    c = {k: F.col(f"q_{k}") for k in ("tags", "symbols", "frameworks", "layers", "prefer_tests", "prefer_exact")} | {k: F.col(k) for k in ("name", "container", "namespace", "relative_path", "is_test", "tokens", "max_modified")}
    c |= {"point_tags": text.tag_tokens(F.col("relative_path")), "point_layers": text.role_tags(F.col("relative_path")), "point_symbols": text.symbol_variants(F.col("container")), "point_frameworks": F.array("framework")}
    c |= {"prefix": F.lit("src1"), "modified": F.col("modified").cast("double")}
    return f.select("query_id", "point_id", "point_score", "relative_path", F.round(F.col("fused") + search.boost(c), 6).alias("score"), search.reasons(c).alias("why"))


_WHY = f"""SELECT query_id, point_id, array_to_string(list_sort(flatten([
 CASE WHEN len(list_intersect(tags, p_tags)) > 0 THEN ['tag-match:' || len(list_intersect(tags, p_tags))] ELSE [] END, CASE WHEN list_contains(frameworks, framework) THEN ['framework-match:1'] ELSE [] END,
 CASE WHEN len(list_intersect(layers, p_layers)) > 0 THEN ['layer-match:' || len(list_intersect(layers, p_layers))] ELSE [] END, CASE WHEN len(list_intersect(symbols, p_symbols)) > 0 THEN ['symbol-match:' || len(list_intersect(symbols, p_symbols))] ELSE [] END,
 {', '.join(f"list_transform(list_filter(tokens, lambda t: contains(lower({k}), t)), lambda t: '{n}:' || t)" for k, n in (('name', 'name'), ('container', 'container'), ('namespace', 'namespace'), ('relative_path', 'path')))},
 CASE WHEN list_contains(tags, 'test') AND is_test THEN ['intent:test'] ELSE [] END, CASE WHEN contains(relative_path, 'src1') THEN ['path-prefix'] ELSE [] END, ['freshness'],
 CASE WHEN exact AND len(list_intersect(symbols, p_symbols)) > 0 THEN ['intent:exact'] ELSE [] END])), ',') AS why
 FROM (SELECT p.*, q.* EXCLUDE (query_id), list_distinct({_PATTERN_TOKENS}) AS tokens FROM ({_OF_POINT}) p JOIN ({_OF_QUERY}) q ON p.query_id = q.query_id)"""


@_query(_WHY)
def boost_reasons(spark, sf):
    return _boosted(spark, sf).select("query_id", "point_id", F.array_join("why", ",").alias("why"))


@_query(f"SELECT query_id, point_id, score FROM ({_BOOST})")
def boosted_rank(spark, sf):
    return _boosted(spark, sf).select("query_id", "point_id", "score")


_BEST = "SELECT query_id, point_id, score, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_score DESC, point_id) AS INTEGER) AS position FROM ({})) WHERE position <= 5"


@_query(_BEST.format(_BOOST))
def top5(spark, sf):
    return search.best(_boosted(spark, sf)).select("query_id", "point_id", "score", "position")


_BR = f"SELECT query_id, point_id, b.relative_path, b.score FROM ({_BOOST}) b JOIN ({_DUCK_FILES}) d ON d.doc_id = b.point_id"


@_query(f"WITH b AS ({_BR}) SELECT query_id, relative_path, 'feature/x' AS branch FROM b WHERE point_id % 5 = 0 UNION ALL SELECT query_id, relative_path, 'main' FROM b WHERE point_id % 5 <> 0")
def branch_priority(spark, sf):
    b = _boosted(spark, sf)
    own = b.where("point_id % 5 = 0").select("query_id", "relative_path", F.lit("feature/x").alias("branch"))
    return search.branch_priority(own, b.select("query_id", "relative_path", F.lit("main").alias("branch"))).select("query_id", "relative_path", "branch")


@_query(f"SELECT query_id, position, '#### [' || position || '] File Chunk: ' || relative_path || ' [branch: main] (Match Score: ' || format('{{:.2f}}', score) || ' | Last Synced: ' || strftime(make_timestamp(modified * 1000000), '%Y-%m-%d %H:%M:%S') || ')' AS heading FROM ({_BEST.format(_BOOST)}) b JOIN ({_DUCK_FILES}) d ON d.doc_id = b.point_id")
def render_hits(spark, sf):
    d = files(spark, sf).select(F.col("doc_id").alias("point_id"), F.col("modified").alias("updated"), "branch")
    hits = search.best(_boosted(spark, sf)).join(d, "point_id").withColumns({"kind": F.lit("chunk"), "receiver": F.lit(""), "container": F.lit(""), "name": F.lit(""), "start_line": F.lit(0), "end_line": F.lit(0), "page_number": F.lit(0)})
    return hits.select("query_id", "position", search.heading().alias("heading"))


@_query(f"SELECT query_id, round(avg(coalesce(quality, 0)), 6) AS precision_at_5 FROM ({_BEST.format(_BOOST)}) b LEFT JOIN labels l ON l.doc_id = b.point_id GROUP BY 1")
def eval_precision(spark, sf):
    labels = _table(spark, sf, "labels").select(F.col("doc_id").alias("point_id"), "quality")
    hits = search.best(_boosted(spark, sf)).join(labels, "point_id", "left")
    return hits.groupBy("query_id").agg(F.round(F.avg(F.coalesce("quality", F.lit(0))), 6).alias("precision_at_5"))


# streams
@_query("SELECT user_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2")
def debounce_sessions(spark, sf):
    return watch.sessions(_table(spark, sf, "events"), "user_id", "ts", 3600)


@_query("SELECT event_type AS state, count(*) AS n, event_type IN ('pending', 'active') AS syncing FROM events GROUP BY 1")
def sync_status(spark, sf):
    return watch.sync_status(_table(spark, sf, "events").withColumnRenamed("event_type", "state"))


_AIMD_SQL = (
    "list_reduce(list_prepend({'n': 5, 'k': 0, 'ok': true, 'v': CAST(0 AS DOUBLE)}, list({'n': 0, 'k': 0, 'ok': event_type <> 'error', 'v': CAST(value AS DOUBLE)} ORDER BY ts, event_id)), "
    "lambda s, r: CASE WHEN NOT r.ok OR r.v >= 50 THEN {'n': greatest(1, s.n // 2), 'k': 0, 'ok': true, 'v': CAST(0 AS DOUBLE)} WHEN s.k + 1 >= 5 THEN {'n': least(5, s.n + 1), 'k': 0, 'ok': true, 'v': CAST(0 AS DOUBLE)} ELSE {'n': s.n, 'k': s.k + 1, 'ok': true, 'v': CAST(0 AS DOUBLE)} END)"
)


@_query(f"SELECT user_id, r.n AS worker_limit FROM (SELECT user_id, {_AIMD_SQL} AS r FROM events GROUP BY user_id)")
def aimd_limit(spark, sf):
    from ..operators import embedding

    e = _table(spark, sf, "events")
    return embedding.limit_trace(e, "user_id", F.col("event_type") != "error", F.col("value"), ["ts", "event_id"], most=5, fast=50.0)


# code: for each document a source file of known declarations that holds its whole text as a comment
def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _quoted(x) for x in r) + ")" for r in rows)


_EXTS = tuple(shapes.SHAPES)
_ROUTES = [(k, x, *shapes.template(x)) for k, x in enumerate(_EXTS)]
_DECLARED = [(x, shapes.SHAPES[x][0], shapes.SHAPES[x][1], *f) for x in _EXTS for f in shapes.expected(x)]
# which frameworks a language's imports give
_IMPORTED = [(x, path, alias, {"js": "jest,react,test", "ts": "test,vitest", "go": "gin", "php": "laravel", "py": "numpy,pytest,test"}.get(x, "")) for x in _EXTS for path, alias in shapes.SHAPES[x][2]]
# a text as a comment: what would end it is set apart
_COMMENT = "replace(replace(replace(replace(coalesce(text, ''), '*/', '* /'), '\"\"\"', ''), chr(92), '/'), chr(13), ' ')"
_CODE_SQL = f"""code AS (SELECT doc_id, ext, source || '/f' || doc_id || '.' || ext AS relative_path, len({_COMMENT}) - len(replace({_COMMENT}, chr(10), '')) AS n,
  replace(head, '§', CAST(doc_id AS VARCHAR)) || {_COMMENT} || replace(tail, '§', CAST(doc_id AS VARCHAR)) AS content FROM documents JOIN (VALUES {_values(_ROUTES)}) AS r(k, ext, head, tail) ON doc_id % {len(_EXTS)} = k)"""


def _parsed(spark, sf):
    d, routes = _table(spark, sf, "documents"), spark.createDataFrame(_ROUTES, "k int, ext string, head string, tail string")  # a row for each language
    own = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("* /")), F.lit('\"\"\"'), F.lit("'''"))
    own = F.translate(own, "\\\r", "/ ")
    here = [F.replace(F.col(c), F.lit("§"), F.col("doc_id").cast("string")) for c in ("head", "tail")]
    f = d.join(F.broadcast(routes), F.col("doc_id") % len(_EXTS) == F.col("k"))
    return code.extract(f.select("doc_id", F.concat("source", F.lit("/f"), "doc_id", F.lit("."), "ext").alias("relative_path"), F.concat(here[0], own, here[1]).alias("content")))


@_query(f"""WITH {_CODE_SQL}, want AS (SELECT * FROM (VALUES {_values(_DECLARED)}) AS w(ext, language, namespace, name, container, lo, hi, own))
SELECT relative_path, language, namespace, replace(name, '§', CAST(doc_id AS VARCHAR)) AS name, replace(container, '§', CAST(doc_id AS VARCHAR)) AS container, CAST(lo + n AS BIGINT) AS start_line, CAST(hi + n AS BIGINT) AS end_line,
  sha256(coalesce(replace(own, '§', CAST(doc_id AS VARCHAR)), regexp_replace(ltrim(array_to_string(list_slice(string_split(content, chr(10)), lo + n, hi + n), chr(10))), '^export (default )?', ''))) AS h FROM code JOIN want USING (ext)""")
def extract_functions(spark, sf):
    f = code.functions_of(_parsed(spark, sf), "relative_path")
    return f.select("relative_path", "language", "namespace", "name", "container", "start_line", "end_line", F.sha2("content", 256).alias("h"))


@_query(f"SELECT source || '/f' || doc_id || '.' || ext AS relative_path, raw_path, alias, tags FROM documents JOIN (VALUES {_values([(k, x) for k, x, _, _ in _ROUTES])}) AS r(k, ext) ON doc_id % {len(_EXTS)} = k JOIN (VALUES {_values(_IMPORTED)}) AS i(ext, raw_path, alias, tags) USING (ext)")
def extract_imports(spark, sf):
    f = _parsed(spark, sf)
    tags = text.import_tags(F.col("code.language"), F.transform("code.imports", lambda x: x["raw_path"]))
    return f.select("relative_path", F.explode("code.imports").alias("i"), F.array_join(tags, ",").alias("tags")).select("relative_path", "i.raw_path", "i.alias", "tags")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
