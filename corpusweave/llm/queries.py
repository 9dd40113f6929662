"""One query for each operator of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, forest, langid, lcp, licenses, merkle, mix, pii, quantise, recompress, simhash, unigram
from .common import documents


def byte_bpe(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a public rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), *byte_bpe())


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_report(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(documents(spark, sf_dir), byte_bpe("piece_bpe_32k.model")[0])


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.compare_edited(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove(documents(spark, sf_dir)).drop("kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.components(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_mix_sources": op2_mix_sources,
        "op3_token_counts": op3_token_counts,
        "op4_licenses": op4_licenses,
        "op5_simhash": op5_simhash,
        "op6_language_id": op6_language_id,
        "op7_pii": op7_pii,
        "op8_nearest": op8_nearest,
        "op9_fingerprints": op9_fingerprints,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_vector_codes": op12_vector_codes,
        "op13_minhash": op13_minhash,
    }


# Windows of 35 words by their text, brute force; what the other operators return (models, hashes that DuckDB lacks, samples) SQL can't give.
_OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
hit AS (SELECT doc_id, i FROM s JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM hit, (SELECT unnest(range(35)) AS o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


# Leaves, then trees as lists of one level each: all keys' trees, and one over their roots; a proof is the rest of each run upward.
# CRC-32 is made bit by bit: the list holds a digit and eight times -1 for each digit.
_OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS key, text, source, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE leaf END AS tampered,
    row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS idx
  FROM d),
tree AS (
  SELECT key, 0 AS level, list(leaf ORDER BY idx) AS h FROM leaf GROUP BY key
  UNION ALL
  SELECT key, level + 1, list_transform(range(0, len(h), 8), lambda i: sha256(array_to_string(h[i + 1:i + 8], ''))) FROM tree WHERE len(h) > 1),
top AS (SELECT key, h[1] AS subroot, row_number() OVER (ORDER BY key) - 1 AS place FROM tree WHERE len(h) = 1),
over_ AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS h FROM top
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(h), 8), lambda i: sha256(array_to_string(h[i + 1:i + 8], ''))) FROM over_ WHERE len(h) > 1),
runs AS (
  SELECT key, level, h FROM tree WHERE len(h) > 1
  UNION ALL
  SELECT top.key, 1000 + over_.level, over_.h FROM top, over_ WHERE len(over_.h) > 1),
steps AS (
  SELECT doc_id, leaf, runs.key, row_number() OVER (PARTITION BY doc_id, leaf, leaf.idx ORDER BY runs.level) AS step, h, leaf.idx AS leaf_idx,
    CASE WHEN runs.level < 1000 THEN leaf.idx // CAST(8 ** runs.level AS BIGINT) ELSE top.place // CAST(8 ** (runs.level - 1000) AS BIGINT) END AS i
  FROM leaf JOIN top USING (key) JOIN runs ON runs.key = leaf.key),
sides AS (SELECT key, leaf_idx, step, array_to_string(h[(i - i % 8) + 1:i], '') AS l, array_to_string(h[i + 2:(i - i % 8) + 8], '') AS r FROM steps),
fold AS (
  SELECT key, idx, 0 AS step, tampered AS now FROM leaf
  UNION ALL
  SELECT fold.key, fold.idx, fold.step + 1, sha256(l || now || r) FROM fold JOIN sides ON sides.key = fold.key AND sides.leaf_idx = fold.idx AND sides.step = fold.step + 1),
folded AS (SELECT key, idx, arg_max(now, step) AS folded_root FROM fold GROUP BY key, idx),
proof AS (SELECT key, leaf_idx AS idx, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY key, leaf_idx)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN top USING (key) JOIN folded USING (key, idx) LEFT JOIN proof USING (key, idx), (SELECT h[1] AS root FROM over_ WHERE len(h) = 1)
"""


def _op12(parts: int = quantise.PARTS, entries: int = quantise.ENTRIES, rounds: int = quantise.ROUNDS) -> str:
    """Lloyd rounds unrolled: every round assigns all parts and takes all means anew."""
    far = "list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"SELECT vec_id, part, p, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT vec_id, v.part, p, entry, {far} AS far FROM v JOIN c{{n}} USING (part)) GROUP BY vec_id, part, p"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        mean = f"SELECT part, entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT part, entry, unnest(p) AS x, unnest(range(len(p))) AS pos FROM a{n}) GROUP BY ALL"
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT part, entry, list(x ORDER BY pos) AS c FROM ({mean}) GROUP BY part, entry) AS m USING (part, entry))")
    return f"""
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS p FROM u, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS c FROM v QUALIFY entry < {entries}),
{",".join(steps)},
last AS MATERIALIZED ({near.format(n=rounds)}),
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM last GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN u USING (vec_id), books
"""


# All pairs of sets that share a shingle; a component is the least id that a walk over links reaches.
_OP13 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN list_transform(w, lambda x: x) ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
words AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS common FROM words a JOIN words b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM met WHERE 100 * common >= 80 * (n + m - common)),
ways AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
walk AS (SELECT doc_id, doc_id AS reached FROM sets UNION SELECT doc_id, b FROM walk JOIN ways ON ways.a = walk.reached),
found AS (SELECT doc_id, min(reached) AS component_id FROM walk GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_substring_dedup": _OP10, "op11_merkle_manifest": _OP11, "op12_vector_codes": _op12(), "op13_minhash": _OP13}
