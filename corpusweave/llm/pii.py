"""Personal data: base patterns and information-theoretic sanitisation of the terms that give them away.

Base kinds are email, ip, card and phone. Beyond them, a term (a lower-cased word of three letters or more) is judged by
how strongly it reveals a protected entity. The sample space is the N words of all distinct texts (copies count once):
n(term) of them are the term, w(entity) stand in texts that hold the entity, and n(term, entity) are both, wherever in the
text they stand. So PMI(term; entity) = log(n(term, entity) N / (n(term) w(entity))), and it is compared with the entity's
own information IC = log(N / w(entity)). A term with PMI >= GENERALISE x IC is generalised wherever it stands in a text that
holds the entity; at PMI >= REMOVE x IC (no other text has it) it is removed.

One sighting is no evidence: the texts must hold the term after two different words and before two different words, so what
near copies of one sentence repeat doesn't count. Entities that stand in the same texts are one class, so an entity that was
seen once has the whole of its text as evidence. All entities of a kind are pooled as well, which judges terms that each of
their texts may hold once, in the same phrase too, but beside two different entities; that pool's counts are smoothed by
PRIOR words of the term spread like all words.

Executors pick the words of such pairs out with a bit map of 2^MAP_BITS hashes (a fixed size); an exact join follows, so
the map's false hits change nothing.

Null text counts as empty and an empty text has no spans; equal rows give equal rows, whatever their ids; no rows give no
rows. A text of any length is one row; its work grows with its length and not with the square of its matches: of the classes
that a text with many of them holds, one that has the fewest words settles what the others could only repeat (see `_sightings`).
Where marks overlap, the one that starts first (of these the longest) is replaced. Extra columns of docs may have any names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, released, stored

KINDS = ("email", "ip", "card", "phone")
PRIOR = 1.0
GENERALISE, REMOVE = 0.95, 1.0
MAP_BITS = 23
#: Texts that occur more than once, by their keys, that are broadcast at most; beyond that they meet by an exchange.
BROADCAST = 200_000
#: Classes of entities that a text may hold before its terms meet one of them for all that share their crowded texts.
CROWDED = 64

_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the same matches as without the looks behind: a run of digits that fails at its start fails at any later start
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in KINDS, then by start."""
    out = [("email", *x) for x in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _entity(text: str, kind: str, start: int, end: int) -> str:
    return f"{kind}:{re.sub(r'[^0-9A-Za-z@.]', '', text[start:end]).lower()}"


def _marks(text: str, actions: dict[str, str]) -> list[tuple[str, int, int]]:
    """(action, start, end) of every occurrence of the terms that no base match covers, by action, then by start."""
    taken = sorted((s, e) for _, s, e in base_spans(text))
    out, k, reach = [], 0, 0  # reach: the furthest end of the base matches that begin before a word's end
    for m in _TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach, k = max(reach, taken[k][1]), k + 1
        if m.start() >= reach and (action := actions.get(m[0].lower())):
            out.append((action, *m.span()))
    return sorted(out)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(text) of docs, each once. Only texts that occur more than once are shuffled, as long as their keys are few."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(t.alias("text"), F.xxhash64(t).alias("t1"), F.xxhash64(t, F.lit(1)).alias("t2"))
    often = stored(keyed.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("t1", "t2"), "copied")
    side = F.broadcast(often) if often.count() <= BROADCAST else often
    once = keyed.join(side, ["t1", "t2"], "left_anti")
    return once.unionByName(keyed.join(side, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])).select("text")


def _hash(word: str) -> int:
    return zlib.crc32(word.encode()) if word else -1


def _words(text: str) -> dict[str, list[int]]:
    """By term: how often it stands in the text, and the least and largest hash of the words before it and after it (-1: none)."""
    found = [w.lower() for w in _TERM.findall(text)]
    h = [_hash(w) for w in found]
    out: dict[str, list[int]] = {}
    for w, p, q in zip(found, [-1, *h], [*h[1:], -1]):
        x = out.get(w)
        if x is None:
            out[w] = [1, p, p, q, q]
        else:
            x[0] += 1
            x[1], x[2], x[3], x[4] = min(x[1], p), max(x[2], p), min(x[3], q), max(x[4], q)
    return out


_TERMS = "array<struct<term:string,n:bigint,p0:bigint,p1:bigint,q0:bigint,q1:bigint>>"
_CONTEXT = pa.schema([
    ("doc_key", pa.string()), ("words", pa.int64()), ("entities", pa.list_(pa.string())),
    ("terms", pa.list_(pa.struct([("term", pa.string()), *((c, pa.int64()) for c in ("n", "p0", "p1", "q0", "q1"))]))),
])


def contexts(texts: DataFrame) -> DataFrame:
    """(doc_key, words, entities, terms) of each of the distinct texts with a base match: all its entities, and its terms with what stands beside them."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text"):
                text = t.as_py()
                if spans := base_spans(text):
                    terms = _words(text)
                    rows.append({
                        "doc_key": hashlib.sha256(text.encode()).hexdigest(), "words": sum(x[0] for x in terms.values()), "entities": sorted({_entity(text, *x) for x in spans}),
                        "terms": [dict(zip(("term", "n", "p0", "p1", "q0", "q1"), (w, *x))) for w, x in terms.items()],
                    })
            yield pa.RecordBatch.from_pylist(rows, _CONTEXT)

    return texts.where(F.col("text").rlike("[@0-9]")).mapInArrow(lean(run), f"doc_key string, words bigint, entities array<string>, terms {_TERMS}")


def _holders(ctx: DataFrame) -> DataFrame:
    """(doc_key, entity, w, k, mark): the entities of each text, with the words and the number of all texts that hold them.

    Entities of the same texts are one, named by their number and hashes; all of a kind are "kind:<kind>" beside (k is null),
    where mark tells the text's own entities of the kind from others.
    """
    own = stored(ctx.select("doc_key", F.col("words").alias("w"), F.explode("entities").alias("entity")), "entities")
    names = own.groupBy("entity").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(doc_key))").alias("x1"), F.expr("bit_xor(xxhash64(doc_key, 1))").alias("x2"))
    named = names.select("entity", F.concat_ws(":", F.lit("set"), "n", F.hex("x1"), F.hex("x2")).alias("name"), "w", F.col("n").alias("k"))
    sets = own.drop("w").join(named, "entity").select("doc_key", F.col("name").alias("entity"), "w", "k", F.lit(0).cast("bigint").alias("mark")).distinct()
    kinds = own.groupBy("doc_key", "w", F.concat(F.lit("kind:"), F.substring_index("entity", ":", 1)).alias("kind")).agg(F.expr("bit_xor(xxhash64(entity))").alias("mark"))
    totals = {r["kind"]: r["w"] for r in kinds.groupBy("kind").agg(F.sum("w").alias("w")).collect()}  # a row a kind
    if totals:
        kinds = kinds.withColumn("w", F.create_map(*(F.lit(y) for x in totals.items() for y in x))[F.col("kind")])
    return sets.unionByName(kinds.withColumnRenamed("kind", "entity").withColumn("k", F.lit(None).cast("bigint")))


def _term_counts(texts: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(term, n) over the distinct texts, for a superset of the wanted terms; n of the null term is the number of all words."""
    at = F.pmod(F.xxhash64("term"), F.lit(1 << bits))
    maps = wanted.select("term").distinct().select(at.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m"))
    size = (1 << bits) // 8
    whole = bytearray(size + 4096)
    for r in maps.collect():  # 2^bits bits in all, whatever the input; hash 0 is a bucket of its own
        lo = (r["b"] - 1) * 4096 if r["b"] > 0 else size
        whole[lo : lo + len(r["m"])] = r["m"]
    sent = texts.sparkSession.sparkContext.broadcast(bytes(whole))

    def run(batches):
        import xxhash

        table = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little")
        for b in batches:
            seen: Counter = Counter()
            for t in b.column("text"):
                seen.update(_TERM.findall(t.as_py()))
            low: Counter = Counter()
            for w, n in seen.items():
                low[w.lower()] += n
            seen, words = low, list(low)
            h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)) & np.uint64((1 << bits) - 1)
            # hash h is position (h - 1) mod 32768 of bucket (h - 1) div 32768 + 1
            hit = table[np.where(h > 0, h.astype(np.int64) - 1, size * 8)] > 0 if len(words) else np.zeros(0, bool)
            picked = [words[i] for i in np.nonzero(hit)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([*picked, None], pa.string()), pa.array([*(seen[w] for w in picked), sum(seen.values())], pa.int64())], ["term", "n"])

    return texts.mapInArrow(lean(run), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _sightings(ctx: DataFrame, held: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(entity, w, k, mark, term, n, p0, p1, q0, q1): a row for each text that holds both, of all pairs that can decide a text.

    A text is crowded if it holds more than `crowded` classes; it doesn't meet them all. Let classes share the same crowded
    texts. A term that no other text of a class has stands for that class in crowded texts alone, so in the same ones for
    all those classes: the one with the fewest words (the first of the group) has no fewer sightings, contexts and
    information, and gives each of these texts the same action or a stronger one. So a first class meets all terms of its
    texts; another one only the terms of its texts that aren't crowded, which are then looked up in those that are. A class
    for which that takes more rows than meeting all terms does so instead.
    """
    each = ctx.select("doc_key", F.explode("terms").alias("x")).select("doc_key", "x.*")
    sets = held.where("k is not null").drop("mark")
    full = sets.groupBy("doc_key").agg(F.count("*").alias("classes")).where(F.col("classes") > crowded)
    full = stored(full.join(ctx.select("doc_key", F.size("terms").cast("bigint").alias("size")), "doc_key"), "crowded")
    if full.isEmpty():
        return held.join(each, "doc_key").drop("doc_key")
    beside = sets.join(ctx.select("doc_key", F.size("terms").cast("bigint").alias("size")), "doc_key").join(full.select("doc_key", F.lit(True).alias("full")), "doc_key", "left")
    links = stored(beside.withColumn("full", F.coalesce("full", F.lit(False))), "links")
    mine = F.when(F.col("full"), F.xxhash64("doc_key")), F.when(F.col("full"), F.xxhash64("doc_key", F.lit(1)))
    by = links.groupBy("entity", "w").agg(
        F.count_if("full").alias("many"), F.bit_xor(mine[0]).alias("g1"), F.bit_xor(mine[1]).alias("g2"),
        F.sum(F.when(F.col("full"), F.col("size")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("full"), 0).otherwise(F.col("size"))).alias("outside"),
    ).where("many > 0")
    by = stored(by, "classes")
    first = by.groupBy("many", "g1", "g2").agg(F.min(F.struct("w", "entity")).alias("f")).select(F.col("f.entity").alias("entity"))
    light = stored(by.join(first, "entity", "left_anti").where("outside * many < inside").select("entity"), "light")
    whole = held.join(light, "entity", "left_anti").join(each, "doc_key").drop("doc_key")
    some = links.join(light, "entity", "left_semi").withColumn("mark", F.lit(0).cast("bigint"))
    met = some.where("not full").select("doc_key", "entity", "w", "k", "mark").join(each, "doc_key").drop("doc_key")
    asked = met.select("entity", "w", "k", "mark", "term").distinct().join(some.where("full").select("entity", "doc_key"), "entity")
    return whole.unionByName(met).unionByName(asked.join(each, ["doc_key", "term"]).drop("doc_key"))


def revealing(texts: DataFrame, ctx: DataFrame, held: DataFrame, most_words: float, generalise: float = GENERALISE, remove: float = REMOVE, bits: int = MAP_BITS, crowded: int = CROWDED) -> DataFrame:
    """(entity, term, action) of the terms that disclose an entity of `held` (see _holders); action: generalise or remove.

    most_words: no fewer than all words of the texts. With it, and with the term's sightings in texts that hold any entity, a
    pair that can't reach `generalise` goes before the terms of all texts are counted.
    """
    seen = ctx.select(F.explode("terms").alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("least_n"))
    two = (F.col("p0") < F.col("p1")) & (F.col("q0") < F.col("q1"))
    # what a single text holds in one place is no evidence, and goes before anything is shuffled by term
    terms = _sightings(ctx, held, crowded).where(F.coalesce(F.col("k") > 1, F.lit(True)) | two)
    ends = (f(c).alias(c) for f, c in ((F.min, "p0"), (F.max, "p1"), (F.min, "q0"), (F.max, "q1")))
    pairs = terms.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.first("w").alias("w"), *ends, F.min("mark").alias("m0"), F.max("mark").alias("m1"))
    pooled = F.col("entity").startswith("kind:")
    prior = F.when(pooled, PRIOR).otherwise(0.0)
    pairs = pairs.where(F.when(pooled, F.col("m0") < F.col("m1")).otherwise(two)).select("entity", "term", "n_te", "w").join(seen, "term")
    can = F.greatest(F.lit(0.0), F.log(F.lit(most_words) / F.col("w"))) * (1 - generalise) + F.log((F.col("n_te") + prior) / (F.col("least_n") + prior))
    pairs = stored(pairs.where(can >= -1e-9).drop("least_n"), "pairs")
    counts = stored(_term_counts(texts, pairs, bits), "terms")
    n = float(counts.where("term is null").agg(F.sum("n")).first()[0] or 1)
    both = pairs.join(counts, "term")
    part = F.col("w") / F.lit(n)
    ic = -F.log(part)
    pmi = ic + F.log((F.col("n_te") + prior * part) / (F.col("n") + prior))
    ratio = F.when(ic > 0, pmi / ic).otherwise(0.0)
    return both.where(ratio >= generalise).select("entity", "term", F.when(ratio >= remove - 1e-12, "remove").otherwise("generalise").alias("action"))


def _term_spans(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(x_key, extra): all occurrences of disclosing terms in each distinct text that has any, as text joined like spans."""
    texts = distinct_texts(docs, text_col)
    ctx = stored(contexts(texts), "contexts")
    held = stored(_holders(ctx), "holders")
    chars, n = docs.agg(F.sum(F.length(text_col)), F.count("*")).first()  # a word has three letters and something after it
    bad = stored(revealing(texts, ctx, held, (chars or 0) / 4 + n + 1.0, **how), "revealing")
    own = ctx.select("doc_key", F.explode("terms.term").alias("term"))
    # by the term first: its sightings are at most some times those in the texts of the entity, or it wouldn't disclose it
    hit = bad.join(own, "term").join(held.select("doc_key", "entity"), ["doc_key", "entity"]).groupBy("doc_key", "term").agg(F.max("action").alias("action"))
    hit = stored(hit.groupBy("doc_key").agg(F.collect_list("term").alias("terms"), F.collect_list("action").alias("actions")), "hits")
    released(ctx, held, bad)
    text = _columns(docs, id_col, text_col).where(F.col("text").rlike("[@0-9]")).withColumn("doc_key", F.sha2("text", 256))
    if hit.count() <= BROADCAST:
        text = text.join(F.broadcast(hit.select("doc_key")), "doc_key", "left_semi")

    def run(batches):
        for b in batches:
            extra = [joined(_marks(t.as_py(), dict(zip(w.as_py(), a.as_py())))) for t, w, a in zip(b.column("text"), b.column("terms"), b.column("actions"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_key"), pa.array(extra, pa.string())], ["x_key", "extra"])

    return text.join(hit, "doc_key").select("doc_key", "text", "terms", "actions").mapInArrow(lean(run), "x_key string, extra string").where("extra <> ''").dropDuplicates(["x_key"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. Spans that the method adds have the kinds generalise and remove."""
    extra = stored(_term_spans(docs, id_col, text_col, **how), "extra")

    def run(batches):
        for b in batches:
            n, sha, base, keys = [[] for _ in KINDS], [], [], []
            for t in b.column("text"):
                text = t.as_py()
                s = base_spans(text)
                kinds = [x[0] for x in s]
                for k, c in zip(KINDS, n):
                    c.append(kinds.count(k))
                base.append(joined(s))
                sha.append(hashlib.sha256(base[-1].encode()).hexdigest())
                keys.append(hashlib.sha256(text.encode()).hexdigest() if s else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in n), pa.array(sha, pa.string()), pa.array(base, pa.string()), pa.array(keys, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "key"])

    rows = _columns(docs, id_col, text_col).mapInArrow(lean(run), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, key string")
    rows = stored(rows, "base")
    free = rows.where("key is null").withColumn("extra", F.lit(None).cast("string"))
    held = rows.where("key is not null").join(extra, rows.key == extra.x_key, "left").drop("x_key")
    return free.unionByName(held).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "extra").alias("spans"))


def redact(text: str, extra: str | None) -> str:
    """text with base matches replaced by their kind, generalised terms by <TERM>, and removed terms left out."""
    spans = base_spans(text) + [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in (extra or "").split(",") if x)]
    out, done = [], 0
    for s, e, kind in sorted((s, -e, k) for k, s, e in spans):
        e = -e
        if e <= done:
            continue
        out.append(text[done : max(s, done)])
        if s >= done:
            out.append({"remove": "", "generalise": "<TERM>"}.get(kind, f"<{kind.upper()}>"))
        done = e
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with personal data and disclosing terms taken out of the text; same rows, same columns, null text stays null."""
    extra = stored(_term_spans(docs, id_col, text_col, **how), "extra").withColumnsRenamed({"x_key": "__cw_xkey", "extra": "__cw_extra"})
    kept = docs.columns
    may = F.coalesce(F.col(text_col).rlike("[@0-9]"), F.lit(False))
    rest = docs.where(~may)
    held = docs.where(may).withColumn("__cw_key", F.sha2(F.col(text_col), 256))
    held = held.join(extra, F.col("__cw_key") == F.col("__cw_xkey"), "left").select(*kept, "__cw_extra")

    def run(batches):
        for b in batches:
            new = pa.array([redact(t.as_py(), x.as_py()) for t, x in zip(b.column(text_col), b.column("__cw_extra"))], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_col else b.column(c) for c in kept], kept)

    return rest.unionByName(held.mapInArrow(lean(run), docs.schema))
