"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of slots serves all languages: each slot is a bit mask of languages, and the AND of an n-gram's slots is the mask
of all languages that (seem to) contain it. A text's n-grams are looked up in one pass; each language's popcount is then
corrected for the false positives that its own share of set slots lets one expect, and the largest corrected count decides.

Training sees all documents with a text and a language whose crc32(id) mod 5 is not 0. An n-gram counts as contained in a
language if at least MIN_SHARE of the language's documents have it, and at least RELATIVE of the share in the language that has it most. Prediction uses the whole text and nothing
else. The table has 8 slots or more for each n-gram that any language contains, 2^MOST_BITS at most; how many a language contains
depends on MIN_SHARE and not on the number of documents, so the table doesn't grow with them.

Texts that are null or have no letter are UNKNOWN; no rows give no rows, equal texts equal results, and languages of equal
counts the first by name. Without labelled texts there is no language and all is UNKNOWN. A text of any length is one array
of its n-grams, 8 bytes each for each of SIZES. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

#: Lengths of n-grams, in characters; a run of anything but letters is one space.
SIZES = (2, 3, 4)
MOST_BITS, HASHES = 24, 2
MIN_SHARE, RELATIVE = 0.02, 0.25
UNKNOWN = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def letters() -> np.ndarray:
    """By code point, whether it is a letter; none is assigned beyond 0x33fff."""
    out = np.zeros(0x110000, bool)
    out[:0x34000] = [chr(i).isalpha() for i in range(0x34000)]
    return out


def grams(text: str | None, is_letter: np.ndarray) -> np.ndarray | None:
    """64-bit hashes of all n-grams of the letters of a text, repeats included; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = is_letter[c]
    if not letter.any():
        return None
    c = np.concatenate(([np.uint32(32)], np.where(letter, c, np.uint32(32)), [np.uint32(32)]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))].astype(np.uint64)
    h, out = c.copy(), []
    for n in range(2, max(SIZES) + 1):
        h = (h[:-1] * np.uint64(0x100000001B3)) ^ c[n - 1 :] if len(h) > 1 else h[:0]
        if n in SIZES:
            out.append(h * np.uint64(8) + np.uint64(n))
    h = np.concatenate(out)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h * m) >> np.uint64(64 - bits)).astype(np.int64) for m in _MIX[:HASHES]]


class Filter:
    """Languages and the masks of their n-grams; masks: (2^bits, words of 64 languages) uint64."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks, self.bits, self.letters = langs, masks, max(1, int(len(masks)).bit_length() - 1), letters()
        fill = [float(((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
        self.wrong = np.array(fill) ** HASHES

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Number of n-grams in each language, corrected for false positives."""
        a = self.masks[(s := slots(h, self.bits))[0]]
        for x in s[1:]:
            a = a & self.masks[x]
        if len(self.langs) <= 12:
            by = np.bincount(a[:, 0].astype(np.int64), minlength=1 << len(self.langs))
            which = np.arange(len(by))
            hits = np.array([by[(which >> i & 1) == 1].sum() for i in range(len(self.langs))], float)
        else:
            hits = np.array([((a[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum() for i in range(len(self.langs))], float)
        return np.maximum(0.0, (hits - len(h) * self.wrong) / np.maximum(1e-9, 1 - self.wrong))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share of all languages' counts and of the text's n-grams; ('und', 0, 0) without a letter or a trained language."""
        if not self.langs or (h := grams(text, self.letters)) is None:
            return UNKNOWN, 0.0, 0.0
        n = self.counts(h)
        total = n.sum()
        k = int(n.argmax())
        return self.langs[k], float(n[k] / total) if total else 0.0, float(n[k] / len(h))


def _known(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the documents to learn from: all with a text and a language, but for those that are held out."""
    ident = F.col(id_col).cast("string")
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(F.crc32(ident.cast("binary")) % 5 != 0, F.lit(True)))
    return known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS) -> Filter:
    """Ties and repeated rows count as they are; without labelled texts the filter has no language."""
    chosen = _known(docs, id_col, text_col, lang_col)

    def merged(parts):
        g, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return g, np.bincount(at, np.concatenate([c for _, c in parts]), len(g)).astype(np.int64)

    def count(batches):
        seen: dict[str, list] = {}
        fresh: dict[str, int] = {}
        docs_: dict[str, int] = {}
        is_letter = letters()
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                docs_[lang] = docs_.get(lang, 0) + 1
                if (h := grams(text, is_letter)) is not None:
                    g = np.unique(h)
                    seen.setdefault(lang, []).append((g, np.ones(len(g), np.int64)))
                    fresh[lang] = fresh.get(lang, 0) + len(g)
                    if fresh[lang] > max(1 << 20, len(seen[lang][0][0])):  # counts of distinct n-grams are held, not those of each text
                        seen[lang], fresh[lang] = [merged(seen[lang])], 0
        for lang, n in docs_.items():
            g, c = merged(seen[lang]) if lang in seen else (np.zeros(0, np.uint64), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(g) + 1)), pa.array(np.concatenate((g.view(np.int64), [0]))), pa.array(np.concatenate((c, [n])).astype(np.int64)), pa.array([False] * len(g) + [True])], ["lang", "g", "n", "total"])

    counted = stored(chosen.mapInArrow(lean(count), "lang string, g bigint, n bigint, total boolean").groupBy("lang", "g", "total").agg(F.sum("n").alias("n")), "ngrams")
    totals = {r["lang"]: r["n"] for r in counted.where("total").collect()}  # a row a language
    if not totals:
        return Filter([], np.zeros((1, 1), np.uint64))
    langs = sorted(totals)
    number = F.create_map(*(F.lit(y) for i, x in enumerate(langs) for y in (x, i)))
    total = F.create_map(*(F.lit(y) for x in langs for y in (x, float(totals[x]))))
    share = counted.where("not total").select("g", number[F.col("lang")].alias("i"), (F.col("n") / total[F.col("lang")]).alias("share"))
    have = share.groupBy("g").agg(F.collect_list(F.struct("i", "share")).alias("by"), F.max("share").alias("top")).where(F.col("top") >= MIN_SHARE)
    have = stored(have.select("g", F.expr(f"transform(filter(by, x -> x.share >= {MIN_SHARE} and x.share >= {RELATIVE} * top), x -> x.i)").alias("langs")), "contained")
    bits = min(most_bits, max(16, (8 * have.count()).bit_length()))

    def place(batches):
        for b in batches:
            g = np.asarray(b.column("g").to_numpy(zero_copy_only=False)).view(np.uint64)
            lists = b.column("langs").to_pylist()
            s = np.stack(slots(g, bits)) if len(g) else np.zeros((HASHES, 0), np.int64)
            k, w, m = [], [], []
            for j, own in enumerate(lists):
                masks: dict[int, int] = {}
                for i in own:
                    masks[i // 64] = masks.get(i // 64, 0) | 1 << i % 64
                for word, mask in masks.items():
                    k += s[:, j].tolist()
                    w += [word] * HASHES
                    m += [mask] * HASHES
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(w, pa.int32()), pa.array(np.array(m, np.uint64).view(np.int64))], ["k", "w", "m"])

    filled = have.mapInArrow(lean(place), "k bigint, w int, m bigint").groupBy("k", "w").agg(F.bit_or("m").alias("m"))
    got = filled.toArrow()  # a row for each slot at most: a bound that doesn't grow with the input
    masks = np.zeros((1 << bits, (len(langs) + 63) // 64), np.uint64)
    masks[got["k"].to_numpy(), got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
    return Filter(langs, masks)


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.masks))

    def run(batches):
        f = Filter(*sent.value)
        for b in batches:
            found = [f.predict(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id bigint, held_out boolean, lang_pred string, score double")


#: Of the coverage that all but 1 in 1000 training documents of a language reach, the part that a document must have.
KEEP = 0.5


def least_coverage(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """By language, the share of a text's n-grams that it must contain for the text to be taken as written in it."""
    if not model.langs:
        return {}
    chosen = _known(docs, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.masks))

    def run(batches):
        f = Filter(*sent.value)
        for b in batches:
            found = [(lang, y[2]) for lang, x in zip(b.column("lang").to_pylist(), b.column("text")) if (y := f.predict(x.as_py()))[0] == lang]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang", "covered"])

    got = chosen.mapInArrow(lean(run), "lang string, covered double").groupBy("lang").agg(F.percentile_approx("covered", 0.001, 10000).alias("least"))
    return {r["lang"]: KEEP * r["least"] for r in got.collect()}  # a row a language


def keep_known(docs: DataFrame, model: Filter, least: dict[str, float] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that are in no learned language, and with the language found where lang_col (if docs has it) is null.

    A row goes if it has no letter or n-gram of any language, or if the language found contains a smaller share of its
    n-grams than `least` asks for (see least_coverage): other languages, and junk.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.masks, least or {}))
    kept = docs.columns

    def run(batches):
        langs, masks, least = sent.value
        f = Filter(langs, masks)
        for b in batches:
            found = [f.predict(x.as_py()) for x in b.column(text_col)]
            keep = pa.array([x != UNKNOWN and s > 0 and c >= least.get(x, 0.0) for x, s, c in found], pa.bool_())
            cols = {c: b.column(c) for c in kept}
            if lang_col in cols:
                cols[lang_col] = pc.coalesce(cols[lang_col], pa.array([x[0] for x in found], cols[lang_col].type))
            yield pa.RecordBatch.from_arrays(list(cols.values()), kept).filter(keep)

    return docs.select(*kept).mapInArrow(lean(run), docs.schema)
