"""Removal of long repeats by recompression.

Words are symbols named by their hash. A round first replaces runs of one symbol, then pairs (a, b) for which a's name tosses
left and b's tosses right, by new symbols named by a hash of what they replace. Names depend on content only, so they are
global: wherever equal words stand, the same symbols arise inside, in every document and on every executor, without
exchanging names. Each symbol carries the range of words on which its existence depends. A symbol whose range lies within a
window of WINDOW words is interior to it, and equal windows have equal interior symbols of every round at equal places.

A window is filed under an interior symbol of the highest round that it has any of: the one of the least name hash; its name
there is a hash of all words of its range (a dozen or more), so texts that only share phrases don't meet. Consecutive windows
filed under one occurrence are one run. Then Spark goes from coarse to fine:

1. Names are counted over all texts; only windows under a name that occurs twice can repeat.
2. Runs under such names are written down, with their distinct spans (all words that the windows of a run cover). Spans of a
   name meet; a span that occurs twice repeats as a whole, else the windows of the name's spans are compared word by word.
   Names with more runs than a quarter of a task's share are hot: their windows are dealt out and counted one by one, by
   hashes of 128 bits.
3. Spans that hold repeats are joined back to their places, and words under a repeated window go.

Counts, spans and windows are combined before they are shuffled, so a passage that a third of all documents share is a few
rows for each task, and the join back is one that Spark can split. Between steps executors pick by a bit map of name hashes
with 32 bits for each shared name, up to 2^MOST_BITS bits; its false hits only make more rows, no result changes.

Null and empty texts have no words; no rows give no rows; equal rows repeat each other, and one text may repeat itself. A text
of any length is parsed as a whole, at about a hundred bytes a word. Columns besides id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, released, stored, tidy

WINDOW, ROUNDS = 35, 3
MOST_BITS = 30
#: Runs of a hot name, at least.
HOT_LEAST = 256
#: Texts with repeats, by their keys, that are broadcast at most; beyond that all texts meet them by an exchange.
BROADCAST = 200_000
#: Words that are parsed in one go, about.
CHUNK = 1 << 16
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def parse(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """Symbols after 0, 1, ... rounds: names, first words, and the range [lo, hi) of words that each depends on.

    words: hashes; doc: their documents, ascending. What depends on a document's border gets a range that leaves it.
    """
    n = len(words)
    x, at = words, np.arange(n)
    lo, hi, d = at.copy(), at + 1, doc
    out = [(x, at, lo, hi)]

    def beside():
        first = np.empty(len(x), bool)
        first[0] = True
        np.not_equal(d[1:], d[:-1], out=first[1:])
        last = np.append(first[1:], True)
        left = np.where(first, at - 1, np.append(lo[:1], lo[:-1]))
        right = np.where(last, np.append(at[1:], n) + 1, np.append(hi[1:], n + 1))
        return first, last, left, right

    for turn in range(rounds):
        first, last, left, right = beside()
        start = first.copy()
        start[1:] |= x[1:] != x[:-1]
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(x))
        names, more = x[s], np.flatnonzero(e - s > 1)
        names[more] = _mix(names[more] ^ (_GOLD * (e[more] - s[more]).astype(np.uint64)))
        lo, hi = np.minimum(left[s], lo[s]), np.maximum(right[e - 1], hi[e - 1])
        x, at, d = names, at[s], d[s]
        first, last, left, right = beside()
        side = (_mix(x + np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
        pair = ~last
        pair[:-1] &= side[:-1] & ~side[1:]
        second = np.append(False, pair[:-1])
        single = ~pair & ~second
        a = np.flatnonzero(pair)
        lo2, hi2, names = np.where(single, np.minimum(left, lo), lo), np.where(single, np.maximum(right, hi), hi), x.copy()
        names[a] = _mix(_mix(x[a]) * _M2 + x[a + 1] + np.uint64(turn))
        hi2[a] = hi[a + 1]
        keep = ~second
        x, at, lo, hi, d = names[keep], at[keep], lo2[keep], hi2[keep], d[keep]
        out.append((x, at, lo, hi))
    return out


def _least(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first least key in each [a, b), none empty; by a table of minima over powers of two."""
    best = [np.arange(len(key))]
    longest = int((b - a).max(initial=1))
    while (1 << len(best)) <= longest:
        p, w = best[-1], 1 << (len(best) - 1)
        if len(p) <= w:
            break
        best.append(np.where(key[p[w:]] < key[p[:-w]], p[w:], p[:-w]))
    k = np.frexp((b - a).astype(float))[1] - 1
    out = np.empty(len(a), np.int64)
    for j in np.unique(k):
        i = np.flatnonzero(k == j)
        p, q = best[j][a[i]], best[j][b[i] - (1 << int(j))]
        out[i] = np.where(key[q] < key[p], q, p)
    return out


class Windows:
    """The windows of some documents and the runs of them that are filed under one symbol."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
        doc = np.repeat(np.arange(len(lengths)), lengths)
        self.first = np.cumsum(lengths) - lengths
        self.window, n = window, len(words)
        s = np.flatnonzero(doc[: max(0, n - window + 1)] == doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
        self.powers = []
        for base in _BASES:  # hash of words [i, j): (sum[j] - sum[i]) times the inverse of base^i
            p = np.cumprod(np.full(n + 1, base | np.uint64(1), np.uint64))
            inv = np.uint64(pow(int(base | np.uint64(1)), -1, 1 << 64))
            self.powers.append((np.concatenate(([np.uint64(0)], np.cumsum(_mix(words ^ base) * p[:-1]))) if n else np.zeros(1, np.uint64), np.cumprod(np.full(n + 1, inv, np.uint64))))
        if not len(s):
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.name = np.zeros(0, np.uint64)
            self.offset = self.start
            return
        place, name = np.empty(len(s), np.int64), np.empty(len(s), np.uint64)
        rest = np.arange(len(s))
        for x, at, lo, hi in reversed(parse(words, doc, rounds)):  # round 0 has an interior symbol in every window
            a = np.searchsorted(lo, s[rest], side="left")
            b = np.searchsorted(hi, s[rest] + window, side="right")
            some = b > a
            if some.any():
                k = _least(_mix(x ^ _GOLD), a[some], b[some])
                place[rest[some]], name[rest[some]] = at[k], self.hashes(lo[k], hi[k])[0]
            rest = rest[~some]
            if not len(rest):
                break
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1] + 1) | (place[1:] != place[:-1]) | (name[1:] != name[:-1])
        r = np.flatnonzero(new)
        self.start, self.count, self.name, self.doc = s[r], np.diff(r, append=len(s)), name[r], doc[s[r]]
        self.offset = place[r] - s[r]

    def hashes(self, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of the words [i, j)."""
        return [_mix((sums[j] - sums[i]) * inverse[i]) for sums, inverse in self.powers]

    def spans(self, r: np.ndarray) -> list[np.ndarray]:
        """Two hashes of all words that the windows of runs r cover, with the run's shape."""
        shape = (self.count[r] * 64 + self.offset[r]).astype(np.uint64)
        return [_mix(h + shape * _GOLD) for h in self.hashes(self.start[r], self.start[r] + self.count[r] - 1 + self.window)]


def split_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (U+0009 to U+000D and the space)."""
    return text.split()


def _chunks(batch: pa.RecordBatch):
    """(first row, words of each row, word hashes, numbers of words) of parts of a batch."""
    import xxhash

    at, words, n = 0, [], 0
    for i, t in enumerate(pc.cast(batch.column("text"), pa.binary())):
        w = split_words(t.as_py() or b"")
        words.append(w)
        n += len(w)
        if n >= CHUNK or i + 1 == batch.num_rows:
            h = np.fromiter((y for x in words for y in map(xxhash.xxh64_intdigest, x, repeat(7))), np.uint64, n)
            yield at, words, h, np.array(list(map(len, words)), np.int64)
            at, words, n = i + 1, [], 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _map(names: DataFrame, bits: int) -> bytes:
    """Bit map of pmod(name, 2^bits): 2^bits bits in all, whatever the number of names."""
    at = F.pmod("name", F.lit(1 << bits)) + 1
    whole = bytearray((1 << bits) // 8)
    for r in names.select(at.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect():
        whole[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(r["m"])] = r["m"][: max(0, len(whole) - (r["b"] - 1) * 4096)]
    return bytes(whole)


def _hit(table: np.ndarray, names: np.ndarray, bits: int) -> np.ndarray:
    h = names & np.uint64((1 << bits) - 1)
    return (table[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _repeated(spans: list[tuple[int, bytes]], window: int) -> list[int]:
    """For each distinct span of one name (times that it occurs, its words) the mask of its windows that occur twice, by their words."""
    if len(spans) == 1:
        n, words = spans[0]
        return [(1 << (words.count(b" ") + 2 - window)) - 1 if n > 1 else 0]
    each = []
    for n, words in spans:
        w = words.split(b" ")
        each.append([b" ".join(w[i : i + window]) for i in range(len(w) - window + 1)])
    times: Counter = Counter()
    for (n, _), windows in zip(spans, each):
        for x in windows:
            times[x] += n
    return [sum(1 << i for i, x in enumerate(windows) if times[x] > 1) for windows in each]


_RUNS = "kind int, name bigint, c1 bigint, c2 bigint, n bigint, words binary, doc_id bigint, th bigint, start bigint"
_PLACE, _SPAN, _WINDOW, _OF_SPAN = range(4)


def repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, th, start, mask): window start + i (by first word) stands elsewhere too if bit i is set; th: a hash of the row's text.

    docs: doc_id, text. A row's repeats are those of its text, so equal rows have equal repeats. Windows are of 63 words at most.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def names(batches):
        for b in batches:
            for _, _, h, n in _chunks(b):
                u, c = np.unique(Windows(h, n, window, rounds).name, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(u), pa.array(c.astype(np.int64))], ["name", "n"])

    shared = stored(docs.select("text").mapInArrow(lean(names), "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1"), "names")
    n_names, n_runs = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(most_bits, max(20, int(32 * n_names + 1).bit_length()))
    # no more than 4 x parts names can be hot
    hot = sorted(r["name"] for r in shared.where(F.col("n") >= max(HOT_LEAST, n_runs // (4 * parts))).select("name").collect())
    sent = spark.sparkContext.broadcast((_map(shared, bits), np.array(hot, np.int64).view(np.uint64)))
    released(shared)
    tidy(spark)

    def runs(batches):
        table, hot_names = np.frombuffer(sent.value[0], np.uint8), sent.value[1]
        for b in batches:
            for at, words, h, n in _chunks(b):
                w = Windows(h, n, window, rounds)
                r = np.flatnonzero(_hit(table, w.name, bits))
                if not len(r):
                    continue
                c1, c2 = w.spans(r)
                take = pa.array(at + w.doc[r])
                yield _rows(_PLACE, len(r), c1=_signed(c1), c2=_signed(c2), doc_id=b.column("doc_id").take(take), th=b.column("th").take(take), start=pa.array((w.start[r] - w.first[w.doc[r]]).astype(np.int64)))
                _, one, copies = np.unique(np.stack([c1, c2], 1), axis=0, return_index=True, return_counts=True)
                r, c1, c2 = r[one], c1[one], c2[one]
                is_hot = np.isin(w.name[r], hot_names)
                cool = np.flatnonzero(~is_hot)
                at_doc, first = w.doc[r[cool]], w.start[r[cool]] - w.first[w.doc[r[cool]]]
                text = [b" ".join(words[d][i : i + k]) for d, i, k in zip(at_doc, first, w.count[r[cool]] - 1 + window)]
                yield _rows(_SPAN, len(cool), name=_signed(w.name[r[cool]]), c1=_signed(c1[cool]), c2=_signed(c2[cool]), n=pa.array(copies[cool].astype(np.int64)), words=pa.array(text, pa.binary()))
                warm = np.flatnonzero(is_hot)
                if len(warm):
                    count = w.count[r[warm]]
                    ends = np.cumsum(count)
                    s = np.repeat(w.start[r[warm]] - ends + count, count) + np.arange(count.sum())
                    h1, h2 = w.hashes(s, s + window)
                    bit = s - np.repeat(w.start[r[warm]], count)
                    yield _rows(_OF_SPAN, len(s), name=_signed(h1), doc_id=_signed(h2), c1=_signed(np.repeat(c1[warm], count)), c2=_signed(np.repeat(c2[warm], count)), n=pa.array(bit))
                    u, back = np.unique(np.stack([h1, h2], 1), axis=0, return_inverse=True)
                    times = np.bincount(back.ravel(), np.repeat(copies[warm], count)).astype(np.int64)
                    yield _rows(_WINDOW, len(u), c1=_signed(u[:, 0]), c2=_signed(u[:, 1]), n=pa.array(times))

    def compare(batches):
        held: pa.Table | None = None

        def found(t: pa.Table) -> pa.RecordBatch:
            name, c1, c2, n = (t[c].to_numpy() for c in ("name", "c1", "c2", "n"))
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
            at = np.flatnonzero(new)
            n, text = np.add.reduceat(n, at), t["words"].take(pa.array(at)).to_pylist()
            groups = np.flatnonzero(np.concatenate(([True], name[at][1:] != name[at][:-1], [True])))
            mask = np.array([m for lo, hi in zip(groups, groups[1:]) for m in _repeated(list(zip(n[lo:hi].tolist(), text[lo:hi])), window)], np.int64)
            some = mask != 0
            return pa.RecordBatch.from_arrays([pa.array(c1[at][some]), pa.array(c2[at][some]), pa.array(mask[some])], ["c1", "c2", "mask"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            name = t["name"].to_numpy()
            cut = int(np.searchsorted(name, name[-1]))  # the last name may go on
            held = t.slice(cut)
            if cut:
                yield found(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield found(held)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    seen = stored(keyed.mapInArrow(lean(runs), _RUNS), "runs")
    spans = seen.where(F.col("kind") == _SPAN).select("name", "c1", "c2", "n", "words")
    masks = spans.repartition(parts, "name").sortWithinPartitions("name", "c1", "c2").mapInArrow(lean(compare), "c1 bigint, c2 bigint, mask bigint")
    if hot:
        often = seen.where(F.col("kind") == _WINDOW).groupBy(F.col("c1").alias("name"), F.col("c2").alias("doc_id")).agg(F.sum("n").alias("times")).where("times > 1")
        own = seen.where(F.col("kind") == _OF_SPAN).select("name", "doc_id", "c1", "c2", "n").distinct()
        masks = masks.unionByName(own.join(often, ["name", "doc_id"]).groupBy("c1", "c2").agg(F.expr("bit_or(shiftleft(1L, CAST(n AS INT)))").alias("mask")))
    masks = stored(masks, "masks")
    tidy(spark)
    places = seen.where(F.col("kind") == _PLACE).select("c1", "c2", "doc_id", "th", "start")
    out = stored(places.join(masks, ["c1", "c2"]).select("doc_id", "th", "start", "mask"), "found")
    released(seen, masks)
    tidy(spark)
    return out


_TYPES = {"kind": pa.int32(), "words": pa.binary()}


def _rows(kind: int, size: int, /, **columns: pa.Array) -> pa.RecordBatch:
    """`size` rows of _RUNS; columns that aren't given are null."""
    fields = [x.split()[0] for x in _RUNS.split(", ")]
    columns["kind"] = pa.array(np.full(size, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(size, _TYPES.get(f, pa.int64())) for f in fields], fields)


def _covered(n: int, ranges, window: int) -> np.ndarray:
    """Which of n words the windows given by (start, mask) pairs cover."""
    edge = np.zeros(n + 1, np.int64)
    if ranges:
        r = np.array(ranges, np.int64).reshape(-1, 2)
        s = (r[:, :1] + np.arange(window))[(r[:, 1:] >> np.arange(window)) & 1 == 1]
        np.add.at(edge, s, 1)
        np.add.at(edge, s + window, -1)
    return np.cumsum(edge)[:n] > 0


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space) of each row.

    A row with no repeats keeps all its words; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = repeats(rows, window, rounds, most_bits)
    # a text has fewer runs than words
    found = at.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "mask")).alias("r"))
    found = stored(found.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), F.expr("flatten(transform(r, x -> array(x.start, x.mask)))").alias("ranges")), "repeats")
    released(at)
    tidy(docs.sparkSession)

    def cut(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t, r in zip(pc.cast(b.column("text"), pa.binary()), b.column("ranges")):
                words = split_words(t.as_py() or b"")
                gone = _covered(len(words), r.as_py(), window)
                n = int(gone.sum())
                kept = b" ".join(words) if not n else b" ".join([words[i] for i in np.flatnonzero(~gone)])
                for c, v in zip(out, (len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    keyed = rows.withColumn("th", F.xxhash64("text"))
    same = keyed.doc_id.eqNullSafe(found.r_id) & (keyed.th == found.r_th)
    if found.count() > BROADCAST:
        both = keyed.join(found, same, "left").select("doc_id", "text", "ranges")
    else:  # texts without repeats stay where they are
        side = F.broadcast(found.select("r_id", "r_th"))
        free = keyed.join(side, same, "left_anti").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("ranges"))
        both = free.unionByName(keyed.join(side, same, "left_semi").join(found, same).select("doc_id", "text", "ranges"))
    return both.mapInArrow(lean(cut), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
