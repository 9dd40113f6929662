"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. Each level collapses runs of a symbol, gives each symbol a small label by deterministic
coin tossing against its left neighbour (the lowest bit in which they differ, and its value, four times over), and starts a
phrase at each local maximum of the labels; a phrase's name is a hash of what it holds and becomes a symbol of the next
level. A phrase depends on a few symbols to its left and one to its right only, so equal substrings get equal names inside,
wherever they stand. A document's phrases at the levels from FIRST on are its features; the fingerprint lists the SKETCH
smallest of their 32-bit hashes, and the likeness of two fingerprints is the bottom-k estimate of the Jaccard index.

Many texts are parsed in one go as one array in which no phrase crosses a text's border. Null counts as empty; an empty
text has an empty fingerprint, which is like another empty one (1) and unlike any other (0). No rows give no rows, equal rows
equal ones. A text of any length is parsed as a whole, at some ten bytes a code point. Columns besides id and text are not
looked at, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, released, stored

#: Names of a fingerprint; first and last level whose phrases are features (a level is about three times as coarse as the one before).
SKETCH, FIRST, LEVELS = 48, 3, 5
#: Code points that are parsed in one go, about.
CHUNK = 1 << 18
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _toss(v: np.ndarray, first: np.ndarray, times: int = 4) -> np.ndarray:
    """Labels under 8 such that neighbours within a text differ; v: symbols, neighbours differ; first: starts of texts."""
    for _ in range(times):
        d = np.empty_like(v)
        np.bitwise_xor(v[1:], v[:-1], out=d[1:])
        d[first] = 1
        low = np.bitwise_count((d & (~d + d.dtype.type(1))) - d.dtype.type(1))  # the number of zeros below the lowest bit that differs
        bit = (v >> low.astype(v.dtype)).astype(np.uint8) & np.uint8(1)
        v = (low << np.uint8(1)) | bit
    return v


_BASE = np.uint64(0x9E3779B97F4A7C55)


def level(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level and their texts, of symbols x of texts doc (ascending)."""
    start = np.empty(len(x), bool)
    start[0] = True
    border = doc[1:] != doc[:-1]
    np.not_equal(x[1:], x[:-1], out=start[1:])
    start[1:] |= border
    at = np.flatnonzero(start)
    s, doc = x[at], doc[at]
    more = np.flatnonzero(np.append(at[1:], len(x)) - at > 1)
    wide = s.astype(np.uint64)  # a run's symbol is its first one for the toss, and for the name a hash with its length
    if len(more):
        wide[more] = _mix(wide[more] + _GOLD * (np.append(at, len(x))[more + 1] - at[more]).astype(np.uint64))
    first = np.empty(len(s), bool)
    first[0] = True
    np.not_equal(doc[1:], doc[:-1], out=first[1:])
    label = _toss(s, np.flatnonzero(first))
    cut = first.copy()
    if len(s) > 2:
        cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:] & ~first[:-2]
    begin = np.flatnonzero(cut)
    size = np.diff(begin, append=len(s))
    wide += np.uint64(1)
    names = wide[begin]
    for k in range(1, int(size.max(initial=1))):  # polynomial hash of each phrase, member by member; phrases are short
        has = np.flatnonzero(size > k)
        names[has] = names[has] * _BASE + wide[begin[has] + k]
    return _mix(names + _GOLD * size.astype(np.uint64)), doc[begin]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text as ascending distinct uint32 hashes."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (n < CHUNK or hi == lo):
            n += len(texts[hi])
            hi += 1
        part = texts[lo:hi]
        if n:
            x = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            top = x.max()  # the width of the type changes no result
            x = x.astype(np.uint8 if top < 256 else np.uint16) if top < 65536 else x
            doc = np.repeat(np.arange(len(part), dtype=np.int32), [len(t) for t in part])
            names, docs = [], []
            for k in range(1, LEVELS + 1):
                x, doc = level(x, doc)
                if k >= FIRST:
                    names.append(_mix(x + np.uint64(k)) >> np.uint64(32))
                    docs.append(doc)
            key = np.unique((np.concatenate(docs).astype(np.uint64) << np.uint64(32)) | np.concatenate(names))
            of = (key >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(of, np.arange(len(part) + 1))
            values = key.astype(np.uint32)
            for i in range(len(part)):
                out[lo + i] = values[ends[i] : min(ends[i + 1], ends[i] + SKETCH)]
        lo = hi
    return out


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the SKETCH smallest hashes of both that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:][both[1:] == both[:-1]]
    union = both[np.concatenate(([True], both[1:] != both[:-1]))][:SKETCH]
    return float(np.searchsorted(same, union[-1], side="right") / len(union))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each whole text."""

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(written, sketches(texts)), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id bigint, n_chars bigint, fingerprint string")


_LEAST = -(1 << 63)
#: Bytes of text of a range, about; ranges at most; rows that tell where ranges end.
RANGE_BYTES, RANGES, SAMPLE = 8 << 20, 1 << 17, 200_000


def _bounds(keys: DataFrame, groups: int | None) -> list[tuple[int, int]]:
    """Keys (k, tie) at which ranges of about equal numbers of bytes begin, by a sample of the rows; the same on every run."""
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    groups = groups or min(RANGES, max(1, size // RANGE_BYTES))
    part = keys.where(F.pmod(F.xxhash64("k", "tie", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))
    got = part.toArrow()
    k, tie, weight = (got[c].to_numpy() for c in ("k", "tie", "bytes"))
    order = np.lexsort((tie, k))
    ends = np.cumsum(weight[order] + 64.0)
    at = np.searchsorted(ends, ends[-1] * np.arange(1, groups) / groups) if len(ends) else []
    return sorted({(int(k[order[i]]), int(tie[order[i]])) for i in at})


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None) -> DataFrame:
    """Each document against its text with the last quarter replaced by the start of the next document's, and against the next.

    Next is by ascending id (nulls first; rows of one id by a hash of their text), after the last comes the first. Ids and
    hashes are cut into ranges of about RANGE_BYTES, so rows of one id are many ranges too; a range's first row is sent to the
    range before it as well. So each text is shuffled once (compressed), equal rows of a batch as one, and no range needs
    another. No rows give no rows. A text of any length is held whole with the one before it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)).alias("k"), F.xxhash64(text).alias("tie"), F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    keys = stored(rows.select("k", "tie", F.octet_length("text").cast("bigint").alias("bytes")), "keys")
    bounds = _bounds(keys, groups)

    def least(batches):
        for b in batches:
            first: dict[int, tuple[int, int]] = {}
            for x in zip(b.column("k").to_pylist(), b.column("tie").to_pylist()):
                g = bisect.bisect_right(bounds, x)
                first[g] = min(first.get(g, x), x)
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int64()), pa.array([x[0] for x in first.values()], pa.int64()), pa.array([x[1] for x in first.values()], pa.int64())], ["g", "k", "tie"])

    # a row for each range: RANGES at most
    heads = keys.select("k", "tie").mapInArrow(lean(least), "g bigint, k bigint, tie bigint").groupBy("g").agg(F.min(F.struct("k", "tie")).alias("f")).orderBy("g").collect()
    heads = [(r["g"], (r["f"]["k"], r["f"]["tie"])) for r in heads]
    released(keys)
    before = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}  # the first key of a range: the range before it

    def parse(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            keys, texts = list(zip(b.column("k").to_pylist(), b.column("tie").to_pylist())), b.column("text").to_pylist()
            times = Counter(keys)
            one = list({x: i for i, x in enumerate(keys)}.values())  # equal rows are one with a number
            sketch = dict(zip(one, sketches([texts[i] for i in one])))
            extra = [i for i in one if keys[i] in before]
            take = one + extra
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*(bisect.bisect_right(bounds, keys[i]) for i in one), *(before[keys[i]] for i in extra)], pa.int64()), pa.array([False] * len(one) + [True] * len(extra)),
                    *(pa.array([keys[i][j] for i in take], pa.int64()) for j in (0, 1)), b.column("doc_id").take(pa.array(take, pa.int64())), pa.array([times[keys[i]] for i in take], pa.int64()),
                    pa.array([sketch[i].tobytes() for i in take], pa.binary()), pa.array([pack.compress(texts[i].encode()) for i in take], pa.binary()),
                ],
                ["g", "ahead", "k", "tie", "doc_id", "times", "sketch", "packed"],
            )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def edit(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        held, done, size, skip = None, [], 0, None  # held: id, key, number of equal rows, text, sketch

        def flush():
            new = sketches([x[1] for x in done])
            out = [[x[0] for x in done], [x[2] for x in done], [hashlib.sha256(x[1].encode()).hexdigest() for x in done], [written(x[3]) for x in done], list(map(written, new)), [likeness(x[3], y) for x, y in zip(done, new)], [likeness(x[3], x[4]) for x in done]]
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
            times = np.array([x[5] for x in done])
            if (times == 1).all():
                yield b
                return
            for lo in range(0, int(times.sum()), 10_000):  # equal rows again, some at a time
                yield b.take(pa.array(np.searchsorted(np.cumsum(times), np.arange(lo, min(lo + 10_000, int(times.sum()))), side="right")))

        def add(sketch, text, times):
            nonlocal size
            q = len(held[3]) // 4
            done.append((held[0], held[3][: len(held[3]) - q] + text[:q], len(held[3]), held[4], sketch, times))
            size += len(held[3])

        for b in batches:
            for g, ahead, k, tie, doc_id, times, sketch, packed in zip(*(b.column(c).to_pylist() for c in ("g", "ahead", "k", "tie", "doc_id", "times", "sketch", "packed"))):
                if g == skip:  # the same row from another batch
                    continue
                if held and not ahead and held[1] == (k, tie):  # equal rows of another batch
                    held = (*held[:2], held[2] + times, *held[3:])
                    continue
                text, sketch = unpack.decompress(packed).decode() if packed else "", np.frombuffer(sketch, np.uint32)
                if held:
                    if held[2] > 1:
                        add(held[4], held[3], held[2] - 1)
                    add(sketch, text, 1)
                    if size >= CHUNK:
                        yield from flush()
                        done, size = [], 0
                held = None if ahead else (doc_id, (k, tie), times, text, sketch)
                skip = g if ahead else None
        if done:
            yield from flush()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(heads))
    sent = rows.mapInArrow(lean(parse), "g bigint, ahead boolean, k bigint, tie bigint, doc_id bigint, times bigint, sketch binary, packed binary")
    ranged = sent.repartition(parts, "g").sortWithinPartitions("g", "ahead", "k", "tie")
    return ranged.mapInArrow(lean(edit), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
