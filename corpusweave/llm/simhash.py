"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most two bits are cut into two segments of 32: by the pigeonhole principle one
segment differs in at most one bit. So each distinct fingerprint is indexed under 2 x 32 signatures (one segment, one of
its bits left out) and equal signatures are joined and verified. Signatures with more than BUCKET fingerprints are never
paired; their members get a second signature each, such that all that share it are within two bits of each other: the
other segment with one bit left out as well (one difference in each), or one segment equal and two bits of the other left
out (two in one). Links to the least member of such a bucket keep every component whole without pairs.

Exact copies and equal fingerprints are one node, so a large group of copies costs one row for each document.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, released, stored, tidy

#: Fingerprints of a signature that are compared pair by pair.
BUCKET = 48
WIDTH = 3
#: Fingerprints of a sample that tells which signatures are hot, and the share (1 / HOT) of it that makes one so.
SAMPLE, HOT = 1 << 14, 64


def simhash(text: bytes, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of `width` words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return int(_majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)))


def _majority(h: np.ndarray) -> np.uint64:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 240):
        bits = np.unpackbits(h[k : k + 240, None].view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)  # 240 bits fit
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp bigint) of each whole text; null counts as empty, whose fingerprint is zero."""

    def run(batches):
        for b in batches:
            texts = pc.cast(b.column("text"), pa.binary())
            fp = np.fromiter((simhash(x.as_py() or b"", width) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id bigint, fp bigint")


_SEGMENT = "(CASE WHEN w >= 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END)"
_OTHER = "(CASE WHEN w >= 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END)"
_SIGNATURE = f"shiftleft(CAST(w AS BIGINT), 32) | ({_SEGMENT} & ~shiftleft(1L, w % 32))"


def _hot(keyed: DataFrame, n: int) -> list[int]:
    """Signatures that at least 1 / HOT of a sample of about SAMPLE fingerprints have: at most 64 x HOT of them."""
    part = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))
    least = max(BUCKET + 1, min(n, SAMPLE) // HOT)
    return [r["sig"] for r in part.groupBy(F.expr(_SIGNATURE).alias("sig")).agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()]


def _pairs_of(sig: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within two bits of equal signatures (ascending, whole); each pair under one signature only."""
    a, b = [], []
    size = np.diff(np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True]))))
    for k in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(sig[k:] == sig[:-k])
        x, y = fp[i], fp[i + k]
        bit, low = sig[i] >> np.uint64(32), (x ^ y)
        differs = np.where(bit >= 32, low >> np.uint64(32), low & np.uint64(0xFFFFFFFF))
        bit = bit % np.uint64(32)
        # taken where the left-out bit is the one that differs in the segment, or is the segment's first and none differs
        own = (differs == np.uint64(1) << bit) | ((differs == 0) & (bit == 0))
        own &= np.bitwise_count(low) <= 2
        a.append(x[own])
        b.append(y[own])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def links(fps: DataFrame, n: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that give the n distinct fingerprints fp the same components as all pairs within two bits.

    One exchange deals fingerprints out by signature; a task walks its sorted signatures and holds `bucket` members at most.
    """
    spark = fps.sparkSession
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w"))
    hot = _hot(keyed, n)
    hot_sigs = spark.createDataFrame([(x,) for x in hot], "hot bigint")
    rest = keyed
    if hot:  # known beforehand to be large: they need not meet at all
        rest = keyed.join(F.broadcast(hot_sigs), F.expr(_SIGNATURE) == F.col("hot"), "left_anti")

    def walk(batches):
        held, large = (np.zeros(0, np.uint64), np.zeros(0, np.uint64)), None
        for batch in batches:
            w, fp = batch.column("w").to_numpy().astype(np.uint64), batch.column("fp").to_numpy().view(np.uint64)
            part = np.where(w >= 32, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
            sig = (w << np.uint64(32)) | (part & ~(np.uint64(1) << (w % np.uint64(32))))
            if large is not None:
                more = int(np.argmax(np.append(sig != large, True)))
                yield batch_of(more=(sig[:more], fp[:more]))
                sig, fp = sig[more:], fp[more:]
                large = large if not len(sig) else None
            sig, fp = np.concatenate((held[0], sig)), np.concatenate((held[1], fp))
            if not len(sig):
                continue
            new = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            cut = int(new[-1])  # the last signature may go on
            yield from whole(sig[:cut], fp[:cut])
            held = (sig[cut:], fp[cut:])
            if len(held[0]) > bucket:
                yield batch_of(more=held)
                large, held = held[0][0], (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        yield from whole(*held)

    def whole(sig: np.ndarray, fp: np.ndarray):
        if not len(sig):
            return
        new = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(new, append=len(sig))
        many = np.repeat(size > bucket, size)
        few = np.repeat(size > 1, size) & ~many
        yield batch_of(_pairs_of(sig[few], fp[few]), (sig[many], fp[many]))

    def batch_of(pairs=None, more=None) -> pa.RecordBatch:
        a, b = pairs or (np.zeros(0, np.uint64),) * 2
        sig, fp = more or (np.zeros(0, np.uint64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([False, True], [len(a), len(sig)])), _signed(np.concatenate((a, sig))), _signed(np.concatenate((b, fp)))], ["large", "a", "b"])

    sig = F.expr(_SIGNATURE)
    dealt = rest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), sig).sortWithinPartitions(sig)
    found = stored(dealt.mapInArrow(lean(walk), "large boolean, a bigint, b bigint"), "signatures")
    del dealt
    tidy(spark)
    two = found.where("not large").select("a", "b")
    large = found.where("large").select(F.col("a").alias("sig"), F.col("b").alias("fp"))
    if hot:
        large = large.unionByName(keyed.join(F.broadcast(hot_sigs), F.expr(_SIGNATURE) == F.col("hot")).select(F.col("hot").alias("sig"), "fp"))
    large = large.withColumn("w", F.expr("CAST(shiftrightunsigned(sig, 32) AS INT)"))
    one = large.select("fp", "sig", F.expr(_OTHER).alias("o"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    one = one.select("fp", "sig", F.expr("shiftleft(CAST(i AS BIGINT), 32) | (o & ~shiftleft(1L, i))").alias("key"))
    pairs = F.array(*(F.lit((1 << i) | (1 << j)).cast("bigint") for i in range(32) for j in range(i)))
    same = large.where("w % 32 = 0").select("fp", F.expr(f"shiftleft(CAST(w AS BIGINT), 33) | {_SEGMENT}").alias("sig"), F.expr(_OTHER).alias("o"), F.explode(pairs).alias("m"))
    same = same.select("fp", F.expr("-1L - sig").alias("sig"), F.expr("shiftleft(m, 0) | 0L").alias("m"), F.expr("o & ~m").alias("o"))

    def star(df: DataFrame, *key: str) -> DataFrame:
        least = df.groupBy(*key).agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select(*key, "a")
        return df.join(least, list(key)).where("fp <> a").select("a", F.col("fp").alias("b"))

    return two.unionByName(star(one, "sig", "key")).unionByName(star(same, "sig", "m", "o"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of two or fewer differing bits reach.

    No rows give no rows; rows of an equal doc_id each keep a row; a null doc_id is never a component's id unless all are null.
    Null and empty texts have the fingerprint zero; a text of any length is one row and costs eight bytes a shingle of its own.
    Columns of docs besides the two are not looked at, so their names may clash with anything.
    """
    spark = docs.sparkSession
    fp = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    edges = stored(links(nodes.select("fp"), nodes.count(), bucket), "links")
    tidy(spark)
    roots = connected_components(edges).select(F.col("node").alias("fp"), "root")
    named = stored(nodes.join(roots, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "roots")
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    last = stored(named.select("fp", "root").join(ids, "root").select("fp", "component_id"), "named")
    released(edges, nodes, named)
    return fp.join(last, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity.

#: Words of a shingle and the least Jaccard index of two near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Segments of a text's min-hash fingerprint and minima of each. Two texts at 0.8 agree in all but one minimum of a segment with a
#: probability of 0.8^5 + 5 x 0.2 x 0.8^4 = 0.737, so in none of the segments with one of 4e-7.
SEGMENTS, MINIMA = 11, 5
#: Rows that are broadcast at most to pick texts out; beyond that they meet by an exchange.
BROADCAST = 200_000
#: Groups of hashes by which shingles are counted, first and at last; members of a block and of a tile of it that meet at once.
COARSE, GROUPS, BLOCK, TILE = 32, 256, 2048, 512

_SEEDS = np.random.default_rng(5).integers(0, 1 << 64, (2, SEGMENTS * MINIMA, 1), np.uint64, endpoint=False) | np.uint64(1)


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `width` words (of the whole text if it is shorter); none without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def deletion_signatures(h: np.ndarray) -> np.ndarray:
    """For each segment of the min-hash fingerprint of a set of hashes, its variants with one minimum left out."""
    low = np.empty(SEGMENTS * MINIMA, np.uint64)
    step = max(1, (1 << 17) // len(h))
    for k in range(0, len(low), step):
        low[k : k + step] = ((h ^ _SEEDS[0, k : k + step]) * _SEEDS[1, k : k + step]).min(axis=1)
    low = low.reshape(SEGMENTS, MINIMA)
    out = np.arange(1, SEGMENTS * MINIMA + 1, dtype=np.uint64).reshape(SEGMENTS, MINIMA)
    for k in range(MINIMA):
        left_out = np.arange(MINIMA) == k
        more = (out ^ low[:, k : k + 1]) * np.uint64(0x9E3779B97F4A7C15)
        out = np.where(left_out, out, more ^ (more >> np.uint64(29)))
    return out.ravel()


_ALIKE = "least(n, m) >= {s} * greatest(n, m) - 1e-9"


def _meet(batches, similar: float, bucket: int):
    """Of (sig, id, n) sorted by sig and id: each member with the first of its signature, all pairs of up to 3, and members of those over 3.

    Yields (member, x, y, n): pairs (False, a, b, 0) and members (True, sig, id, n). Holds `bucket` rows and a batch at most.
    """
    held, large = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)], None

    def out(sig, ids, n, first, before, again):
        pairs = []
        for i, use in ((first, True), (before, ~again)):
            near = np.minimum(n, n[i]) >= similar * np.maximum(n, n[i]) - 1e-9
            near &= (ids != ids[i]) & use
            pairs.append(np.stack([np.minimum(ids, ids[i]), np.maximum(ids, ids[i])])[:, near])
        x, y = np.unique(np.concatenate(pairs, axis=1), axis=1) if len(ids) else np.zeros((2, 0), np.int64)
        member = np.repeat([False, True], [len(x), int(again.sum())])
        return pa.RecordBatch.from_arrays([pa.array(member), pa.array(np.concatenate((x, sig[again]))), pa.array(np.concatenate((y, ids[again]))), pa.array(np.concatenate((np.zeros(len(x), np.int32), n[again])))], ["member", "x", "y", "n"])

    def whole(sig, ids, n):
        begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(begin, append=len(sig))
        some = np.repeat(size > 1, size)
        first, at = np.repeat(begin, size)[some], np.flatnonzero(some)
        sig, ids, n, more = sig[some], ids[some], n[some], np.repeat(size > 3, size)[some]
        back = np.cumsum(some) - 1
        first = back[first]
        return out(sig, ids, n, first, np.maximum(first, np.arange(len(at)) - 1), more)

    for b in batches:
        now = [b.column(c).to_numpy() for c in ("sig", "id", "n")]
        if large is not None:  # its first row stands before what follows
            k = int(np.argmax(np.append(now[0] != large[0][0], True)))
            part = [np.concatenate((x, y[:k])) for x, y in zip(large, now)]
            if k:
                at = np.arange(len(part[0]))
                yield out(*part, np.zeros(len(at), np.int64), at, at > 0)
            now = [x[k:] for x in now]
            large = large if not len(now[0]) else None
        held = [np.concatenate(x) for x in zip(held, now)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last signature may go on
        if cut:
            yield whole(*(x[:cut] for x in held))
        held = [x[cut:] for x in held]
        if len(held[0]) > bucket:
            yield whole(*held)
            large = [x[:1] for x in held]
            held = [x[:0] for x in held]
    if len(held[0]):
        yield whole(*held)


class _Texts:
    """The shingle sets of single documents, read from the texts of docs when they are asked for."""

    def __init__(self, keyed: DataFrame, nodes: DataFrame, similar: float):
        self.keyed, self.nodes, self.similar = keyed, nodes, similar

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, words array<bigint>) of the ids given, each once."""

        def read(batches):
            for b in batches:
                sets = [shingle_set(x.as_py()).view(np.int64) for x in pc.cast(b.column("text"), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "words"])

        own = stored(self.nodes.select("id", "t1", "t2").join(ids, "id").withColumnRenamed("id", "doc_id"), "asked")
        side = F.broadcast(own) if own.count() <= BROADCAST else own
        texts = self.keyed.join(side, ["doc_id", "t1", "t2"]).dropDuplicates(["doc_id", "t1", "t2"]).select(F.col("doc_id").alias("id"), "text")
        out = stored(texts.mapInArrow(lean(read), "id bigint, words array<bigint>"), "sets")
        released(own)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) of ids whose sets have a Jaccard index of `similar` or more, by the sets themselves."""
        sets = self.sets(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        x, y = (sets.select(F.col("id").alias(k), F.col("words").alias(w)) for k, w in (("a", "x"), ("b", "y")))
        both = F.size(F.array_intersect("x", "y"))
        close = both >= self.similar * (F.size("x") + F.size("y") - both) - 1e-9
        out = stored(pairs.join(y, "b").join(x, "a").where(close).select("a", "b"), "links")
        released(sets)
        tidy(pairs.sparkSession)
        return out


def _within(x: tuple, y: tuple | None, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of unlike roots of two blocks (one with itself if y is None) that may be alike.

    A block: ids, sizes, roots and (rows, GROUPS) counts of a set's shingles by groups of hashes. Sets of n and m meet only by an
    overlap of s / (1 + s) (n + m), and the overlap is at most the sum of the smaller counts: first over COARSE groups, all
    pairs at once, then over all groups for what is left.
    """
    least, found = similar / (1 + similar), []
    blocks = []
    for b in (x,) if y is None else (x, y):
        order = np.argsort(b[1], kind="stable")
        ids, n, roots, own = (c[order] for c in b)
        kind = np.uint16 if not len(n) or n[-1] < 1 << 16 else np.int64
        blocks.append((ids, n.astype(np.int64), roots, own, own.reshape(len(own), COARSE, -1).sum(axis=2).T.astype(kind)))
    (ids, n, roots, own, few), (ids2, n2, roots2, own2, few2) = blocks[0], blocks[-1]
    for i in range(0, len(ids), TILE):
        at = slice(i, i + TILE)
        for j in range(i if y is None else 0, len(ids2), TILE):
            to = slice(j, j + TILE)
            if max(n[at][0], n2[to][0]) * similar > min(n[at][-1], n2[to][-1]) + 1e-6:  # no sizes that fit
                continue
            most = np.zeros((len(ids[at]), len(ids2[to])), np.result_type(few, few2))
            for g in range(COARSE):
                most += np.minimum(few[g, at][:, None], few2[g, to])
            need = least * (n[at][:, None] + n2[to]) - 1e-6
            a, b = np.nonzero((most >= need) & (roots[at][:, None] != roots2[to]))
            if y is None and i == j:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 1 << 14):
                p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                ok = np.minimum(own[at][p], own2[to][q]).sum(axis=1, dtype=np.int64) >= need[p, q]
                found.append(np.stack((ids[at][p[ok]], ids2[to][q[ok]])))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs.min(axis=0), pairs.max(axis=0)


def _by_blocks(members: DataFrame, texts: _Texts) -> DataFrame:
    """Pairs (a, b) of unlike roots that may be alike among members (sig, id, n, root, size) of one signature: all of them.

    A signature's members are dealt out in blocks of about BLOCK by a hash, and each two blocks meet in a group of their own, which holds
    counts by groups of hashes (see _within) and no texts. So no signature lands in one task, whatever its size.
    """
    similar = texts.similar
    sets = texts.sets(members.select("id").distinct())

    def count(batches):
        for b in batches:
            ends, words = b.column("words").offsets.to_numpy(), b.column("words").values.to_numpy()
            own = [np.bincount(words[i:j] & (GROUPS - 1), minlength=GROUPS) for i, j in zip(ends, ends[1:])]
            own = [x.astype(np.uint8 if x.max() < 256 else np.int32).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.binary())], ["id", "own"])

    def meet(key, table):
        own = [np.frombuffer(x, np.uint8 if len(x) == GROUPS else np.int32) for x in table.column("own").to_pylist()]
        cols = (*(table.column(c).to_numpy() for c in ("id", "n", "root")), np.stack(own))
        block, (lo, hi) = table.column("block").to_numpy(), (k.as_py() for k in key[1:])
        sides = [tuple(c[block == k] for c in cols) for k in dict.fromkeys((lo, hi))]
        a, b = _within(sides[0], sides[1] if lo < hi else None, similar) if all(len(x[0]) for x in sides) else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    counts = stored(sets.mapInArrow(lean(count), "id bigint, own binary"), "counts")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.join(counts, "id").select("sig", "id", "n", "root", "own", blocks.alias("of"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    pairs = dealt.select("sig", "lo", "hi", "id", "n", "root", "own", "block").groupBy("sig", "lo", "hi").applyInArrow(meet, "a bigint, b bigint")
    out = stored(pairs.distinct(), "rare")
    released(sets, counts)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, component_id) of documents whose five-word shingles are alike to `similar` or more, chains included.

    Deletion-variant signatures as above, but of a min-hash fingerprint: SimHash bits of two texts at 0.8 differ in about ten
    places of 64, too many for two segments. A fingerprint is SEGMENTS segments of MINIMA minima; each is indexed under its
    variants with one minimum left out, equal signatures meet, and every candidate is verified by the exact Jaccard index of
    the two sets (of 64-bit hashes). Equal texts are one node. Members of a signature first meet its first member only; then,
    once what these link is known, pairs that are still apart: all of them in signatures of up to `bucket` members, and in
    larger ones a member of the component that most are in, and at last all by their rare shingles.
    So copies make no pairs, and unlike texts of one signature none but those that share something rare.

    Texts without words, and null, are like none but their equals. Null ids take no part unless an equal text has an id.
    """
    spark = docs.sparkSession

    def run(batches):
        for b in batches:
            f = [shingle_set(x.as_py()) for x in pc.cast(b.column("text"), pa.binary())]
            sigs = [deletion_signatures(h).view(np.int64) if len(h) else None for h in f]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array([len(h) for h in f], pa.int32()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "n", "sigs"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))
    rows = stored(keyed.mapInArrow(lean(run), "doc_id bigint, t1 bigint, t2 bigint, n int, sigs array<bigint>"), "near")
    nodes = stored(rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sigs").alias("sigs")), "nodes")
    tidy(spark)
    texts = _Texts(keyed, nodes, similar)
    used = nodes.where("n > 0 and id is not null").select("id", "n", "sigs")
    # signatures that a share of a sample has are known beforehand to be large: their members need not meet in one task
    n = nodes.count()
    part = used.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))).select(F.explode("sigs").alias("sig"))
    hot = [(r["sig"],) for r in part.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= max(bucket + 1, min(n, SAMPLE) // HOT)).collect()]  # at most 55 x HOT
    sig = used.select(F.explode("sigs").alias("sig"), "id", "n")
    rest = sig
    if hot:
        hot_sigs = F.broadcast(spark.createDataFrame(hot, "sig bigint"))
        rest = sig.join(hot_sigs, "sig", "left_anti")
    dealt = rest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sig").sortWithinPartitions("sig", "id")
    found = stored(dealt.mapInArrow(lean(lambda batches: _meet(batches, similar, bucket)), "member boolean, x bigint, y bigint, n int"), "candidates")
    del dealt
    tidy(spark)
    pairs = found.where("not member").select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = found.where("member").select(F.col("x").alias("sig"), F.col("y").alias("id"), "n")
    if hot:
        own = stored(sig.join(hot_sigs, "sig"), "hot")
        first = own.groupBy("sig").agg(F.min_by(F.struct("id", "n"), "id").alias("f"))  # a row for each hot signature
        star = own.join(F.broadcast(first), "sig").select(F.col("f.id").alias("a"), F.col("f.n").alias("m"), F.col("id").alias("b"), "n")
        pairs = pairs.unionByName(star.where("a < b").where(_ALIKE.format(s=similar)).select("a", "b"))
        members = members.unionByName(own)

    edges = texts.verified(stored(pairs.distinct(), "pairs"))
    roots = stored(_roots(edges), "roots")

    def apart() -> DataFrame:
        """(sig, id, n, root, size) of the members of signatures with more than one root."""
        m = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = m.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 < r1").select("sig", "size")
        return stored(m.join(mixed, "sig").select("sig", "id", "n", "root", "size"), "apart")

    m = apart()
    if not m.isEmpty():
        small, big = m.where(F.col("size") <= bucket), m.where(F.col("size") > bucket)
        other = small.select("sig", F.col("id").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
        more = small.join(other, "sig").where("id < b and root <> other").where(_ALIKE.format(s=similar)).select(F.col("id").alias("a"), "b")
        # of the root that most of a signature's members have
        own = big.groupBy("sig", "root").agg(F.count("*").alias("k"), F.min_by(F.struct("id", "n", "root"), F.xxhash64("sig", "id")).alias("f"))
        chosen = own.groupBy("sig").agg(F.max_by("f", F.struct("k", "root")).alias("f"))
        by = big.join(chosen, "sig").where("root <> f.root").select(F.least("id", "f.id").alias("a"), F.greatest("id", "f.id").alias("b"), "n", F.col("f.n").alias("m"))
        more = stored(more.union(by.where(_ALIKE.format(s=similar)).select("a", "b")).distinct(), "pairs")
        roots = stored(_roots(texts.verified(more), roots), "roots")
        if not big.isEmpty():
            big = apart().where(F.col("size") > bucket)
            if not big.isEmpty():
                roots = stored(_roots(texts.verified(_by_blocks(big, texts)), roots), "roots")
    named = stored(nodes.select("t1", "t2", "id").join(roots, "id", "left").select("t1", "t2", F.coalesce("root", "id").alias("component_id")), "named")
    ids = stored(rows.select("doc_id", "t1", "t2"), "ids")
    released(rows, nodes, found)
    return ids.join(named, ["t1", "t2"]).select("doc_id", "component_id")


def _roots(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, root) by edges and by the roots known before."""
    if known is not None:
        edges = edges.unionByName(known.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    return connected_components(edges).select(F.col("node").alias("id"), "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without near copies: of each component the document with the smallest id stays; of rows with that id, the texts that are it.

    Rows with a null id can't be told apart by it: one row of each of their texts stays, whatever other rows hold. Of rows
    with the same id and text the one whose other columns come first as JSON stays, so reruns agree; only such rows are
    shuffled by it. No rows give no rows. A text of any length is one row with its set of shingles. Columns of docs may have
    any names.
    """
    found = near_copies(docs, id_col, text_col, **how)
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__cw_id")).distinct(), "gone")
    left = docs.join(gone, F.col(id_col).cast("bigint") == F.col("__cw_id"), "left_anti")
    keys = [F.col(id_col).alias("__cw_i"), F.xxhash64(text_col).alias("__cw_t1"), F.xxhash64(text_col, F.lit(1)).alias("__cw_t2")]
    often = stored(left.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumnsRenamed({"__cw_i": "__cw_oi", "__cw_t1": "__cw_o1", "__cw_t2": "__cw_o2"}), "repeated")
    rows = often.count()
    if not rows:
        return left
    side = F.broadcast(often) if rows <= BROADCAST else often
    keyed = left.withColumns(dict(zip(("__cw_i", "__cw_t1", "__cw_t2"), keys)))
    same = F.col("__cw_i").eqNullSafe(F.col("__cw_oi")) & (F.col("__cw_t1") == F.col("__cw_o1")) & (F.col("__cw_t2") == F.col("__cw_o2"))
    first = F.min_by(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns))), F.to_json(F.struct(*(c for c in docs.columns if c != text_col))))
    one = keyed.join(side, same, "left_semi").groupBy("__cw_i", "__cw_t1", "__cw_t2").agg(first.alias("__cw_row"))
    return keyed.join(side, same, "left_anti").select(*docs.columns).unionByName(one.select(*(F.col(f"__cw_row.c{k}").alias(c) for k, c in enumerate(docs.columns))))
