"""MinHash near-duplicates by an LSH forest: sorted signature orders, neighbours by longest common prefix, depth by region.

A document's set of shingles has a signature of TREES x DEPTH minima. A tree is one order of these, the signature turned by
DEPTH places for each tree, and a sorted list of all documents by it. A region of a tree is what has a common prefix. Two sets
at 0.8 agree in a prefix of DEPTH minima with a probability of 0.41, so in none of the TREES trees with one of 3e-6, and less
the more alike they are; those that meet are judged by the exact index of the full sets.

A task walks its sorted regions: a member meets the region's first and its neighbour in the order, whose common prefix is the
longest. Once what these link is known, only what is still apart meets: all of a region of up to BUCKET members; larger regions
are cut at a depth of their own, the least of DEPTHS at which a member's region is small, and what is in a large one
still apart after that meets by an exact prefix filter over rare shingles. So groups of copies make no pairs, and no region has a cap.

Equal sets are one node whatever their number, so copies cost a row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, released, stored, tidy
from .simhash import HOT, SAMPLE, _ALIKE, _by_blocks, _meet, _roots, _Texts

#: Words of a shingle and the least Jaccard index of two near copies.
WIDTH, SIMILAR = 2, 0.8
#: Orders of the signature, minima of a prefix, and deeper prefixes by which large regions are cut.
TREES, DEPTH, DEPTHS = 24, 4, (6, 8, 12, 20)
#: Members of a region that may meet pair by pair.
BUCKET = 48
#: Ids that are broadcast at most to pick texts out; more meet by an exchange.
BROADCAST = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(13).integers(0, 1 << 32, (2, TREES * DEPTH, 1), np.uint32, endpoint=False) | np.uint32(1)


class _Words(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1 << 19:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 13)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `width` words (of the whole text if it has fewer); none without words."""
    own = text.lower().split()
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _MIX + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(h: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minima (uint32) of a set of hashes that isn't empty."""
    low, h = np.empty(TREES * DEPTH, np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 16) // len(h))
    for k in range(0, len(low), step):
        low[k : k + step] = ((h ^ _SEEDS[0, k : k + step]) * _SEEDS[1, k : k + step]).min(axis=1)
    return low


def prefixes(sig: np.ndarray, depth: int) -> np.ndarray:
    """(rows, trees) names of the prefixes of `depth` minima in each order, the tree's number in the upper six bits; sig: (rows, minima)."""
    out = np.broadcast_to(np.arange(TREES, dtype=np.uint64) + np.uint64(depth << 8), (len(sig), TREES)).copy()
    for k in range(depth):
        at = (np.arange(TREES) * DEPTH + k) % sig.shape[1]
        out = _mixed(out * _MIX + sig[:, at])
    return (out >> np.uint64(6)) | (np.arange(TREES, dtype=np.uint64) << np.uint64(58))


class _Sets(_Texts):
    """The shingle sets of nodes (id, k1, k2), read from the texts when they are asked for."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, similar: float, width: int):
        self.texts, self.nodes, self.similar, self.width = texts, nodes, similar, width

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, words array<bigint>) of the ids given, each once."""
        width = self.width

        def read(batches):
            words = _Words()
            for b in batches:
                sets = [shingles(x.as_py(), words, width) for x in pc.cast(b.column("text"), pa.binary())]
                own = [i for i, (h, k) in enumerate(zip(sets, b.column("k1").to_pylist())) if _name(h)[0] == k]  # rows of one id may hold other texts
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(own, pa.int64())), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], ["id", "words"])

        asked = stored(self.nodes.select("id", "k1").join(ids, "id"), "asked")
        side = F.broadcast(asked) if asked.count() <= BROADCAST else asked
        found = self.texts.join(side, F.col("doc_id") == F.col("id")).select("id", "k1", "text")
        out = stored(found.mapInArrow(lean(read), "id bigint, words array<bigint>").dropDuplicates(["id"]), "sets")
        released(asked)
        return out


def _name(h: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    import xxhash

    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, k1, k2, sig) of (doc_id, text): size and name of the set, its signature; null without words."""

    def run(batches):
        words = _Words()
        for b in batches:
            sets = [shingles(x.as_py() or b"", words, width) for x in pc.cast(b.column("text"), pa.binary())]
            names = [_name(h) if len(h) else (None, None) for h in sets]
            cols = [pa.array([len(h) for h in sets], pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)), pa.array([signature(h).tobytes() if len(h) else None for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n", "k1", "k2", "sig"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n bigint, k1 bigint, k2 bigint, sig binary")


def _regions(nodes: DataFrame, depths: tuple[int, ...], keep: list[str]) -> DataFrame:
    """(keep, depth, tree, sig) of nodes with their signatures: the region of each tree at each of the depths."""

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, TREES * DEPTH)
            for d in depths:
                rows = pa.array(np.repeat(np.arange(b.num_rows), TREES))
                names = prefixes(sig, d).ravel()
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in keep), pa.array(np.full(len(names), d, np.int32)), pa.array((names >> np.uint64(58)).astype(np.int32)), pa.array(names.view(np.int64))], [*keep, "depth", "tree", "name"])

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in keep)
    return nodes.select(*keep, "sig").mapInArrow(lean(run), f"{kinds}, depth int, tree int, name bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similar: float = SIMILAR, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of documents: linked where their sets have a Jaccard index of `similar` or more, chains included.

    A-Z counts as a-z; words lie between ASCII white space; with fewer words than `width` the whole sequence is one shingle.
    Texts without words, and null, are empty sets and linked with nothing. Rows of an equal doc_id each keep a row. A null id
    takes no part in links unless an equal set has an id, and is never a component's. No rows give no rows. A text of any
    length is one row with its set. Columns besides the two are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(_signed(texts, width), "signed")
    nodes = stored(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n").cast("int").alias("n"), F.first("sig").alias("sig")), "nodes")
    tidy(spark)
    used = nodes.where("id is not null")
    sets = _Sets(texts.where("text is not null"), nodes, similar, width)
    count = nodes.count()
    # regions that a share of a sample is in are known beforehand to be large: their members need not meet in one task
    part = used.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(count, 1))))
    hot = _regions(part, (DEPTH,), ["id"]).groupBy("name").agg(F.count("*").alias("c")).where(F.col("c") >= max(bucket + 1, min(count, SAMPLE) // HOT))
    hot = [(r["name"],) for r in hot.select("name").collect()]  # at most TREES x HOT
    regions = _regions(used, (DEPTH,), ["id", "n"]).select(F.col("name").alias("sig"), "id", "n")
    rest = regions
    if hot:
        hot_names = F.broadcast(spark.createDataFrame(hot, "sig bigint"))
        rest = regions.join(hot_names, "sig", "left_anti")
    dealt = rest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sig").sortWithinPartitions("sig", "n", "id")
    found = stored(dealt.mapInArrow(lean(lambda batches: _meet(batches, similar, bucket)), "member boolean, x bigint, y bigint, n int"), "candidates")
    del dealt
    tidy(spark)
    pairs = found.where("not member").select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = found.where("member").select(F.col("x").alias("sig"), F.col("y").alias("id"), "n")
    if hot:
        own = stored(regions.join(hot_names, "sig"), "hot")
        first = own.groupBy("sig").agg(F.min_by(F.struct("id", "n"), "id").alias("f"))  # a row for each hot region
        star = own.join(F.broadcast(first), "sig").select(F.col("f.id").alias("a"), F.col("f.n").alias("m"), F.col("id").alias("b"), "n")
        pairs = pairs.unionByName(star.where("a < b").where(_ALIKE.format(s=similar)).select("a", "b"))
        members = members.unionByName(own)
    edges = sets.verified(stored(pairs.distinct(), "pairs"))
    roots = stored(_roots(edges), "roots")

    def apart() -> DataFrame:
        """(sig, id, n, root, size) of the members of regions with more than one root."""
        m = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = m.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 < r1").select("sig", "size")
        return stored(m.join(mixed, "sig").select("sig", "id", "n", "root", "size"), "apart")

    m = apart()
    if not m.isEmpty():
        small, big = m.where(F.col("size") <= bucket), m.where(F.col("size") > bucket)
        own = small.select("sig", "id", "n", "root")
        if not big.isEmpty():  # each member's region at the least depth at which it is small
            deep = _deeper(big, nodes, bucket)
            own = own.unionByName(deep)
        other = own.select("sig", F.col("id").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
        more = own.join(other, "sig").where("id < b and root <> other").where(_ALIKE.format(s=similar)).select(F.col("id").alias("a"), "b")
        # and one of the root that most of a large region's members have
        share = big.groupBy("sig", "root").agg(F.count("*").alias("k"), F.min_by(F.struct("id", "n", "root"), F.xxhash64("sig", "id")).alias("f"))
        chosen = share.groupBy("sig").agg(F.max_by("f", F.struct("k", "root")).alias("f"))
        by = big.join(chosen, "sig").where("root <> f.root").select(F.least("id", "f.id").alias("a"), F.greatest("id", "f.id").alias("b"), "n", F.col("f.n").alias("m"))
        more = stored(more.unionByName(by.where(_ALIKE.format(s=similar)).select("a", "b")).distinct(), "pairs")
        roots = stored(_roots(sets.verified(more), roots), "roots")
        if not big.isEmpty():
            left = apart().where(F.col("size") > bucket)
            if not left.isEmpty():
                roots = stored(_roots(sets.verified(_by_blocks(left, sets)), roots), "roots")
    named = stored(nodes.select("k1", "k2", "id").join(roots, "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("component_id")), "named")
    out = stored(rows.select("doc_id", "n", "k1", "k2"), "ids")
    released(rows, nodes, found)
    out = out.join(named, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _deeper(big: DataFrame, nodes: DataFrame, bucket: int) -> DataFrame:
    """(sig, id, n, root) of the members of large regions, in their regions of the least depth at which these have up to `bucket` members."""
    asked = big.select("id", "n", "root", F.shiftrightunsigned("sig", 58).cast("int").alias("of"))
    found = _regions(asked.groupBy("id", "n", "root").agg(F.collect_set("of").alias("trees")).join(nodes.select("id", "sig"), "id"), DEPTHS, ["id", "n", "root", "trees"])
    found = stored(found.where("array_contains(trees, tree)").select("id", "n", "root", "depth", "tree", "name"), "deeper")
    sizes = found.groupBy("name").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where((F.col("size") <= bucket) & (F.col("size") > 1)).select("name", "r0", "r1")
    fit = found.join(sizes, "name")
    least = fit.groupBy("id", "tree").agg(F.min_by(F.struct("name", "n", "root", "r0", "r1"), "depth").alias("x"))
    return least.where("x.r0 < x.r1").select(F.col("x.name").alias("sig"), "id", "x.n", "x.root")
