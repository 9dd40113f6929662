"""Vector codes by product quantisation, with codebooks from delta-maintained Lloyd rounds on integers.

Vectors become integers, floor(SCALE * x), and are cut into PARTS; each part position has a codebook of ENTRIES. A round
assigns every part to its nearest entry and keeps the assignment with the row. The sums and counts of the entries are
carried on from round to round: only parts whose assignment has changed add themselves to the new entry and take themselves
off the old one. Tasks add these up before the exchange, so a round shuffles at most PARTS x ENTRIES rows a task, and none
once nothing moves. Sums are integers, so the result depends on neither order nor partitions. The driver holds codebooks and
their sums, whose size doesn't grow with the data.

A row of the state is a vector and its codes; a round writes it anew to the shared folder and deletes the last one's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, released, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums are broadcast at most; more meet by an exchange.
BROADCAST = 200_000

_STATE = "vec_id bigint, x binary, was binary, code binary, error bigint"


class Codebooks:
    """Entries of each part position, with the sums and counts that they are made of."""

    def __init__(self, first: np.ndarray, parts: int):
        """first: (entries, components), the vectors that the codebooks begin with."""
        edges = np.linspace(0, first.shape[1], parts + 1).astype(int)
        self.cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.entries = [first[:, a:b].copy() for a, b in self.cuts]
        self.sums = [np.zeros_like(e) for e in self.entries]
        self.counts = np.zeros((parts, len(first)), np.int64)

    def arrays(self) -> tuple[list, list]:
        """What tasks need: (cuts, entries)."""
        return self.cuts, self.entries

    def moved(self, rows) -> None:
        """Takes (part, entry, position, change) in, position -1 being the count, and replaces each entry that has parts by their mean, rounded down."""
        for part, entry, at, change in rows:
            if at < 0:
                self.counts[part, entry] += change
            else:
                self.sums[part][entry, at] += change
        for part, e in enumerate(self.entries):
            used = self.counts[part] > 0
            e[used] = self.sums[part][used] // self.counts[part][used, None]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def nearest_entries(x: np.ndarray, cuts: list, entries: list, exact: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(codes uint8 of rows x parts, squared distances summed over parts); ties to the lower entry."""
    codes, error = np.empty((len(x), len(cuts)), np.uint8), np.zeros(len(x), exact)
    for p, (a, b) in enumerate(cuts):
        own, c = x[:, a:b].astype(exact), entries[p].astype(exact)
        far = (c * c).sum(axis=1) - 2 * (own @ c.T)
        k = far.argmin(axis=1)
        codes[:, p] = k
        error += far[np.arange(len(x)), k] + (own * own).sum(axis=1)
    return codes, error.astype(np.int64)


def _integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None, scale: int) -> DataFrame:
    """(vec_id, label, x int32 components as bytes, top their largest amount) of the usable rows."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    v = v.where("vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    size = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    v = v.where(F.size("vec") == (size["d"] if size else 0))

    def pack(batches):
        for b in batches:
            x = np.asarray(b.column("vec").flatten()).reshape(b.num_rows, -1)
            with np.errstate(over="ignore"):
                whole = np.floor(x * scale)
            top = np.abs(whole).max(axis=1, initial=0.0)
            ints = np.where(top[:, None] < 1 << 30, whole, 0).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in ints], pa.binary()), pa.array(np.minimum(top, 1 << 30).astype(np.int64))], ["vec_id", "label", "x", "top"])

    label = v.schema["label"].dataType.simpleString()
    return v.mapInArrow(lean(pack), f"vec_id bigint, label {label}, x binary, top bigint")


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code binary of a byte a part, error bigint), codebooks) of the vectors.

    Rows whose vector is null, or holds null or non-finite components, or hasn't the most common length, are dropped; repeated
    rows count each. Codebooks begin with the smallest ids (null ids last, equal ids by the bytes of their vectors); fewer rows
    than `entries` give fewer entries, none no rows and no codebooks. Parts are equal where their number divides the length and
    else differ by one component. Components beyond 2^30 / scale, or so large that squared distances leave a long, are an error.
    Columns besides the three are not looked at, whatever their names.
    """
    table = stored(_integers(vectors, id_col, vec_col, label_col, scale), "integers")
    label = table.schema["label"].dataType.simpleString()
    schema = f"{_STATE}, label {label}"
    top = table.agg(F.max("top")).first()[0]
    if top is None:
        return table.selectExpr("vec_id", "label", "x AS code", "top AS error").where("false"), None
    first = table.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(min(entries, 256)).collect()
    books = Codebooks(np.stack([np.frombuffer(r["x"], "<i4") for r in first]).astype(np.int64), parts)
    width = len(first[0]["x"]) // 4
    most = width * (2 * max(top, 1)) ** 2
    if top >= 1 << 30 or most >= 1 << 63:
        raise ValueError(f"components up to {top / scale:g} are too large for exact distances")
    exact = np.float64 if most < 1 << 53 else np.int64  # both exact; the first is faster

    def assigned(state: DataFrame, fresh: bool) -> DataFrame:
        cuts, own = books.arrays()

        def run(batches):
            for b in batches:
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").reshape(b.num_rows, width)
                codes, error = nearest_entries(x, cuts, own, exact)
                was = pa.nulls(b.num_rows, pa.binary()) if fresh else b.column("code")
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), was, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), b.column("label")], ["vec_id", "x", "was", "code", "error", "label"])

        return stored(state.mapInArrow(lean(run), schema), "assigned")

    def changes(state: DataFrame) -> list:
        """(part, entry, position, change), the contributions of parts that have moved; codebook-sized."""
        cuts, shape = books.cuts, (parts, len(first))

        def run(batches):
            sums, counts = [np.zeros((shape[1], b - a), np.int64) for a, b in cuts], np.zeros(shape, np.int64)
            for b in batches:
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").reshape(b.num_rows, width)
                now = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                before = b.column("was").to_pylist()
                had = np.array([w is not None for w in before])
                was = np.frombuffer(b"".join(w or bytes(shape[0]) for w in before), np.uint8).reshape(b.num_rows, -1)
                for p, (lo, hi) in enumerate(cuts):
                    move = ~had | (now[:, p] != was[:, p])
                    for rows, code, sign in ((move, now, 1), (move & had, was, -1)):
                        np.add.at(sums[p], code[rows, p], sign * x[rows, lo:hi].astype(np.int64))
                        np.add.at(counts[p], code[rows, p], sign)
            for p, e in np.argwhere(np.array([counts[p] != 0 for p in range(shape[0])]) | np.array([(s != 0).any(axis=1) for s in sums])):
                values = np.concatenate(([counts[p, e]], sums[p][e]))
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, e, np.int32)), pa.array(np.arange(-1, n - 1, dtype=np.int32)), pa.array(values)], ["part", "entry", "at", "change"])

        moved = state.where("was IS NULL OR was <> code").select("x", "was", "code").mapInArrow(lean(run), "part int, entry int, at int, change bigint")
        return [tuple(r) for r in moved.groupBy("part", "entry", "at").agg(F.sum("change").alias("change")).collect()]

    state = table
    for n in range(rounds):
        last, state = state, assigned(state, n == 0)
        released(last)
        books.moved(changes(state))
    last, state = state, assigned(state, rounds == 0)
    released(last)
    return state.select("vec_id", "label", "code", "error"), books


def code_report(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    codes, books = encode(vectors, **how)
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    side = F.broadcast(sums) if sums.count() <= BROADCAST else sums
    out = codes.join(side, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
