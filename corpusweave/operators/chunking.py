"""Chunks of text. All limits count bytes of UTF-8; a cut may fall inside a character, whose rest is dropped from the chunk."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import memory, text

RAW_BYTES, FUNCTION_BYTES = 1000, 4000
LEAST, MOST, OVERLAP = 800, 4000, 200
#: Pages whose chunks a task holds at once.
ROWS = 128


def line_chunks(c: Column, size: int = RAW_BYTES) -> Column:
    """Lines packed greedily: a line that would pass `size` starts a new chunk (so a long first line leaves an empty one before it)."""
    lines = F.split(c, "\n")
    packed = F.aggregate(
        lines,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open")),
        lambda s, x: F.when(
            F.octet_length(s["open"]) + F.octet_length(x) > size, F.struct(F.concat(s["out"], F.array(s["open"])).alias("out"), F.concat(x, F.lit("\n")).alias("open"))
        ).otherwise(F.struct(s["out"].alias("out"), F.concat(s["open"], x, F.lit("\n")).alias("open"))),
        lambda s: F.when(s["open"] != "", F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"]),
    )
    return packed


def split_overlapping(data: bytes, most: int = MOST, overlap: int = OVERLAP) -> list[bytes]:
    """Pieces of at most `most` bytes: cut after the last sentence, else line, else word of the second half, else hard."""
    if most <= 0 or len(data) <= most:
        return [data]
    rest, out = data.strip(), []
    while len(rest) > most:
        head = rest[:most]
        ends = ((head.rfind(b". "), 1), (head.rfind(b"\n"), 0), (head.rfind(b" "), 0))
        cut = next((at + more for at, more in ends if at > most // 2), most)
        out.append(rest[:cut].strip())
        step = cut - max(0, overlap)
        rest = rest[step if step > 0 else cut :].strip()
    return [x for x in (*out, rest) if x]


def merge_paragraphs(data: bytes, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> list[bytes]:
    """Paragraphs gathered until `least` bytes; one longer than `most` is split on its own."""
    out, open_ = [], b""
    for p in filter(None, map(bytes.strip, data.split(b"\n\n"))):
        if len(p) > most:
            out += ([open_] if open_ else []) + split_overlapping(p, most, overlap)
            open_ = b""
            continue
        open_ = open_ + b"\n\n" + p if open_ else p
        if len(open_) >= least:
            out.append(open_)
            open_ = b""
    return out + ([open_] if open_ else [])


def _pieces(b: pa.RecordBatch, least: int, most: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """The chunks of a batch's pages, of ROWS pages at a time, so that no more is held whatever the batch's size."""
    kinds = (b.column("id").type, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
    for lo in range(0, b.num_rows, ROWS):
        rows = []
        for i, p, at, t in zip(*(b.slice(lo, ROWS).column(c).to_pylist() for c in ("id", "page_number", "at", "page"))):
            for k, c in enumerate(merge_paragraphs((t or "").encode(), least, most, overlap)):
                rows.append((i, p, at, k, c.decode("utf-8", "ignore"), hashlib.sha256(c).hexdigest()))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "page_number", "at", "k", "content", "hash"])


def paragraph_chunks(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_idx, page_number, content, hash) of cleaned document text; pages end at form feeds and count from 1 if there are several."""
    pages = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\f")).alias("at", "page"), F.size(F.split(F.col(text_col), "\f")).alias("n"))
    pages = pages.select("id", F.when(F.col("n") > 1, F.col("at") + 1).otherwise(0).cast("bigint").alias("page_number"), "at", text.clean_text(F.col("page")).alias("page"))

    def run(batches):
        for b in batches:
            yield from _pieces(b, least, most, overlap)
            memory.give_back()

    out = pages.select("id", "page_number", "at", "page").mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, page_number bigint, at int, k int, content string, hash string")
    return out.where(text.is_clean(F.col("content"))).withColumnRenamed("id", id_col)


def write_identity(rel: Column, kind: str, idx: Column) -> Column:
    """The seed of a chunk's point id."""
    return F.concat(rel, F.lit(f"_{kind}_"), idx.cast("string"))
