"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a part is short enough for one call of the leaf encoder; two encoded neighbours are then joined by
re-encoding a window around their border only. The window grows until what lies outside is proved to stay:

* A cut is safe if no match of the splitting pattern can hold both characters beside it, whatever surrounds them (for
  instance a non-space followed by white space). Between safe cuts on both sides the text is encoded anew; the tokens
  outside can't differ, because the pattern looks at nothing before a match's start and BPE never merges across matches.
* Inside one long run of one character class there is no such cut. There, tokens are re-encoded as one piece, and the join
  holds once both pairs of tokens at the window's ends are pairs that BPE itself yields: a sequence of tokens is the
  encoding of its bytes exactly if each two neighbours are the encoding of theirs.

Decoding concatenates bytes up the same kind of tree. Null text counts as empty: no tokens, digests of nothing. Repeated
rows and ties each give their own row; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

#: Characters that one call of the leaf encoder gets at most.
LEAF_CHARS = 8192
#: Tokens that one call of the leaf decoder gets at most.
LEAF_TOKENS = 65536
#: Tokens of one batch of results, about.
OUT_TOKENS = 1 << 19

# The first character can't share a match with the second: ASCII only, so that no Unicode version matters.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[\x00-\x40\x5b-\x60\x7b-\x7f])|(?<=[0-9])(?=[\x00-\x2f\x3a-\x7f])")
_RUNS = tuple(re.compile(x) for x in (r"[A-Za-z]+", r"[0-9]+", r"[ \t\n\r]+", r"[!-/:-@\[-`{-~]+"))


class ByteBPE:
    """Encoder and decoder over a rank file (base64 token, rank) and a splitting pattern; no special tokens."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_tokens: int = LEAF_TOKENS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars, self.leaf_tokens = max(2, leaf_chars), max(1, leaf_tokens)
        self.width = [0] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.width[r] = len(t)
        self.decimal = [str(i) for i in range(len(self.width))]

    # encoding
    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.codec.encode_ordinary(text)
        mid = len(text) // 2
        a, b = text[:mid], text[mid:]
        return self.join(a, self.encode(a), b, self.encode(b))

    def join(self, a: str, ta: list[int], b: str, tb: list[int]) -> list[int]:
        """Tokens of a + b from those of a and of b."""
        size = 64
        while size < max(len(a), len(b)):
            left, right = a[-size:], b[:size]
            cuts = [m.start() for m in _SAFE.finditer(left)]
            end = _SAFE.search(right)
            if (cuts or size >= len(a)) and (end or size >= len(b)):
                left = left[cuts[-1] :] if cuts else a
                right = right[: end.start()] if end else b
                keep, drop = self._from_end(ta, len(left.encode())), self._from_start(tb, len(right.encode()))
                return ta[:keep] + self.codec.encode_ordinary(left + right) + tb[drop:]
            if (t := self._inside(ta, left, tb, right)) is not None:
                return t
            size *= 4
        return self.codec.encode_ordinary(a + b)

    def _from_end(self, tokens: list[int], n: int) -> int:
        at = len(tokens)
        while n > 0:
            at -= 1
            n -= self.width[tokens[at]]
        return at

    def _from_start(self, tokens: list[int], n: int) -> int:
        at = 0
        while n > 0:
            n -= self.width[tokens[at]]
            at += 1
        return at

    def _piece(self, tokens: list[int]) -> list[int]:
        return self.codec._encode_single_piece(self.codec.decode_bytes(tokens))

    def _inside(self, ta: list[int], left: str, tb: list[int], right: str) -> list[int] | None:
        """The join within one match of the pattern, if left + right is a run of one class; left and right are ASCII then."""
        if not any(r.fullmatch(left) and r.fullmatch(right) for r in _RUNS):
            return None
        room_a, room_b = len(left) - 3, len(right) - 1  # a contraction may end in left; the last white space may go elsewhere
        k = 4
        while True:
            i, j, used_a, used_b = 0, 0, 0, 0
            while i < min(k, len(ta) - 1) and used_a + self.width[ta[-i - 1]] <= room_a:
                used_a += self.width[ta[-i - 1]]
                i += 1
            while j < min(k, len(tb) - 1) and used_b + self.width[tb[j]] <= room_b:
                used_b += self.width[tb[j]]
                j += 1
            # the tokens just outside must lie in the same run as well
            if i and j and used_a + self.width[ta[-i - 1]] <= room_a and used_b + self.width[tb[j]] <= room_b:
                w = self._piece(ta[-i:] + tb[:j])
                before, after = ta[-i - 1], tb[j]
                if self._piece([before, w[0]]) == [before, w[0]] and self._piece([w[-1], after]) == [w[-1], after]:
                    return ta[:-i] + w + tb[j:]
            elif i < k or j < k:
                return None
            k *= 2

    # decoding
    def decode(self, tokens: list[int]) -> bytes:
        if len(tokens) <= self.leaf_tokens:
            return self.codec.decode_bytes(tokens)
        mid = len(tokens) // 2
        return self.decode(tokens[:mid]) + self.decode(tokens[mid:])

    def digest(self, tokens: list[int]) -> str:
        names = self.decimal
        return hashlib.sha256(" ".join([names[t] for t in tokens]).encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with the text replaced by token_ids array<int> and n_tokens bigint; columns of those names in docs are replaced."""
    kept = [c for c in docs.columns if c not in (text_col, "token_ids", "n_tokens")]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        bpe = ByteBPE(path, pattern)
        for b in batches:
            ids, at, n = [], 0, 0
            for i, text in enumerate(b.column("__cw_text"), 1):
                ids.append(np.array(bpe.encode(text.as_py() or ""), np.int32))
                n += len(ids[-1])
                if n >= OUT_TOKENS or i == b.num_rows:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, i - at) for c in kept), lists, pa.array(np.diff(ends).astype(np.int64))], [*kept, "token_ids", "n_tokens"])
                    ids, at, n = [], i, 0

    return docs.select(*kept, F.col(text_col).alias("__cw_text")).mapInArrow(lean(run), schema)


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of encode_documents with token_ids turned back: adds text string (bytes that are not UTF-8 become U+FFFD)."""
    kept = [c for c in tokens.columns if c not in ("token_ids", "text")]
    schema = T.StructType([*tokens.select(*kept).schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        bpe = ByteBPE(path, pattern)
        for b in batches:
            texts = [bpe.decode(x or []).decode("utf-8", "replace") for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return tokens.select(*kept, "token_ids").mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the tokens, and returns doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        bpe = ByteBPE(path, pattern)
        for b in batches:
            n, ids, back = [], [], []
            for text in b.column("text"):
                t = bpe.encode(text.as_py() or "")
                n.append(len(t))
                ids.append(bpe.digest(t))
                back.append(hashlib.sha256(bpe.decode(t)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lean(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
