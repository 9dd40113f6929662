"""Token counts of a unigram tokenizer by a count-only Viterbi pass.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each character; dynamic programming keeps
the best score and its number of pieces, and no path. Ties follow the tokenizer's own rule: of equally good pieces that end
at one place the one that starts first stays (the longest). A character that no piece of its own covers is unknown, with the
lowest score less 10; neighbouring unknowns count as one. Spaces become U+2581, one is put before the text, and pieces never
cross the start of a word, so words are counted once and remembered (at most WORDS of them in a task).

Null and empty texts have no tokens; no rows give no rows, and repeated rows each their own. Whole texts of any length are
walked word by word, and a word of any length (only U+0020 ends one) with states for as many characters as the longest piece
has. Columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

SPACE = "▁"
WORDS = 500_000


class Counter:
    """vocabulary: (piece, score) pairs; the first is the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton, self.longest = ahocorasick.Automaton(), 1
        for piece, score in vocabulary[1:]:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                self.longest = max(self.longest, len(piece))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - 10.0
        self.seen: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Pieces of one word, without memory of words. States are kept in a ring as long as the longest piece."""
        m = self.longest + 1
        best, count, unk = [0.0] * m, [0] * m, [False] * m
        e, matches = 0, []
        for end, match in chain(self.automaton.iter(w), ((len(w), None),)):
            while e < end:  # all matches that end at character e are known
                e += 1
                top, single, at = None, False, e % m
                matches.sort(reverse=True)  # the first start comes first
                for size, score in matches:
                    single |= size == 1
                    k = (e - size) % m
                    if top is None or best[k] + score > top:
                        top, pieces, strange = best[k] + score, count[k] + 1, False
                k = (e - 1) % m
                if not single and (top is None or best[k] + self.unknown > top):
                    top, pieces, strange = best[k] + self.unknown, count[k] + (not unk[k]), True
                best[at], count[at], unk[at] = top, pieces, strange
                matches = []
            matches.append(match)
        return count[e % m]

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = (marked if marked[0] == SPACE else SPACE + marked).split(SPACE)[1:]
        seen, total = self.seen, 0
        for w in words:
            n = seen.get(w)
            if n is None:
                n = self.word(SPACE + w)
                if len(w) <= 64:
                    if len(seen) >= WORDS:
                        seen.clear()
                    seen[w] = n
            total += n
        return total


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public sentencepiece model, the unknown piece first; control and byte pieces are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [("<unk>", 0.0)] + [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens) of each whole text."""

    def run(batches):
        c = Counter(vocabulary(path))
        for b in batches:
            texts = (x.as_py() or "" for x in b.column("text"))
            rows = [(len(t), c.text(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id bigint, n_chars bigint, n_tokens bigint")
