"""Token counts of a unigram tokenizer by count-only Viterbi search.

An Aho-Corasick automaton of the vocabulary lists all pieces that end at each place of a text; for each place the best
score and the number of tokens of its path are carried, no path is kept. Rules of the tokenizer: of paths with equal scores the one
whose last piece starts earlier wins; a character that no single-character piece covers may be unknown, at the least
score less 10; adjacent unknown characters are one unknown piece, which byte fallback turns into one token a
byte. Spaces become the sign ``SPACE`` and one is put before a text.

Where no piece holds a ``SPACE`` after another sign, paths never cross such a place, so texts are cut there and each
distinct part is searched once per task and kept, at most ``KEPT`` of them. Other vocabularies are searched over whole
texts. Scores are summed within a part first (exact for scores that are whole numbers).

Scale: one pass over the documents without a shuffle; the vocabulary is sent once to each executor.

Edge cases: null and empty texts have no tokens and the score 0. Repeated rows are counted each; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import parts, pick

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT = 200_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores of a sentencepiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Tokens and score of the best path of texts."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in pieces)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if SPACE in self.single and not crossing else "(?s:.+)").findall
        self.kept: dict[str, tuple[int, float]] = {}

    def search(self, part: str) -> tuple[int, float]:
        """Count and score of the best path over a part, by one sweep over its places."""
        n = len(part)
        best, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(part):
            ending[end].append(match)
        for end in range(1, n + 1):
            top = None
            for length, score in sorted(ending[end - 1], reverse=True):  # earlier starts first
                reached = best[end - length] + score
                if top is None or reached > top:
                    top, tokens, unknown = reached, count[end - length] + 1, False
            sign = part[end - 1]
            if sign not in self.single:
                reached = best[end - 1] + self.unknown
                if top is None or reached > top:
                    top, unknown = reached, True
                    if self.byte_fallback:
                        tokens = count[end - 1] + len(sign.encode())
                    else:
                        tokens = count[end - 1] + (not open_[end - 1])
            best[end], count[end], open_[end] = top, tokens, unknown
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        tokens, total, kept = 0, 0.0, self.kept
        for part in self.cut(SPACE + text.replace(" ", SPACE)):
            found = kept.get(part)
            if found is None:
                if len(kept) >= KEPT:
                    kept.clear()
                found = kept[part] = self.search(part)
            tokens += found[0]
            total += found[1]
        return tokens, total


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and score (of the best path) of each document."""
    frame = pick(docs, doc_id=doc_id, text=text)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value, byte_fallback)
        for batch in parts(batches):
            found = [counter.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "n_tokens", "score"])

    shape = frame.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("score"))
    return frame.mapInArrow(run, shape.schema)
