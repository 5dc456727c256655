"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut into pieces of
``PIECE`` bytes; each is compressed with either dictionary, and the difference of the summed sizes, divided
by the bytes of the text, is the raw score. An isotonic fit (with a little logistic to keep the order
strict) on labelled texts that the dictionaries have not seen turns it into the probability of label 1.

Fit: on a bounded sample, about ``sample_rows`` labelled documents of each class, half for the
dictionaries (``PIECES`` pieces evenly over each text) and half, as whole texts, for the calibration,
weighted back to the class frequencies. All documents are scored as whole texts in one pass without a shuffle; the
model, two dictionaries of at most ``DICTIONARY`` bytes, travels with the task.

Edge cases: null and empty texts have the raw score 0. Without labels of both classes every text gets the share of
label 1, (n1 + 1) / (n + 2). Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import parts, pick
from telemetrix.llm.labels import Constant, calibrate, class_counts, labelled, sample

PIECE = 1024
PIECES = 8
DICTIONARY = 64 << 10
LEVEL = 3
SAMPLE_ROWS = 2000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    probability: Callable[[np.ndarray], np.ndarray]


def dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary of the pieces; their plain content where there are too few to train on."""
    total = sum(map(len, pieces))
    if total >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, total // 8), pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # too few or too uniform pieces: their content itself serves
    return b"".join(pieces)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = self._compressor(good), self._compressor(bad)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not content:
            return zstandard.ZstdCompressor(level=LEVEL, **plain)
        data = zstandard.ZstdCompressionDict(content)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **plain)

    def raw(self, text: bytes | None) -> float:
        """(size with bad - size with good) / bytes; higher for good text."""
        if not text:
            return 0.0
        good, bad = self.good.compress, self.bad.compress
        return sum(len(bad(p)) - len(good(p)) for p in
                   (text[i:i + PIECE] for i in range(0, len(text), PIECE))) / len(text)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    known = labelled(labels, doc_id, label, learn)
    counts = class_counts(known)
    if not min(counts):
        return Model(b"", b"", Constant(counts))
    chosen = F.broadcast(sample(known, counts, (sample_rows, sample_rows)))  # at most 8 * sample_rows short rows
    rows = (pick(docs, id=doc_id, text=text).where("text is not null").join(chosen, "id")
            .select("y", (F.col("u") % 2).alias("part"), F.col("text").cast("binary").alias("text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for y, body in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                n = -(-len(body) // PIECE)
                at = range(n) if n <= PIECES else [i * n // PIECES for i in range(PIECES)]
                pieces = [body[i * PIECE:(i + 1) * PIECE] for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], ["y", "piece"])

    pieces = rows.where("part = 0").mapInArrow(cut, "y int, piece binary").collect()
    good, bad = (dictionary(sorted(bytes(r.piece) for r in pieces if r.y == y)) for y in (1, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in parts(batches):
            raw = [sizes.raw(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array(raw, pa.float64())], ["y", "x"])

    measured = rows.where("part = 1").mapInArrow(measure, "y int, x double").collect()
    x, y = np.array([r.x for r in measured]), np.array([r.y for r in measured])
    return Model(good, bad, calibrate(x, y, counts))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted of each document."""
    frame = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in parts(batches):
            raw = np.array([sizes.raw(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.probability(raw), pa.float64())], ["doc_id", "score"])

    scored = frame.mapInArrow(run, frame.select("doc_id", F.lit(0.0).alias("score")).schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
