"""Benchmark decontamination by winnowing.

Both sides are cut into words; every span of ten words holds at least one selected five-gram
(the minimum hash of each run of six consecutive five-grams), so a shared span of ten words always
shares a selected fingerprint. Fingerprints of documents and benchmark are joined on their hash, and each
hit is extended along its alignment, comparing the words themselves.

Scale: the benchmark passes through the driver, block by block, and is broadcast. Items are dealt by hash to blocks that
hold half of ``block_bytes`` of text on average; a very long item makes its block as much larger. One block needs one
pass over the documents without any shuffle; more blocks are further passes that carry each document's hits along,
with the lineage cut between them.

Edge cases: null and empty texts have no words. Items without words or with a null id take no part.
Repeated items and documents are each judged; ids that occur on several items count once. Extra columns
of any name are ignored (or carried, in ``hits``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import checkpointed, give_back, parts, pick, slices, sliding_min, wrap

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20

#: Bytes of words stay (A-Z become a-z), all others become spaces.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


def gram_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive word numbers."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = (h ^ ids[j:j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def selected(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions that hold the minimum of some run of ``run`` hashes (all of them on ties)."""
    if len(hashes) < run:
        return np.empty(0, np.int64)
    least = sliding_min(hashes, run)
    keep = np.zeros(len(hashes), bool)
    for o in range(run):
        keep[o:o + len(least)] |= hashes[o:o + len(least)] == least
    return np.flatnonzero(keep)


class Index:
    """Fingerprints of a block of benchmark items, by the length a shared span must have."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, gram: int):
        self.vocabulary: dict[bytes, int] = {}
        texts: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
                texts.setdefault(ids, set()).add(item)
        self.sequences = [np.array(ids, np.int64) for ids in texts]
        self.items = [sorted(names) for names in texts.values()]
        self.classes = []
        for span in sorted({min(window, len(s)) for s in self.sequences}):
            k = min(gram, span)
            found = [(x, s, selected(gram_hashes(s, k), span - k + 1))
                     for x, s in enumerate(self.sequences) if min(window, len(s)) == span]
            hashes = np.concatenate([gram_hashes(s, k)[at] for _, s, at in found])
            owner = np.concatenate([np.full(len(at), x) for x, _, at in found])
            place = np.concatenate([at for _, _, at in found])
            order = np.argsort(hashes, kind="stable")
            self.classes.append((span, k, hashes[order], owner[order], place[order]))

    def mark(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item sequence, first word, words) of each extended hit in a row of word numbers."""
        out = []
        for span, k, hashes, owner, place in self.classes:
            h = gram_hashes(ids, k)
            at = selected(h, span - k + 1)
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            aligned = {(int(owner[j]), int(p - place[j]))
                       for p, a, b in zip(at[high > low], low[high > low], high[high > low])
                       for j in range(a, b)}
            for x, offset in aligned:
                sequence = self.sequences[x]
                first, last = max(offset, 0), min(offset + len(sequence), len(ids))
                same = np.flatnonzero(np.diff(np.concatenate(
                    ([0], ids[first:last] == sequence[first - offset:last - offset], [0]))))
                for a, b in zip(same[::2], same[1::2]):
                    if b - a >= span:
                        out.append((x, first + int(a), int(b - a)))
        return out


def mark_batch(index: Index, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Words and extended hits of each text; one vectorised pass over all of them."""
    get = index.vocabulary.get
    parts, counts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))  # no item has the word number 0, so nothing crosses a text
    starts = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
    hits: list[list] = [[] for _ in texts]
    if texts and index.sequences:
        for x, first, n in index.mark(np.concatenate(parts)):
            d = int(np.searchsorted(starts, first, "right")) - 1
            hits[d].append((x, first - int(starts[d]), n))
    return list(zip(counts, hits))


HITS = "n_words long, n_hit long, hit binary, items array<string>"


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, gram: int = GRAM,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document as ``row`` with n_words, n_hit, hit (a bit a word) and items (ids with a window in it)."""
    spark = docs.sparkSession
    frame = wrap(docs, text=text).withColumn("text", F.col("text").cast("binary")).select(
        "row", "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    for k, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        if k:
            frame = checkpointed(frame)
        sent = spark.sparkContext.broadcast(block)
        frame = frame.mapInArrow(_pass(sent, window, gram), frame.schema)
    return frame.drop("text")


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, fetched one block at a time; at least one block, maybe empty.

    Items go to blocks by hash; the number of blocks grows with the benchmark's measured size, so a
    block is half full on average.
    """
    items = pick(benchmark, item=item_id, text=item_text).where("item is not null and text is not null").select(
        F.col("item").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).distinct()
    total = int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = 1 if total <= block_bytes else 2 * total // block_bytes + 1
    for b in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r.item, bytes(r.text)) for r in mine.collect()]


def _pass(sent, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        index = Index(sent.value, window, gram)
        for batch in parts(batches, 2048):
            before, items = batch.column("hit").to_pylist(), batch.column("items").to_pylist()
            n_hit, hit = [], []
            texts = batch.column("text").to_pylist()
            marked = [m for a, b in slices(texts) for m in mark_batch(index, texts[a:b])]
            for d, (n, spans) in enumerate(marked):
                bits = np.zeros(n, bool)
                if before[d] is not None:
                    bits |= np.unpackbits(np.frombuffer(before[d], np.uint8), count=n).astype(bool)
                for x, first, length in spans:
                    bits[first:first + length] = True
                if spans:
                    items[d] = sorted(set(items[d]).union(*(index.items[x] for x, _, _ in spans)))
                n_hit.append(int(bits.sum()))
                hit.append(np.packbits(bits).tobytes() if n_hit[-1] else None)
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("text"), pa.array([n for n, _ in marked], pa.int64()),
                pa.array(n_hit, pa.int64()), pa.array(hit, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                batch.schema.names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, items and contaminated of each document."""
    names = docs.columns
    return hits(docs, benchmark, **options).select(
        F.col(f"row._c{names.index(doc_id)}").alias("doc_id"), "n_words", "n_hit", "items",
        (F.col("n_hit") > 0).alias("contaminated"))
