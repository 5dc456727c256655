"""Removal of repeated byte strings: suffix-array deduplication over a cluster.

A byte goes when some string of ``LENGTH`` bytes that covers it also starts earlier (smaller id, or same document and
earlier start). Three steps bring equal strings together without moving all suffixes:

1. Each string of 100 bytes is represented by the 32-byte gram with the least hash inside it (the leftmost on ties); equal
   strings choose equal grams. Blocks of documents report the hashes they chose, one entry a block and hash, and
   learn which were chosen at least twice in the corpus. All strings under other grams are unique.
2. Neighbouring strings under one shared gram form a stretch (at most 168 bytes). Blocks send their stretches, equal ones
   once, to the bucket of the gram, so that all occurrences of a repeated string meet in one bucket; there, too, equal stretches become
   one entry, the earliest.
3. A bucket builds the Burrows-Wheeler transform of its stretches and expands intervals breadth-first up to the length 100
   (``suffixes``). Suffixes that no boundary parts share 100 bytes; of each such class the earliest string stays and
   the bytes of the others are reported to their blocks, which cut them from the texts.

Scale: blocks hold about ``BLOCK_BYTES`` of text, whatever the input; their exchange is used three times and written
once. Hash lists and stretches travel packed. A gram chosen more than ``HOT`` times (a passage in a third of
all documents, say) is dealt out by the hash of each single string instead of the gram, so that no bucket gathers
all of its occurrences; equal strings of a block are sent once in any case. Nothing is collected.

Edge cases: null texts are empty. Documents of one id are ordered by their text, equal rows one after the
other (so all but one are removed as copies). Rows without an id come before all others, ordered by
a hash of the text and the text. Ids are whole numbers (others are cast, and fail if they are none). Texts below 100
bytes are kept whole, texts of any length are taken whole; no rows give no rows. Extra columns are carried by
``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import give_back, parts, ranges, sliding_min
from telemetrix.llm.packing import blocked
from telemetrix.llm.suffixes import repeated_classes

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 12 << 20
SLICE = 1 << 20
CHUNK = 1 << 16
SYMBOLS = 1 << 19
HOT = 5_000

# Random 64-bit words for the bytes, from a rule (splitmix), and odd multipliers of the hash.
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _words(n: int) -> np.ndarray:
    z = np.arange(1, n + 1, dtype=np.uint64) * MIX[0]
    z = (z ^ (z >> np.uint64(30))) * MIX[1]
    z = (z ^ (z >> np.uint64(27))) * MIX[2]
    return z ^ (z >> np.uint64(31))


WORDS, FACTORS = _words(256), _words(8) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each position, by doubling."""
    h, width, j = WORDS[data], 1, 0
    while width < gram:
        h = h[:-width] * FACTORS[j] + h[width:]
        width, j = 2 * width, j + 1
    h = h ^ (h >> np.uint64(32))
    h *= MIX[1]
    return h ^ (h >> np.uint64(29))


def stretches(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash, first and last string start of each stretch of joined texts (``ends`` of each, ascending)."""
    n = len(data)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    codes, run = np.frombuffer(data, np.uint8), length - gram + 1
    hashes, chosen = [], []
    low = np.uint64((1 << 17) - 1)
    for at in range(0, n - length + 1, CHUNK):
        h = gram_hashes(codes[at:at + CHUNK + length - 1], gram)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        chosen.append((sliding_min(packed, run) & low).astype(np.int64) + at)
        hashes.append(h[:CHUNK])
    chosen, hashes = np.concatenate(chosen), np.concatenate(hashes)
    start = np.arange(len(chosen))
    inside = start + length <= np.repeat(ends, np.diff(ends, prepend=0))[:len(start)]
    start, chosen = start[inside], chosen[inside]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    first, last = start[np.concatenate(([0], new))], start[np.concatenate((new - 1, [len(start) - 1]))]
    gram_at = chosen[np.concatenate(([0], new))]
    h = np.where(gram_at < len(hashes), hashes[np.minimum(gram_at, len(hashes) - 1)], np.uint64(0))
    tail = np.flatnonzero(gram_at >= len(hashes))
    if len(tail):  # grams that start after the last string start
        h[tail] = gram_hashes(codes[len(hashes):], gram)[gram_at[tail] - len(hashes)]
    return h, first, last


class Block:
    """The documents of a block in their order."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("id").to_pylist(), [t or b"" for t in table.column("text").to_pylist()]
        self.rows = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in self.rows], [texts[i] for i in self.rows]

    def slices(self) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """First document, joined texts and their ends, about a megabyte at a time."""
        first, size = 0, 0
        for d, text in enumerate(self.texts):
            size += len(text)
            if size >= SLICE or d + 1 == len(self.texts):
                part = self.texts[first:d + 1]
                yield first, b"".join(part), np.cumsum([len(t) for t in part])
                first, size = d + 1, 0


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _cuts(sorted_buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets with the first and last place of each."""
    new = np.flatnonzero(np.diff(sorted_buckets)) + 1
    first = np.concatenate(([0], new)) if len(sorted_buckets) else new
    return sorted_buckets[first], first, np.concatenate((new, [len(sorted_buckets)])) if len(first) else new


CHOSEN = "bucket long, block long, hashes binary, counts binary"


def _report(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """The hashes that a block chose, with their counts, by bucket."""
        give_back()
        block, found = Block(table), [np.empty(0, np.uint64)]
        for _, data, ends in block.slices():
            found.append(stretches(data, ends)[0])
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        bucket = _bucket(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        hashes, counts = hashes[order], np.minimum(counts[order], 1 << 30).astype(np.uint32)
        which, first, last = _cuts(bucket[order])
        number = table.column("block")[0].as_py()
        return pa.table([pa.array(which, pa.int64()), pa.array([number] * len(which), pa.int64()),
                         pa.array([hashes[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
                         pa.array([counts[a:b].tobytes() for a, b in zip(first, last)], pa.binary())],
                        ["bucket", "block", "hashes", "counts"])

    return run


SHARED = "block long, hashes binary, hot binary"


def _shared(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """For each block of a bucket, its hashes that were chosen at least twice; those chosen too often are hot."""
        give_back()
        lists = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("counts").to_pylist()])
        known, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, counts, len(known))[place]
        ends = np.cumsum([len(x) for x in lists])
        out: list[list] = [[], [], []]
        for number, hashes, n in zip(table.column("block").to_pylist(), lists, np.split(total, ends[:-1])):
            if (n >= 2).any():
                out[0].append(number)
                out[1].append(hashes[n >= 2].tobytes())
                out[2].append(hashes[n > hot].tobytes())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                        ["block", "hashes", "hot"])

    return run


#: A packed row a stretch: key of its strings, order of its document, document in its block, first start, size.
STRETCH = np.dtype([("key", "<u8"), ("known", "u1"), ("id", "<i8"), ("doc", "<u4"), ("start", "<u4"), ("size", "<u2")])
#: A run of bytes to remove from a document of a block.
CUT = np.dtype([("doc", "<u4"), ("start", "<u4"), ("size", "<u4")])
SENT = "bucket long, block long, stretches binary, bytes binary, cuts binary"


def _send(buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        """A block's stretches under shared grams, by bucket; later equal ones are cut at once."""
        give_back()
        names = ["bucket", "block", "stretches", "bytes", "cuts"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        if not docs.num_rows or not replies.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        number = docs.column("block")[0].as_py()
        shared = np.sort(np.frombuffer(b"".join(replies.column("hashes").to_pylist()), np.uint64))
        hot = np.sort(np.frombuffer(b"".join(replies.column("hot").to_pylist()), np.uint64))
        block, seen = Block(docs), set()
        pieces, rows, cuts = [], [], []
        for first_doc, data, ends in block.slices():
            h, first, last = stretches(data, ends)
            keep = _among(h, shared)
            h, first, last = h[keep], first[keep], last[keep]
            if not len(h):
                continue
            warm = _among(h, hot)
            if warm.any():  # each string by itself, under its own hash
                single = ranges(first[warm], last[warm] - first[warm] + 1)
                own = np.array([xxhash.xxh64_intdigest(data[s:s + LENGTH]) for s in single.tolist()], np.uint64)
                h = np.concatenate((h[~warm], own))
                first, last = np.concatenate((first[~warm], single)), np.concatenate((last[~warm], single))
                order = np.argsort(first, kind="stable")
                h, first, last = h[order], first[order], last[order]
            doc = np.searchsorted(ends, first, "right")
            starts = np.concatenate(([0], ends[:-1]))
            fresh = np.ones(len(h), bool)
            for i, (a, b) in enumerate(zip(first.tolist(), (last + LENGTH).tolist())):
                piece = data[a:b]
                if piece in seen:
                    fresh[i] = False
                else:
                    seen.add(piece)
                    pieces.append(piece)
            made = np.empty(len(h), STRETCH)
            made["key"], made["doc"], made["start"] = h, doc + first_doc, first - starts[doc]
            made["size"] = last - first + LENGTH
            ids = [block.ids[d] for d in made["doc"].tolist()]
            made["known"], made["id"] = [i is not None for i in ids], [i or 0 for i in ids]
            rows.append(made[fresh])
            gone = np.empty(int((~fresh).sum()), CUT)
            for name in CUT.names:
                gone[name] = made[name][~fresh]
            cuts.append(gone)
        rows = np.concatenate(rows) if rows else np.empty(0, STRETCH)
        bucket = _bucket(rows["key"], buckets)
        order = np.argsort(bucket, kind="stable")
        rows, which = rows[order], bucket[order]
        order = order.tolist()
        which, first, last = _cuts(which)
        out = [which.tolist(), [number] * len(which), [rows[a:b].tobytes() for a, b in zip(first, last)],
               [b"".join([pieces[i] for i in order[a:b]]) for a, b in zip(first, last)], [b""] * len(which)]
        gone = _joined(np.concatenate(cuts)) if cuts else np.empty(0, CUT)
        if len(gone):
            for column, value in zip(out, (number % buckets, number, b"", b"", gone.tobytes())):
                column.append(value)
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _joined(cuts: np.ndarray) -> np.ndarray:
    """Overlapping and adjacent runs of a document made one."""
    if not len(cuts):
        return cuts
    cuts = cuts[np.lexsort((cuts["start"], cuts["doc"]))]
    base = cuts["doc"].astype(np.int64) << 32
    start, end = base + cuts["start"], base + cuts["start"] + cuts["size"]
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    out = np.empty(len(first), CUT)
    out["doc"], out["start"] = cuts["doc"][first], cuts["start"][first]
    out["size"] = reach[np.concatenate((first[1:] - 1, [len(cuts) - 1]))] - start[first]
    return out


def repeats(rows: np.ndarray, block: np.ndarray, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks and cuts of all strings that also start in an earlier stretch; rows of a key are judged together."""
    # equal stretches of several blocks are one entry, the earliest: all strings of the others start in it
    earliest = np.lexsort((rows["start"], rows["doc"], block, rows["id"], rows["known"])).tolist()
    seen: set[bytes] = set()
    fresh = np.ones(len(rows), bool)
    for i in earliest:
        if pieces[i] in seen:
            fresh[i] = False
        else:
            seen.add(pieces[i])
    later = ~fresh
    if later.any():
        found = np.empty(int(later.sum()), CUT)
        for name in CUT.names:
            found[name] = rows[name][later]
        yield block[later], found
        rows, block, pieces = rows[fresh], block[fresh], [p for p, k in zip(pieces, fresh.tolist()) if k]
    if not len(rows):
        return
    order = np.argsort(rows["key"], kind="stable")
    key, size = rows["key"][order], rows["size"][order].astype(np.int64) + 1
    several = np.concatenate((key[1:] == key[:-1], [False])) | np.concatenate(([False], key[1:] == key[:-1]))
    order, key, size = order[several], key[several], size[several]  # a lone stretch has no partner
    if not len(order):
        return
    new = np.concatenate(([True], key[1:] != key[:-1]))
    before = np.cumsum(size) - size
    part = before[new][np.cumsum(new) - 1] // SYMBOLS  # by the place where the key begins: keys stay whole
    for mine in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        some, lengths = rows[mine], rows["size"][mine].astype(np.int64)
        text = b"\0".join([pieces[i] for i in mine.tolist()]) + b"\0"
        codes = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
        begin = np.cumsum(lengths + 1) - lengths - 1
        codes[begin + lengths] = 0
        suffix, number = repeated_classes(codes, LENGTH)
        owner = np.searchsorted(begin, suffix, "right") - 1
        offset = suffix - begin[owner]
        whole = offset + LENGTH <= lengths[owner]
        owner, offset, number = owner[whole], offset[whole], number[whole]
        where = some["start"][owner].astype(np.int64) + offset
        at = np.lexsort((where, some["doc"][owner], block[mine][owner], some["id"][owner], some["known"][owner], number))
        later = at[1:][number[at[1:]] == number[at[:-1]]]
        found = np.empty(len(later), CUT)
        found["doc"], found["start"], found["size"] = some["doc"][owner[later]], where[later], LENGTH
        yield block[mine][owner[later]], found


CUTS = "block long, cuts binary"


def _judge(table: pa.Table) -> pa.Table:
    """The cuts that a bucket's stretches lead to, by block; those already made are passed on."""
    give_back()
    rows = [np.frombuffer(b, STRETCH) for b in table.column("stretches").to_pylist()]
    numbers = table.column("block").to_pylist()
    block = np.repeat(np.array(numbers, np.int64), [len(r) for r in rows])
    pieces: list[bytes] = []
    for r, data in zip(rows, table.column("bytes").to_pylist()):
        ends = np.cumsum(r["size"].astype(np.int64)).tolist()
        pieces += [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    out = [(n, c) for n, c in zip(numbers, table.column("cuts").to_pylist()) if c]
    found = [(np.empty(0, np.int64), np.empty(0, CUT)), *repeats(np.concatenate(rows), block, pieces)]
    owner, cuts = np.concatenate([o for o, _ in found]), np.concatenate([c for _, c in found])
    order = np.argsort(owner, kind="stable")
    which, first, last = _cuts(owner[order])
    cuts = cuts[order]
    out += [(int(n), _joined(cuts[a:b]).tobytes()) for n, a, b in zip(which, first, last)]
    return pa.table([pa.array([n for n, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], ["block", "cuts"])


def _finish(kept: list[str]):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        """The documents of a block with their runs of removed bytes and the text that is left."""
        give_back()
        block = Block(docs)
        cuts = _joined(np.frombuffer(b"".join(replies.column("cuts").to_pylist()), CUT)) if replies.num_rows else np.empty(0, CUT)
        edges = np.searchsorted(cuts["doc"], np.arange(len(block.ids) + 1))
        left, n_removed, n_spans = [], [], []
        for d, text in enumerate(block.texts):
            mine = cuts[edges[d]:edges[d + 1]]
            parts, at = [], 0
            for start, size in zip(mine["start"].tolist(), mine["size"].tolist()):
                parts.append(text[at:start])
                at = start + size
            left.append(b"".join([*parts, text[at:]]))
            n_removed.append(len(text) - len(left[-1]))
            n_spans.append(len(mine))
        taken = docs.take(pa.array(block.rows, pa.int64()))
        return pa.table([*(taken.column(c) for c in kept), pa.array([len(t) for t in block.texts], pa.int64()),
                         pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(left, pa.binary())],
                        [*kept, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
                   hot: int = HOT) -> DataFrame:
    """id, row (the other columns, by position), n_bytes, n_removed, n_spans and kept (the bytes left) of each row."""
    names = docs.columns
    flat = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    others = [F.col(f"_c{i}") for i, n in enumerate(names) if n not in (doc_id, text)]
    base = flat.select(
        F.col(f"_c{names.index(doc_id)}").cast("long").alias("id"),
        F.col(f"_c{names.index(text)}").cast("binary").alias("text"),
        F.struct(*others, F.col(f"_c{names.index(text)}").isNull().alias("no_text")).alias("row"))
    base, blocks = blocked(base, block_bytes)
    by_block = base.groupBy("block")
    chosen = by_block.applyInArrow(_report(blocks), CHOSEN)
    shared = chosen.groupBy("bucket").applyInArrow(_shared(hot), SHARED)
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send(4 * blocks), SENT)
    cuts = sent.groupBy("bucket").applyInArrow(_judge, CUTS)
    shape = base.select("id", "row").withColumns(
        {n: F.lit(0).cast("long") for n in ("n_bytes", "n_removed", "n_spans")}).withColumn("kept", F.lit(None).cast("binary"))
    return base.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_finish(["id", "row"]), shape.schema)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    return repeated_bytes(docs, **options).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the bytes left as their text.

    Where a cut parts a character, its bytes that are left are dropped. Texts that lose nothing stay as they
    are, null texts stay null.
    """
    found = repeated_bytes(docs, doc_id, text, **options)
    names, kinds = docs.columns, dict(docs.dtypes)
    return _as_text(found).select(*(
        F.col("id").cast(kinds[n]).alias(n) if n == doc_id
        else F.when(~F.col("row.no_text"), F.col("left")).alias(n) if n == text
        else F.col(f"row._c{i}").alias(n) for i, n in enumerate(names)))


def _as_text(found: DataFrame) -> DataFrame:
    frame = found.select("id", "row", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            left = [t.decode("utf-8", "ignore") for t in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(left, pa.string())], ["id", "row", "left"])

    return frame.mapInArrow(run, frame.select("id", "row", F.lit("").alias("left")).schema)
