"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A 64-bit fingerprint is eight bytes. Fingerprints that differ in at most four bits agree in at least
8 - 4 = 4 byte positions, so only pairs that reach this tally are verified. The postings of a
(position, byte) list are met three positions at a time: a Turan system of 20 triples has one inside any four
positions, so every pair with the guaranteed tally meets in some list, and lists stay short.

Scale: equal fingerprints are one entry (partial aggregate), so copies never meet. Lists are built by a shuffle
on (triple, bytes), sorted by Spark and streamed, one list in memory at a time. A list gives the
links of a spanning forest of its members, not all their pairs: a member is only compared with those not
yet reached, so a dense group costs little more than its size. Links become components in
``components``; nothing is collected.

Edge cases: null and empty texts have no words and the fingerprint zero, which is linked like any other. Rows that
share an id are one node (linked by the id). A null id has a fingerprint, no links and a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import checkpointed, give_back, parts, pick, unwrap, wrap
from telemetrix.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
BYTES = 8


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: majority bits of the XXH64 of its word shingles; zero without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        pieces = [joined]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        pieces = [joined[a:b] for a, b in zip(starts, ends[shingle - 1:].tolist())]
    digest, n = xxhash.xxh64_intdigest, len(pieces)
    hashes = np.fromiter((digest(p, SEED) for p in pieces), np.uint64, n)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(frame: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of a frame of id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in parts(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()),
                             np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    frame = frame.select("id", F.col("text").cast("binary").alias("text"))
    return frame.mapInArrow(run, frame.select("id", F.lit(0).cast("long").alias("fp")).schema)


def meeting_sets(positions: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any four positions contain one: 20 triples, or all 70 fours."""
    if positions == 4:
        return list(combinations(range(BYTES), 4))
    groups = [range(0, 3), range(3, 6), range(6, 8)]
    inside = [c for g in groups for c in combinations(g, 3)]
    return inside + [(*two, one) for i, g in enumerate(groups) for two in combinations(g, 2) for one in groups[(i + 1) % 3]]


def links(entries: DataFrame, distance: int = DISTANCE, positions: int = 3) -> DataFrame:
    """Links (a, b) between the ids of entries (id, fp) whose fingerprints differ in at most ``distance`` bits.

    Pairs left out are joined by a chain of links inside a list, so components are whole.
    """
    if distance > DISTANCE:
        raise ValueError(f"the lists guarantee a meeting up to {DISTANCE} differing bits")
    keys = [
        F.struct(F.lit(k).alias("s"), sum(
            (F.shiftleft(F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * j) for j, p in enumerate(chosen)),
            F.lit(0).cast("long")).alias("key"))
        for k, chosen in enumerate(meeting_sets(positions))]
    lists = (entries.select("id", "fp", F.explode(F.array(*keys)).alias("k"))
             .select("k.s", "k.key", "fp", "id").repartition("s", "key").sortWithinPartitions("s", "key", "fp"))
    kind = entries.schema["id"].dataType.simpleString()
    return lists.mapInArrow(_forests(distance), f"a {kind}, b {kind}").distinct()


def _forests(distance: int):
    least_shared = BYTES - distance

    def near(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        apart = np.bitwise_xor(one, others)
        shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)  # tally of positional bytes
        found = np.flatnonzero(shared >= least_shared)
        return found[np.bitwise_count(apart[found]) <= distance]

    def forest(fp: np.ndarray) -> Iterator[tuple[int, int]]:
        rest = np.arange(len(fp))
        while len(rest):
            waiting, rest = [rest[0]], rest[1:]
            while waiting and len(rest):
                one = waiting.pop()
                hit = near(fp[one], fp[rest])
                for other in rest[hit].tolist():
                    yield one, other
                    waiting.append(other)
                rest = np.delete(rest, hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: list[pa.RecordBatch] = []
        names = ["a", "b"]

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            s, key = np.asarray(table.column("s")), np.asarray(table.column("key"))
            fp, ids = np.asarray(table.column("fp")).view(np.uint64), table.column("id").combine_chunks()
            new = np.flatnonzero((np.diff(s) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(s)]))
            one, other = [], []
            two = np.flatnonzero(ends - starts == 2)
            apart = fp[starts[two]] ^ fp[starts[two] + 1]
            shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            for a in starts[two[(shared >= least_shared) & (np.bitwise_count(apart) <= distance)]].tolist():
                one.append(a)
                other.append(a + 1)
            for at in np.flatnonzero(ends - starts > 2).tolist():
                for a, b in forest(fp[starts[at]:ends[at]]):
                    one.append(starts[at] + a)
                    other.append(starts[at] + b)
            if one:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(one)), ids.take(pa.array(other))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            s, key = np.asarray(batch.column("s")), np.asarray(batch.column("key"))
            last = np.flatnonzero((s != s[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if len(held) > 1:
                same = held[-2].column("s")[-1] == batch.column("s")[0] and held[-2].column("key")[-1] == batch.column("key")[0]
                if not same:
                    yield from emit(pa.Table.from_batches(held[:-1]))
                    held = [batch]
            if cut:
                yield from emit(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from emit(pa.Table.from_batches(held))

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (smallest id reachable over links) of each row."""
    prints = checkpointed(fingerprints(pick(docs, id=doc_id, text=text), shingle))
    known = prints.where("id is not null")
    entries = checkpointed(known.groupBy("fp").agg(F.min("id").alias("id")))
    same_id = known.distinct().join(entries.withColumnRenamed("id", "first"), "fp").where("id <> first")
    repeated = known.distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    more = same_id.join(repeated, "id", "left_semi").select(F.col("id").alias("a"), F.col("first").alias("b"))
    positions = 3 if entries.count() < 1 << 27 else 4
    labels = components(links(entries, distance, positions).union(more))
    named = entries.join(labels, F.col("id") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        F.col("id").alias("doc_id"), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
               distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one: that of its smallest id.

    Rows without an id all stay. Of rows that share the smallest id, the one with the first text stays.
    """
    found = near_duplicates(docs, doc_id, text, shingle, distance)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = wrap(docs, id=doc_id, text=text)
    named = rows.where("id is not null").join(kept, F.col("id") == F.col("kept"), "left_semi")
    first = named.groupBy("id").agg(F.min_by("row", F.struct(F.col("text").isNull(), "text")).alias("row"))
    return unwrap(first.select("row").union(rows.where("id is null").select("row")), docs.columns)
