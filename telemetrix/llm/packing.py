"""Blocks of documents and packed sorted hashes that travel between blocks and buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import text_bytes


def blocked(frame: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """A frame of id, text and other columns dealt into blocks of about ``block_bytes`` of text; adds block.

    Rows of an id share a block; rows without an id are dealt by their text. The exchange has at least the
    session's number of shuffle partitions, so that joins by block use it as it is.
    """
    blocks = max(1, -(-text_bytes(frame) // block_bytes))
    spread = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    parts = max(blocks, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return frame.select(F.pmod(spread, F.lit(blocks)).alias("block"), *frame.columns).repartition(parts, "block"), blocks


def packed_blocks(frame: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """As ``blocked``, but the rows of a block travel as compressed batches (block, rows); ``rows_of`` reads them.

    Texts of a task that go to the same block are compressed together, which halves what is shuffled.
    """
    blocks = max(1, -(-text_bytes(frame) // block_bytes))
    spread = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    parts = max(blocks, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.asarray(batch.column("block"))
            order = np.argsort(block, kind="stable")
            rows = batch.select(names).take(pa.array(order))
            which, first = np.unique(block[order], return_index=True)
            out = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
                out.append(packed_rows(pa.Table.from_batches([rows.slice(a, b - a)])))
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(out, pa.binary())], ["block", "rows"])

    dealt = frame.select(F.pmod(spread, F.lit(blocks)).alias("block"), *names)
    return dealt.mapInArrow(run, "block long, rows binary").repartition(parts, "block"), blocks


def packed_rows(table: pa.Table) -> bytes:
    """Rows as one compressed batch."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def rows_of(table: pa.Table) -> pa.Table:
    """The rows of a block's compressed batches."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in table.column("rows").to_pylist()])


def pack(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Numbers as compressed byte planes; sorted ones as differences."""
    if sorted_:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: type, sorted_: bool = False) -> np.ndarray:
    """The numbers of ``pack``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if sorted_ else values
