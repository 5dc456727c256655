"""Helpers shared by the operators: columns picked by exact name, whole rows carried along, shared folder."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **named: str) -> DataFrame:
    """Columns of ``df`` under new names: ``pick(df, id="doc_id")``.

    Names are matched exactly and resolved by position, so extra columns whose
    names differ only in case, or equal the operators' own names, do no harm.
    """
    names = df.columns
    flat = df.toDF(*(f"_c{i}" for i in range(len(names))))
    return flat.select(*(F.col(f"_c{names.index(source)}").alias(alias) for alias, source in named.items()))


def wrap(df: DataFrame, **named: str) -> DataFrame:
    """``pick`` plus the whole input row as the struct ``row``; ``unwrap`` gives the row back."""
    names = df.columns
    flat = df.toDF(*(f"_c{i}" for i in range(len(names))))
    return flat.select(
        F.struct(*(F.col(f"_c{i}") for i in range(len(names)))).alias("row"),
        *(F.col(f"_c{names.index(source)}").alias(alias) for alias, source in named.items()),
    )


def unwrap(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The columns of the wrapped rows in their order; ``replaced`` gives new values by name."""
    return df.select(*(
        (replaced[name] if name in replaced else F.col(f"row._c{i}")).alias(name)
        for i, name in enumerate(names)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own (tests); any other master raises, as
    executors could not read one another's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get()
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        return context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, one aggregate over the column."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def crc_fold(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")) % folds


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + length), one range after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def parts(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that only little of a batch is held as Python objects."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def slices(texts: list, limit: int = 4 << 20):
    """(first, last) of runs of texts with about ``limit`` bytes each, so that work arrays stay small."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def give_back() -> None:
    """Return freed memory to the system. Worker processes are reused, so what one stage has freed would stand beside what the
    next one needs; called where a task or a group begins. Where the C library cannot trim, only Arrow's pool does."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
