"""Skew-safe ordered scans over long per-key series.

A plain ``Window.partitionBy(flight)`` puts a whole flight into one task.
If one flight (or user) holds a large share of all rows, that task
becomes the job.  These helpers split every key into *chunks* of a bounded
number of rows (:func:`row_chunks`, or a column of the caller that is
monotone in the series order), run the window inside ``(key, chunk)``
partitions, and carry state between chunks through a small per-chunk
summary table that is joined back on ``(key, chunk)``.  The summary has
one row per chunk, so it is tiny compared to the data; AQE turns the
join-back into a broadcast when the runtime size allows and otherwise keeps
a shuffle join on a composite key that has no hot value.

With a chunk column that is constant per key the helpers reduce to the
usual per-key window; tests check both give the same answer.

NULL keys are a key like any other: windows and joins run on the key's value
and whether it is missing, so no row is lost.  NULL order values come last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import broadcast_if_small, settled, skew_join, threshold_bytes

CHUNK = "_chunk"
_UNB = Window.unboundedPreceding
_UNF = Window.unboundedFollowing

# Default chunk width in series steps (seconds for 1 Hz sensor data).
DEFAULT_CHUNK_STEPS = 4096


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def step_chunk(t, width: int = DEFAULT_CHUNK_STEPS) -> Column:
    """Chunk id for an integer step column: floor(t / width)."""
    return F.floor(_c(t) / F.lit(int(width))).cast("long")


def _or_last(chunk: Column) -> Column:
    """Rows without an order value form a last chunk of their own, so that joins by chunk keep them."""
    return F.coalesce(chunk, F.lit((1 << 62)))


def _last(order: Sequence) -> list[Column]:
    """Order columns with missing values last; expressions are taken as they are."""
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


KEYS = ["_key", "_no_key"]


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Adds the key as two columns that are never NULL, so that plain equality, on which windows, aggregates and
    joins share one partitioning, also holds for missing keys."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.BooleanType)):
        some = "" if isinstance(kind, T.StringType) else "1970-01-01" if isinstance(kind, (T.DateType, T.TimestampType)) else 0
        return df.withColumns({"_key": F.coalesce(F.col(key), F.lit(some).cast(kind)), "_no_key": F.col(key).isNull()})
    return df.withColumns({"_key": F.struct(key), "_no_key": F.col(key).isNull()})


def key_again(df: DataFrame, key: str) -> Column:
    value = F.col("_key")[key] if isinstance(df.schema["_key"].dataType, T.StructType) else F.col("_key")
    return F.when(~F.col("_no_key"), value).alias(key)


#: Rows of a chunk on average, and rows drawn to place its edges; a chunk of n drawn rows strays by its root only.
MAX_ROWS = 1 << 19
DRAWN = 64
#: Edges of one key that the binary search can tell apart, as a power of two.
EDGE_BITS = 24


def chunk_edges(df: DataFrame, key: str, order: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """key, edges: for each key of more than about ``max_rows`` rows, order values that cut it into chunks of so many.

    Of the rows, ``DRAWN`` in ``max_rows`` are drawn by a hash of key and order values, so that the same rows are drawn when
    a task is run again; sorted within the key, every ``DRAWN``-th is an edge.  Edges are whole order tuples: rows tied in the
    first column are cut by the next.  The draw is one pass over the key and order columns, and only drawn rows are shuffled.
    """
    scale = 1 << 31
    hit = F.pmod(F.xxhash64(F.lit("edges"), key, *order), F.lit(scale)) < F.lit(min(scale, scale * DRAWN // max_rows))
    drawn = keyed(df.select(key, *order).where(hit), key).select(*KEYS, _tuple(order).alias("edge"))
    w = Window.partitionBy(*KEYS).orderBy("edge")
    cut = drawn.withColumn("_n", F.row_number().over(w)).where(F.col("_n") % F.lit(DRAWN) == 0).select(*KEYS, "edge")
    return cut.select(key_again(cut, key), "edge")


def _tuple(order: Sequence[str]) -> Column:
    """The order values as one comparable value, missing ones last."""
    return F.struct(*(x for i, o in enumerate(order) for x in (F.col(o).isNull().alias(f"n{i}"), F.col(o).alias(f"v{i}"))))


def row_chunks(df: DataFrame, key: str, order: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds ``_chunk``: numbers along ``order`` within the key, each of about ``max_rows`` rows and, but for a chance of one in
    a billion, none of twice as many, however the rows are spread over keys, time and tied values.

    Rows equal in all order columns share a chunk (``order`` should be a total order).  The edges are settled first (:func:`_edges`).
    Without any, no key is long and the chunk is the constant 0; else each row looks up
    its place among its key's edges by a binary search.  The edges, one in ``max_rows`` rows, are broadcast while they
    are below the session's limit and meet the rows by a skew-cut join beyond.
    """
    found = _edges(df, key, order, max_rows)
    return df.withColumn(CHUNK, F.lit(0).cast("long")) if found is None else _placed(df, found, key, order)


def _edges(df: DataFrame, key: str, order: Sequence[str], max_rows: int) -> DataFrame | None:
    """The settled edges; None where no key has more than ``max_rows`` rows, which a count of the key column alone tells."""
    longest = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if (longest or 0) <= max_rows:
        return None
    found = settled(chunk_edges(df, key, order, max_rows), "edges")
    return None if found.isEmpty() else found


def _placed(df: DataFrame, found: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    per_key = found.groupBy(key).agg(F.sort_array(F.collect_list("edge")).alias("_edges"),
                                     F.count(F.lit(1)).alias("_cuts"))
    small = broadcast_if_small(found, threshold_bytes(df.sparkSession))
    if small is not found:
        e = per_key.select(F.col(key).alias("_ekey"), "_edges")
        met = df.join(F.broadcast(e), F.col(key).eqNullSafe(F.col("_ekey")), "left").drop("_ekey")
    else:
        met = skew_join(df, per_key, [key], "_cuts", "left")
    here = _tuple(order)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(EDGE_BITS))])
    place = F.transform(F.array(here), lambda x: F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get("_edges", at + step - 1) <= x, at + step).otherwise(at)))[0]
    return met.withColumn(CHUNK, F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(place).cast("long")).drop("_edges", "_cuts")


def _names(order: Sequence) -> list[str]:
    return [o for o in order if isinstance(o, str)]


def _chunked(df: DataFrame, key: str, order: Sequence, chunk: Column | None, max_rows: int) -> DataFrame:
    if chunk is not None:
        return df.withColumn(CHUNK, _or_last(chunk))
    return row_chunks(df, key, _names(order), max_rows)


def _all_rows(w) -> Column:
    """Rows of the window's partition, over the sort that its other functions use."""
    return F.count(F.lit(1)).over(w.rowsBetween(_UNB, _UNF)).cast("int")


def dense_index(df: DataFrame, key: str, order: Sequence, chunk: Column | None = None,
                out: str = "t", length_col: str | None = None, keep_chunk: bool = False,
                max_rows: int = MAX_ROWS) -> DataFrame:
    """0-based dense position of each row within its key, by ``order``.

    ``order`` must be a total order within the key (add a tie-breaker).
    ``chunk`` must be non-decreasing along it; None cuts keys into chunks of
    about ``max_rows`` rows (:func:`row_chunks`; ``order`` then holds column
    names).  Optionally adds the key's total row count as ``length_col``.
    With ``keep_chunk`` the chunk column stays (as ``_chunk``).

    Where no key is long, a key is one window: one shuffle and one sort, without a chunk table.  Else the chunk table counts
    rows on the map side, so the rows are shuffled once as well.
    """
    last = ([length_col] if length_col else []) + [out]
    names = [*([CHUNK] if keep_chunk else []), *[c for c in df.columns if c not in (CHUNK, *last)], *last]
    if chunk is None:
        edges = _edges(df, key, _names(order), max_rows)
        if edges is None:
            w = Window.partitionBy(key).orderBy(*_last(order))
            return df.select(*[c for c in df.columns if c not in (CHUNK, *last)], F.lit(0).cast("long").alias(CHUNK),
                             *([_all_rows(w).alias(length_col)] if length_col else []),
                             (F.row_number().over(w) - 1).cast("int").alias(out)).select(*names)
        base = keyed(_placed(df, edges, key, _names(order)), key)
    else:
        base = keyed(df.withColumn(CHUNK, _or_last(chunk)), key)
    local = base.withColumn("_rn", F.row_number().over(
        Window.partitionBy(*KEYS, CHUNK).orderBy(*_last(order))))
    sizes = base.groupBy(*KEYS, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(*KEYS).orderBy(CHUNK)
    offs_cols = [*KEYS, CHUNK,
                 F.coalesce(F.sum("_n").over(wk.rowsBetween(_UNB, -1)), F.lit(0)).alias("_off")]
    if length_col:
        offs_cols.append(F.sum("_n").over(Window.partitionBy(*KEYS)).cast("int").alias(length_col))
    offs = sizes.select(*offs_cols)
    res = (local.join(offs, [*KEYS, CHUNK])
           .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("int")))
    return res.select(*names)


def fill_forward_backward(df: DataFrame, key: str, t: str, chunk: Column | None,
                          cols: Sequence[str], default: float | None = 0.0) -> DataFrame:
    """Forward fill, then backward fill, then ``default`` (ffill().bfill().fillna()).

    The fill order per value: last non-null at or before t (this chunk),
    last non-null of an earlier chunk, first non-null at or after t (this
    chunk), first non-null of a later chunk, default.  ``chunk=None`` reuses
    an existing ``_chunk`` column (monotone in ``t``).
    """
    cols = list(cols)
    base = keyed(df if chunk is None else df.withColumn(CHUNK, _or_last(chunk)), key)
    joined = _forward(base, [F.col(t).asc_nulls_last()], cols).join(_carried(base, t, cols), [*KEYS, CHUNK])
    return _filled(joined, cols, default).select(*[c for c in df.columns if c != CHUNK])


def _forward(base: DataFrame, order: list[Column], cols: Sequence[str], *more: Column) -> DataFrame:
    """Forward fill inside the chunk, as a running frame over one sort."""
    w = Window.partitionBy(*KEYS, CHUNK).orderBy(*order).rowsBetween(_UNB, 0)
    return base.select("*", *more, *[F.last(c, True).over(w).alias(f"_ff_{i}") for i, c in enumerate(cols)])


def _carried(rows: DataFrame, at: str, cols: Sequence[str], *more: Column) -> DataFrame:
    """Per (key, chunk): the last non-null value of each column before the chunk, the first one in it and the first after it.

    max_by / min_by over the position ``at`` keep the summary on a hash aggregate with fixed-width buffers.
    """
    n = range(len(cols))
    summ = rows.groupBy(*KEYS, CHUNK).agg(
        *more,
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_l_{i}") for i, c in enumerate(cols)],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_f_{i}") for i, c in enumerate(cols)])
    wk = Window.partitionBy(*KEYS).orderBy(F.col(CHUNK))
    wr = Window.partitionBy(*KEYS).orderBy(F.col(CHUNK).desc())
    sizes = [F.coalesce(F.sum("_n").over(wk.rowsBetween(_UNB, -1)), F.lit(0)).alias("_off"),
             F.sum("_n").over(Window.partitionBy(*KEYS)).cast("int").alias("_len")] if more else []
    return summ.select(
        *KEYS, CHUNK, *sizes, *[f"_f_{i}" for i in n],
        *[F.last(f"_l_{i}", True).over(wk.rowsBetween(_UNB, -1)).alias(f"_ci_{i}") for i in n],
        *[F.last(f"_f_{i}", True).over(wr.rowsBetween(_UNB, -1)).alias(f"_co_{i}") for i in n])


def _filled(df: DataFrame, cols: Sequence[str], default: float | None, parts: Sequence[str] = ("ff", "ci", "f", "co")) -> DataFrame:
    """A value at or before in the chunk, one of an earlier chunk, and else the next one: where nothing stands at or before a
    row, the next value in the chunk is the first one in it, so the backward fill needs no window of its own."""
    rest = [] if default is None else [F.lit(float(default))]
    return df.withColumns({c: F.coalesce(*[F.col(f"_{p}_{i}") for p in parts], *rest) for i, c in enumerate(cols)})


def running_sum(df: DataFrame, key: str, order: Sequence, chunk: Column | None, value: Column | str,
                out: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` within ``key``."""
    base = keyed(_chunked(df, key, order, chunk, max_rows), key).withColumn("_v", _c(value))
    local = base.withColumn("_cs", F.sum("_v").over(
        Window.partitionBy(*KEYS, CHUNK).orderBy(*_last(order)).rowsBetween(_UNB, 0)))
    tot = local.groupBy(*KEYS, CHUNK).agg(F.sum("_v").alias("_tot"))
    offs = tot.select(*KEYS, CHUNK, F.coalesce(
        F.sum("_tot").over(Window.partitionBy(*KEYS).orderBy(CHUNK).rowsBetween(_UNB, -1)),
        F.lit(0)).alias("_off"))
    return (local.join(offs, [*KEYS, CHUNK])
            .select(*[c for c in df.columns if c not in (CHUNK, out)], (F.col("_off") + F.col("_cs")).alias(out)))


def with_halo(df: DataFrame, t: str, width: int, before: int, after: int) -> DataFrame:
    """Copy rows near chunk edges into the neighbouring chunk.

    Adds ``_chunk`` (floor(t/width)) and ``_home`` (true for the row's own
    chunk).  A window ``partitionBy(key, _chunk)`` with a frame of at most
    ``before`` rows back and ``after`` rows ahead then sees every row it
    needs; keep only ``_home`` rows afterwards.  ``t`` must be dense.
    """
    if before >= width or after >= width:
        raise ValueError("halo larger than the chunk width")
    tc = F.col(t)
    home = F.floor(tc / F.lit(width)).cast("long")
    pos = tc - home * F.lit(width)
    targets = F.array(
        F.struct(home.alias("c"), F.lit(True).alias("h")),
        F.when(pos >= F.lit(width - before), F.struct((home + 1).alias("c"), F.lit(False).alias("h"))),
        F.when(pos < F.lit(after), F.struct((home - 1).alias("c"), F.lit(False).alias("h"))),
    )
    exploded = df.withColumn("_tgt", F.explode(F.filter(targets, lambda x: x.isNotNull())))
    return (exploded.withColumn(CHUNK, F.col("_tgt.c")).withColumn("_home", F.col("_tgt.h"))
            .drop("_tgt"))


def ordered_fill(df: DataFrame, key: str, order: Sequence[str], chunk: Column | None, cols: Sequence[str],
                 values: dict | None = None, default: float | None = 0.0, out: str = "t",
                 length_col: str = "n_rows", max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """Dense step index and forward/backward fill in one shuffle of the rows.

    ``order``: ascending column names (a total order per key); ``chunk`` as for :func:`dense_index`;
    ``values``: optional row-wise expressions applied to the channels before the fill (for instance
    clipping).  Where no key is long, a key is one window, and the rows are shuffled and sorted once.  Else they are cut into
    chunks and shuffled once by (key, chunk); the chunk summary (row count, last and first non-null value per channel) reads the
    same exchange, for which both sides use the same columns (the key is taken from ``KEYS`` again).

    Returns (rows with ``out`` and ``length_col``, one row per key with its length).
    """
    cols = list(cols)
    ordered = _last(order)
    names = [c for c in df.columns if c not in (CHUNK, out, length_col)]
    edges = None
    if chunk is None:
        edges = _edges(df, key, _names(order), max_rows)
        if edges is None:
            return _fill_whole(df.select(*names).withColumns(values or {}), key, ordered, cols, default, out, length_col)
        placed = _placed(df, edges, key, _names(order))
    else:
        placed = df.withColumn(CHUNK, _or_last(chunk))
    base = keyed(placed, key).withColumns(values or {})
    base = base.select(*KEYS, CHUNK, *[c for c in names if c != key])
    number = F.row_number().over(Window.partitionBy(*KEYS, CHUNK).orderBy(*ordered)).alias("_rn")
    carry = _carried(base.select("*", number), "_rn", cols, F.max("_rn").alias("_n"))
    j = _forward(base, ordered, cols, number).join(carry, [*KEYS, CHUNK]).withColumns({
        out: (F.col("_off") + F.col("_rn") - 1).cast("int"), length_col: F.col("_len")})
    filled = _filled(j, cols, default)
    rows = filled.select(*[key_again(filled, key) if c == key else c for c in names], out, length_col)
    lengths = carry.groupBy(*KEYS).agg(F.max("_len").alias(length_col))
    return rows, lengths.select(key_again(lengths, key), length_col)


def _fill_whole(df: DataFrame, key: str, ordered: list[Column], cols: Sequence[str], default: float | None, out: str,
                length_col: str) -> tuple[DataFrame, DataFrame]:
    """:func:`ordered_fill` where each key is one window; the lengths are a count of the key column."""
    w = Window.partitionBy(key).orderBy(*ordered)
    j = df.select("*", (F.row_number().over(w) - 1).cast("int").alias(out), _all_rows(w).alias(length_col),
                  *[F.last(c, True).over(w.rowsBetween(_UNB, 0)).alias(f"_ff_{i}") for i, c in enumerate(cols)],
                  *[F.first(c, True).over(w.rowsBetween(_UNB, _UNF)).alias(f"_f_{i}") for i, c in enumerate(cols)])
    rows = _filled(j, cols, default, ("ff", "f")).select(*df.columns, out, length_col)
    return rows, df.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias(length_col))
