"""Joins with a checked broadcast.

Dimension tables built from fixed lists (channels, labels, phases,
severities) have a fixed size and are always broadcast.  Tables whose
size depends on the data (flight ids, per-flight statistics, TPC-H-like
dimensions) are broadcast only when the optimizer's size estimate is below
a bound; above it the join stays a shuffle join, and AQE may still switch
it to a broadcast once it has measured the real size at runtime.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def threshold_bytes(spark) -> int:
    """The session's ``spark.sql.autoBroadcastJoinThreshold`` in bytes; -1 switches broadcasts off."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    units = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}
    number = text.rstrip("bkmgt")
    return int(number) << units.get(text[len(number):] or "b", 0) if not number.startswith("-") else -1


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (None when unavailable)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - estimate is advisory
        return None


#: Bytes of a table that a task takes on average where a shuffle gathers whole groups.
PART_BYTES = 32 << 20


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Shuffle partitions that grow with a table: one for ``part_bytes`` of its known size, the session's number at least.

    A plan without statistics (its estimate is the largest long) gets the session's number.
    """
    size = estimated_bytes(df) or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes) if size < 1 << 50 else 1)


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``F.broadcast(df)`` when its estimated size is at most ``max_bytes``, else ``df`` unchanged."""
    if max_bytes is None:
        max_bytes = threshold_bytes(df.sparkSession)
    size = estimated_bytes(df)
    return F.broadcast(df) if size is not None and 0 <= size <= max_bytes else df


def lookup_with_fallback(df: DataFrame, dim: DataFrame, left_key: str, dim_key: str, value: str, out: str,
                         fallback=None, max_bytes: int | None = None) -> DataFrame:
    """C5 on a table: left join a dimension (checked broadcast) and fall back when the key is unknown.

    ``fallback``: a Column (for instance the key as text) or a literal; default the key as text.
    """
    d = broadcast_if_small(dim.select(F.col(dim_key).alias("_dk"), F.col(value).alias("_dv")), max_bytes)
    fb = F.col(left_key).cast("string") if fallback is None else (
        fallback if isinstance(fallback, F.Column) else F.lit(fallback))
    j = df.join(d, df[left_key] == d["_dk"], "left")
    return j.withColumn(out, F.coalesce(F.col("_dv"), fb)).drop("_dk", "_dv")


def settled(df: DataFrame, name: str, max_rows: int = 65_536) -> DataFrame:
    """The rows of a result that is small by nature (a fitted model, chunk edges), computed now.

    Up to ``max_rows`` rows become a local relation; more are written as a table under the checkpoint folder. Either way
    the next plan knows the exact size, so a broadcast can be decided by it, and the result is not computed again
    by each reader.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        return df.sparkSession.createDataFrame(rows, schema=df.schema)
    return materialize(df, name)


#: Parts that a task gets on average when hot keys are cut, so that their sizes even out.
PARTS_A_TASK = 8


def _same(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_j_{n}")) for n in names))


def skew_join(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, how: str = "inner",
              tasks: int | None = None) -> DataFrame:
    """Join rows with a table of one row per key; keys are cut by their measured share of all rows.

    ``count`` (a column of ``per_key``, the aggregate that is computed anyway) tells how many rows a key has.  A key that
    holds more than one part in ``tasks`` x ``PARTS_A_TASK`` of all rows gets as many salts as it holds such parts: its rows are
    dealt out by a hash of the row, which does not change when a task is run again, and its one row is copied to each
    salt.  All other keys have one salt and no copies.  Hot keys are fewer than ``tasks`` x ``PARTS_A_TASK`` by their
    definition, so their list is broadcast.  Keys are compared null-safely: rows with a NULL key meet the row of the NULL key.

    Returns the columns of ``rows`` and those of ``per_key`` other than the keys.
    """
    spark = rows.sparkSession
    parts = (tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))) * PARTS_A_TASK
    total = per_key.agg(F.sum(count)).scalar()
    salts = F.greatest(F.ceil(F.col(count) * F.lit(parts) / F.greatest(total, F.lit(1))).cast("int"), F.lit(1))
    others = [c for c in per_key.columns if c not in keys]
    one = per_key.select(*(F.col(k).alias(f"_j_{k}") for k in keys), *others, salts.alias("_salts"))
    hot = F.broadcast(one.where(F.col("_salts") > 1).select(*(f"_j_{k}" for k in keys), "_salts"))
    dealt = rows.join(hot, _same(keys), "left").select(
        *rows.columns, F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int"), F.lit(0)).alias("_salt"))
    copies = one.select(*(f"_j_{k}" for k in keys), *others, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_j__salt"))
    return dealt.join(copies, _same([*keys, "_salt"]), how).select(*rows.columns, *others)
