"""Population stability index per channel.

One pass over the tagged union of both sides: the joint min/max per
channel is a global aggregate (one row); the bin of every value is a
row-wise expression; the (side, channel, bin) counts come from one
partial-aggregating group-by, whose map-side combine leaves at most
2 x channels x bins rows to shuffle.  Only tiny tables are joined.

Bin edges follow NumPy's ``linspace`` + ``histogram``: edge_i = lo + i*step,
last bin closed, and when lo == hi every value falls in the last bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims


def tag_sides(expected: DataFrame, actual: DataFrame, channels: Sequence[str]) -> DataFrame:
    """G1: union of the two inputs with a side tag."""
    cols = list(channels)
    return (expected.select(*cols, F.lit("expected").alias("side"))
            .unionByName(actual.select(*cols, F.lit("actual").alias("side"))))


def tag_split_sides(df: DataFrame, channels: Sequence[str], split: str = "split", expected: str = "train",
                    actual: str = "test") -> DataFrame:
    """G1 for two sides of one table: a single pass tagging rows by their split value."""
    s = F.col(split)
    return (df.where(s.isin(expected, actual))
            .select(*channels, F.when(s == expected, F.lit("expected")).otherwise(F.lit("actual")).alias("side")))


def first_n_flights(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """rows of the n smallest flight ids (a top-n of distinct ids, then a semi-join)."""
    if n is None:
        return df
    ids = df.select(key).distinct().orderBy(key).limit(int(n))
    return df.join(ids, key, "left_semi")


def _bin_start(x, lo, hi, n: int):
    """First guess floor((x - lo) / step) clamped to the bin range, and the step."""
    step = F.when(hi > lo, (hi - lo) / F.lit(float(n)))  # NULL for a constant channel (last bin, see _bin_fix)
    g = F.least(F.greatest(F.floor((x - lo) / step), F.lit(0)), F.lit(n - 1)).cast("double")
    return g, step


def _bin_fix(x, g, step, lo, hi, n: int):
    """NumPy's edge rule on the guess: edge_i = i * step + lo, last bin closed, lo == hi -> last bin."""
    fixed = (F.when((g > 0) & (x < g * step + lo), g - 1.0)
             .when((g < n - 1) & (x >= (g + 1.0) * step + lo), g + 1.0)
             .otherwise(g))
    return F.when(hi == lo, F.lit(n - 1)).otherwise(fixed.cast("int"))


def psi_by_channel(sides: DataFrame, channels: Sequence[str], n_bins: int = dims.PSI_BINS,
                   epsilon: float = dims.PSI_EPSILON) -> DataFrame:
    """Channel, psi (unrounded)."""
    chans = list(channels)
    rng = sides.agg(*[F.min(c).alias(f"_lo{i}") for i, c in enumerate(chans)],
                    *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(chans)])
    j = sides.withColumn("_j", F.lit(1)).join(F.broadcast(rng.withColumn("_j", F.lit(1))), "_j")
    # one (side, channel, value) row per value, then a single bin expression: one copy of the
    # edge rule in the generated code instead of one per channel (12 deep copies exceed the size
    # the JIT compiles and run interpreted)
    vals = j.select("side", F.explode(F.array(*[
        F.struct(F.lit(i).alias("idx"), F.col(c).alias("x"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"))
        for i, c in enumerate(chans)])).alias("_x")).select("side", "_x.*")
    g, step = _bin_start(F.col("x"), F.col("lo"), F.col("hi"), n_bins)
    guess = vals.select("side", "idx", "x", "lo", "hi", g.alias("_g"), step.alias("_st"))
    pairs = guess.select("side", F.struct(F.col("idx"), _bin_fix(F.col("x"), F.col("_g"), F.col("_st"), F.col("lo"),
                                                                 F.col("hi"), n_bins).alias("bin")).alias("_x"))
    counts = pairs.groupBy("side", "_x.idx", "_x.bin").agg(F.count(F.lit(1)).alias("cnt"))
    # every row adds one count per channel, so a side's size is its count total for one channel;
    # a window over the tiny count table gives it without a second pass over the rows
    shares = counts.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("side", "idx")))
    wide = shares.groupBy("idx", "bin").agg(
        (F.coalesce(F.max(F.when(F.col("side") == "expected", F.col("share"))), F.lit(0.0)) + F.lit(epsilon))
        .alias("e"),
        (F.coalesce(F.max(F.when(F.col("side") == "actual", F.col("share"))), F.lit(0.0)) + F.lit(epsilon))
        .alias("a"))
    # bins empty on both sides add (eps - eps) * ln(1) = 0, so they need no row
    names = F.array(*[F.lit(c) for c in chans])
    return (wide.groupBy("idx")
            .agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))
            .select(F.element_at(names, F.col("idx") + 1).alias("channel"), "idx", "psi"))


def drift_report(psi: DataFrame, threshold: float = dims.DRIFT_THRESHOLD) -> DataFrame:
    """Average of the 4-decimal PSI values, drifted channels (unrounded > threshold), flag."""
    return psi.agg(
        F.avg(F.round("psi", 4)).alias("avg_psi"),
        F.count(F.when(F.col("psi") > threshold, 1)).alias("n_drifted"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(
            F.when(F.col("psi") > threshold, F.struct("idx", "channel")))), lambda x: x["channel"]))
        .alias("drifted_channels"),
    ).withColumn("drift_flag", F.col("avg_psi") > F.lit(float(threshold))) \
     .withColumn("threshold", F.lit(float(threshold)))
