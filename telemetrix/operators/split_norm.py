"""Sampling, exact stratified split and normalisation.

The split ranks flights inside each label by a stable hash.  A label is a
hot key by nature (two classes hold all flights), so the rank is computed
with :func:`chunked.dense_index` over (label, hash-prefix) chunks: the
hash prefix is uniform and monotone in the hash order, so every chunk is
small and the per-label offsets come from a tiny chunk table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import stable_hash_key
from ..functions.joins import broadcast_if_small, skew_join
from . import chunked

SPLIT_SEED = 42
FIRST_FRACTION = 0.30
SECOND_FRACTION = 0.333


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = SPLIT_SEED) -> DataFrame:
    """n distinct flights without replacement, deterministic (top-n by md5(seed:id), id)."""
    ids = df.select(key).distinct()
    return ids.orderBy(stable_hash_key(seed, key), F.col(key)).limit(int(n))


def head_n(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    """first n rows in file (ingest) order."""
    return df.orderBy(order).limit(int(n))


def _dealt(per_label: DataFrame, count: str, seats: Column, out: str) -> DataFrame:
    """Adds ``out``: ``seats`` dealt to the labels in proportion to ``count`` by largest remainders, ties to the label that
    sorts first.  Whole numbers throughout; ``per_label`` has one row per label, so the windows over all of it are small."""
    everyone = Window.partitionBy(F.lit(0))
    share = per_label.withColumns({"_share": F.col(count).cast("decimal(19,0)") * seats.cast("decimal(19,0)"),
                                   "_all": F.sum(count).over(everyone), "_seats": seats})
    floor = share.withColumns({"_floor": F.expr("_share div _all"), "_rest": F.expr("_share % _all")})
    left = F.col("_seats") - F.sum("_floor").over(everyone)
    place = F.row_number().over(everyone.orderBy(F.col("_rest").desc(), "_l"))
    return floor.withColumn(out, F.col("_floor") + (place <= left).cast("long")).select(*per_label.columns, out)


def split_quotas(per_label: DataFrame, first: float = FIRST_FRACTION, second: float = SECOND_FRACTION) -> DataFrame:
    """_l, _n, _val, _test from _l (label as text) and _n (its flights): totals first, then their share per label.

    ceil(first x flights) leave train, ceil(second x those) of them are test, the rest val.  Train is dealt to the labels by
    largest remainders, then val to what is left of each.
    """
    everyone = Window.partitionBy(F.lit(0))

    def kept(count: str, fraction: float) -> Column:
        n = F.sum(count).over(everyone)
        return n - F.ceil(F.lit(float(fraction)) * n.cast("double"))

    train = _dealt(per_label, "_n", kept("_n", first), "_train")
    rest = train.withColumn("_temp", F.col("_n") - F.col("_train"))
    return _dealt(rest, "_temp", kept("_temp", second), "_val").select(
        "_l", "_n", "_val", (F.col("_temp") - F.col("_val")).alias("_test"))


def stratified_split(df: DataFrame, key: str, label: str, seed: int = SPLIT_SEED,
                     first: float = FIRST_FRACTION, second: float = SECOND_FRACTION,
                     hash_prefix: int = 3) -> DataFrame:
    """stratified split 70/20/10 with exact totals (:func:`split_quotas`).

    Within a label flights are ranked by md5(seed:id) then id: the first are test, then val, then train.  A NULL label is a
    label of its own.  Adds a ``split`` column.
    """
    h = stable_hash_key(seed, key)
    keyed = df.withColumn("_h", h).withColumn("_l", F.concat(
        F.when(F.col(label).isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(F.col(label).cast("string"), F.lit(""))))
    chunk = F.conv(F.substring("_h", 1, hash_prefix), 16, 10).cast("long")
    ranked = chunked.dense_index(keyed, "_l", [F.col("_h"), F.col(key)], chunk, out="_r")
    quotas = split_quotas(keyed.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")), first, second)
    small = broadcast_if_small(quotas)
    met = skew_join(ranked, quotas, ["_l"], "_n") if small is quotas else ranked.join(small, "_l")
    split = (F.when(F.col("_r") < F.col("_test"), F.lit("test"))
             .when(F.col("_r") < F.col("_test") + F.col("_val"), F.lit("val")).otherwise(F.lit("train")))
    return met.withColumn("split", split).select(*df.columns, "split")


def label_counts(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Flights per split and label with the share of the split."""
    g = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    tot = df.groupBy(split).agg(F.count(F.lit(1)).alias("_t"))
    return g.join(tot, split).select(split, label, "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def norm_stats(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Per-channel mean and population std (0 becomes 1) as long rows (channel, idx, mean, std)."""
    chans = list(channels)
    agg = rows.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(chans)],
                   *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(chans)])
    items = [F.struct(F.lit(c).alias("channel"), F.lit(i).alias("idx"), F.col(f"_m{i}").alias("mean"),
                      F.when(F.col(f"_s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_s{i}")).alias("std"))
             for i, c in enumerate(chans)]
    return agg.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


def apply_zscore(rows: DataFrame, stats: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(x - mean) / std per channel.

    The statistics become one row (two columns per channel), which is
    broadcast.  A channel without statistics, or with NULL ones (an empty
    train side), becomes NULL.
    """
    chans = list(channels)
    wide = stats.agg(*[F.max(F.when(F.col("channel") == c, F.col("mean"))).alias(f"_m{i}") for i, c in enumerate(chans)],
                     *[F.max(F.when(F.col("channel") == c, F.col("std"))).alias(f"_s{i}") for i, c in enumerate(chans)])
    j = rows.withColumn("_j", F.lit(1)).join(F.broadcast(wide.withColumn("_j", F.lit(1))), "_j").drop("_j")
    out = [((F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).alias(c) for i, c in enumerate(chans)]
    others = [c for c in rows.columns if c not in chans]
    return j.select(*others, *out)


def post_norm_check(rows: DataFrame, channels: Sequence[str], split: str = "split") -> DataFrame:
    """Global mean and population std over all values of all channels, per split."""
    chans = list(channels)
    g = rows.groupBy(split).agg(*[F.struct(F.count(x).alias("c"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
                                  .alias(f"_u{i}") for i, x in enumerate(chans)])

    def total(term):
        parts = [F.coalesce(term(i), F.lit(0.0)) for i in range(len(chans))]
        return sum(parts[1:], parts[0])

    n = total(lambda i: F.col(f"_u{i}.c").cast("double"))
    g = g.withColumn("_mean", F.try_divide(total(lambda i: F.col(f"_u{i}.c") * F.col(f"_u{i}.m")), n))
    mean = F.col("_mean")
    var = F.try_divide(total(lambda i: F.col(f"_u{i}.c") * (
        F.col(f"_u{i}.v") + (F.col(f"_u{i}.m") - mean) * (F.col(f"_u{i}.m") - mean))), n)
    return g.select(split, mean.alias("mean"), F.sqrt(var).alias("std"))
