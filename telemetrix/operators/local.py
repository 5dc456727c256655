"""Per-flight local anomaly view.

Here a channel is z-scored against the flight's *own* mean and population
std.  The per-flight statistics are a partial-aggregating group-by, joined
back on the flight key; its row count tells which flights hold a large share
of all rows, and those are spread over several tasks (``joins.skew_join``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import is_true
from ..functions.joins import skew_join
from ..session import materialize
from . import chunked


def local_flags(rows: DataFrame, channels: Sequence[str], key: str = "flight_id",
                z_threshold: float = dims.LOCAL_Z_THRESHOLD, std_floor: float = dims.STD_FLOOR) -> DataFrame:
    """Adds ``<channel>_flag`` (0/1): |x - flight mean| / flight std > threshold."""
    chans = list(channels)
    st = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_lm{i}") for i, c in enumerate(chans)],
                               *[F.stddev_pop(c).alias(f"_ls{i}") for i, c in enumerate(chans)])
    # written once (a row per flight): the join reads the counts three times, and each would pass over all rows again
    j = skew_join(rows, materialize(st, "local"), [key], "_n")
    out = []
    for i, c in enumerate(chans):
        s = F.when(F.col(f"_ls{i}") < F.lit(std_floor), F.lit(1.0)).otherwise(F.col(f"_ls{i}"))
        z = F.abs((F.col(c) - F.col(f"_lm{i}")) / s)
        out.append(is_true(z > F.lit(float(z_threshold))).cast("int").alias(f"{c}_flag"))
    return j.select(*rows.columns, *out)


def local_channel_share(flags: DataFrame, channels: Sequence[str], key: str = "flight_id") -> DataFrame:
    """Share of flagged steps per (flight, channel), long rows."""
    chans = list(channels)
    g = flags.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                               *[F.sum(f"{c}_flag").alias(f"_f{i}") for i, c in enumerate(chans)])
    items = [F.struct(F.lit(c).alias("channel"), F.lit(i).alias("channel_idx"), F.col(f"_f{i}").alias("nf"))
             for i, c in enumerate(chans)]
    return (g.select(key, "_n", F.explode(F.array(*items)).alias("_x"))
            .select(key, "_x.channel", "_x.channel_idx", F.col("_x.nf").cast("long").alias("n_flagged"),
                    (F.col("_x.nf") / F.col("_n")).alias("share")))


def _picked(flags: DataFrame, channels: Sequence[str], key: str, min_share: float) -> DataFrame:
    """Per flight its rows (``_n``) and, as ``_p<i>``, 1 for each channel whose flagged share is at least ``min_share``, else 0."""
    share = [F.sum(f"{c}_flag") / F.count(F.lit(1)) for c in channels]
    return flags.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[
        is_true(s >= F.lit(float(min_share))).cast("int").alias(f"_p{i}") for i, s in enumerate(share)])


def _any_picked(channels: Sequence[str]) -> F.Column:
    parts = [F.col(f"_p{i}") * F.col(f"{c}_flag") for i, c in enumerate(channels)]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def local_flight_score(flags: DataFrame, channels: Sequence[str], key: str = "flight_id",
                       min_share: float = dims.LOCAL_SHARE) -> DataFrame:
    """Over channels whose flagged share >= min_share, the share of steps with any flag;
    plus the number and sorted list of such channels.  Flights with none score 0.

    Rows of a flight with the same flags count as one pattern with a weight, summed up before the shuffle, so that not the rows
    but their patterns (at most 2^channels a flight) meet the flight's picked channels.
    """
    chans = list(channels)
    flag_cols = [f"{c}_flag" for c in chans]
    weight = F.col("_w")
    seen = flags.groupBy(key, *flag_cols).agg(F.count(F.lit(1)).alias("_w"))
    share = [F.sum(F.col(f) * weight) / F.sum(weight) for f in flag_cols]
    picked = seen.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[
        is_true(s >= F.lit(float(min_share))).cast("int").alias(f"_p{i}") for i, s in enumerate(share)])
    j = skew_join(seen, picked, [key], "_n")
    marks = [f"_p{i}" for i in range(len(chans))]
    hit = _any_picked(chans)
    mean = F.try_divide(F.sum(hit * weight), F.sum(F.when(hit.isNotNull(), weight)))
    score = j.groupBy(key).agg(mean.alias("local_score"), *[F.max(m).alias(m) for m in marks])
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col(m) == 1, F.lit(c)) for m, c in zip(marks, chans)])))
    return score.select(key, "local_score", F.size(names).cast("long").alias("n_sensors_flagged"),
                        F.concat_ws(",", names).alias("sensors_flagged"))


def activity_label(score) -> F.Column:
    """> 0.20 high, > 0.08 moderate, else low anomaly activity."""
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(is_true(s > 0.20), F.lit("High anomaly activity"))
            .when(is_true(s > 0.08), F.lit("Moderate anomaly activity"))
            .otherwise(F.lit("Low anomaly activity")))


def combined_any_flag(flags: DataFrame, channels: Sequence[str], key: str = "flight_id", t: str = "t",
                      min_share: float = dims.LOCAL_SHARE) -> DataFrame:
    """Per (flight, t): 1 when any channel with share >= min_share flags (the local OR series)."""
    chans = list(channels)
    j = skew_join(flags, _picked(flags, chans, key, min_share), [key], "_n")
    return j.select(key, t, _any_picked(chans).alias("flag"))


def anomaly_segments(series: DataFrame, key: str = "flight_id", t: str = "t", flag: str = "flag",
                     max_gap: int = 15, max_segments: int | None = None,
                     chunk_steps: int = chunked.DEFAULT_CHUNK_STEPS) -> DataFrame:
    """Merge flagged steps whose gap is <= max_gap into segments; a report may keep the first ``max_segments``.

    Gaps-and-islands in one windowed pass per (flight, time chunk): inside a
    chunk the first flagged step is a provisional segment start; a per-chunk
    summary (first and last flagged step, number of starts) and the previous
    chunk's last step correct it and give each chunk its segment offset.
    """
    unb, keys = Window.unboundedPreceding, chunked.KEYS
    f = chunked.keyed(series.where(F.col(flag) == 1).select(key, t)
                      .withColumn(chunked.CHUNK, chunked.step_chunk(t, chunk_steps)), key)
    w = Window.partitionBy(*keys, chunked.CHUNK).orderBy(t)
    lag = F.lag(t).over(w)
    local = f.withColumn("_start", F.when(lag.isNull() | (F.col(t) - lag > F.lit(max_gap)), 1).otherwise(0))
    local = local.withColumn("_cs", F.sum("_start").over(w.rowsBetween(unb, 0)))
    summ = local.groupBy(*keys, chunked.CHUNK).agg(F.min(t).alias("_first"), F.max(t).alias("_last"),
                                                   F.sum("_start").alias("_ns"))
    wk = Window.partitionBy(*keys).orderBy(chunked.CHUNK)
    prev_last = F.lag("_last").over(wk)
    fix = F.when(prev_last.isNull() | (F.col("_first") - prev_last > F.lit(max_gap)), 0).otherwise(-1)
    carry = summ.select(*keys, chunked.CHUNK, "_ns", fix.alias("_fix"))
    carry = carry.withColumn("_off", F.coalesce(
        F.sum(F.col("_ns") + F.col("_fix")).over(wk.rowsBetween(unb, -1)), F.lit(0)))
    j = local.join(carry.select(*keys, chunked.CHUNK, "_off", "_fix"), [*keys, chunked.CHUNK])
    num = j.withColumn("segment", F.col("_off") + F.col("_cs") + F.col("_fix"))
    seg = num.groupBy(key, "segment").agg(F.min(t).alias("seg_start"), F.max(t).alias("seg_end"))
    if max_segments is not None:
        seg = seg.where(F.col("segment") <= max_segments)
    return seg.select(key, F.col("segment").cast("int").alias("segment"), "seg_start", "seg_end")


def combined_duration(flags: DataFrame, timeline: DataFrame | None, channels: Sequence[str], key: str = "flight_id",
                      t: str = "t", detector: str = "flag") -> DataFrame:
    """Per (flight, channel), steps flagged locally or by the detector, and their percent.

    The detector's flag is a column of ``flags`` (``timeline`` None: see ``anomaly.anomaly_timeline(keep=...)``), so that no two
    row-level tables are joined, or comes from a timeline table by (flight, step).
    """
    chans = list(channels)
    j = flags.withColumnRenamed(detector, "_g") if timeline is None else flags.join(
        timeline.select(key, t, F.col(detector).alias("_g")), [key, t], "left")
    g = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.greatest(F.col(f"{c}_flag"), F.coalesce(F.col("_g"), F.lit(0)))).alias(f"_d{i}")
          for i, c in enumerate(chans)])
    items = [F.struct(F.lit(c).alias("channel"), F.col(f"_d{i}").alias("d")) for i, c in enumerate(chans)]
    return (g.select(key, "_n", F.explode(F.array(*items)).alias("_x"))
            .select(key, "_x.channel", F.col("_x.d").cast("long").alias("anomaly_duration"),
                    (F.col("_x.d") * 100.0 / F.col("_n")).alias("anomaly_pct")))


def worst_anomaly_detail(local_share: DataFrame, top: DataFrame, key: str = "flight_id",
                         min_share: float = dims.LOCAL_SHARE) -> DataFrame:
    """For each locally flagged channel, the detector's (phase, max_z); when a channel appears
    several times in the top list, its lowest-ranked entry wins; missing -> '' and 0."""
    flagged = local_share.where(F.col("share") >= F.lit(float(min_share)))
    w = Window.partitionBy(key, "sensor").orderBy(F.col("rank").desc())
    last = top.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(key, "sensor", "phase", "max_z")
    j = flagged.join(last, (flagged[key] == last[key]) & (flagged["channel"] == last["sensor"]), "left")
    return j.select(flagged[key], F.col("channel").alias("sensor"), (F.col("share") * 100.0).alias("pct_local"),
                    F.coalesce(F.col("phase"), F.lit("")).alias("phase"),
                    F.coalesce(F.col("max_z"), F.lit(0.0)).alias("max_z"))
