"""Per-phase healthy baselines and persistent-anomaly detection.

Plan shape (the same at any scale):

* phase is a row-wise expression, computed once;
* the baseline fit is two partial-aggregating group-bys: per
  (flight, phase) count/mean/variance for every channel, keep groups with
  enough rows, then pool mean and spread per phase from the group moments
  around one fleet-wide shift (no join back, no window over a flight);
* detection joins the fitted baseline as one wide row per phase, broadcast
  while its size is below the session's limit and by a skew-cut shuffle join
  on the phase beyond (:func:`_with_z`, equal results for any number of
  phases), computes every channel's z in one projection and aggregates per
  (flight, phase) with one count / flagged-count / max-z triple per channel.
  Only that aggregate (flights x phases rows) is unpivoted to per-channel
  rows.

A NULL phase is a phase like any other, in the fit and in every join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import is_true, phase_expr, phase_ord, phase_weight
from ..functions.joins import broadcast_if_small, settled, skew_join


def assign_phase(df: DataFrame, spec: dims.PhaseSpec, out: str = "phase") -> DataFrame:
    """Flight phase per row from the airspeed-like and altitude-like channels."""
    return df.withColumn(out, phase_expr(spec.ias, spec.alt, spec))


def fit_baseline(rows: DataFrame, channels: Sequence[str], key: str = "flight_id",
                 phase: str = "phase", min_rows: int = dims.MIN_PHASE_ROWS,
                 std_floor: float = dims.STD_FLOOR) -> DataFrame:
    """Per (phase, channel) pooled mean and population std over healthy rows.

    Rows of a flight count for a phase only when the flight has at least
    ``min_rows`` rows in that phase.  Returns
    ``phase, channel, mean, std, n_rows`` (n_rows = pooled rows of the phase).
    """
    chans = list(channels)
    # one struct per channel: both steps below use the same aggregate, so its exchange is written once
    g = rows.groupBy(key, phase).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.struct(F.count(c).alias("c"), F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(f"_u{i}")
          for i, c in enumerate(chans)],
    ).where(F.col("_n") >= F.lit(min_rows))
    # sums around the fleet's mean of each channel (one row, a scalar subquery over the same aggregate): the digits
    # lost are those of (phase mean - fleet mean)^2 over the phase's variance, whatever the distance from zero
    shift = g.agg(F.struct(*[F.try_divide(F.sum(F.col(f"_u{i}.c") * F.col(f"_u{i}.m")), F.sum(f"_u{i}.c")).alias(f"s{i}")
                             for i in range(len(chans))])).scalar()
    far = [F.col(f"_u{i}.m") - shift[f"s{i}"] for i in range(len(chans))]
    spread = g.groupBy(F.col(phase).alias("phase")).agg(
        F.sum("_n").alias("n_rows"),
        *[F.sum(f"_u{i}.c").alias(f"_N{i}") for i in range(len(chans))],
        *[F.sum(F.col(f"_u{i}.c") * d).alias(f"_S{i}") for i, d in enumerate(far)],
        *[F.sum(F.col(f"_u{i}.c") * (F.col(f"_u{i}.v") + d * d)).alias(f"_Q{i}") for i, d in enumerate(far)])
    items = []
    for i, c in enumerate(chans):
        off = F.try_divide(F.col(f"_S{i}"), F.col(f"_N{i}"))
        std = F.sqrt(F.greatest(F.try_divide(F.col(f"_Q{i}"), F.col(f"_N{i}")) - off * off, F.lit(0.0)))
        items.append(F.struct(F.lit(c).alias("channel"), (shift[f"s{i}"] + off).alias("mean"), std.alias("std"),
                              F.col(f"_N{i}").alias("n")))
    out = spread.select("phase", "n_rows", F.explode(F.array(*items)).alias("_x"))
    return (out.where(F.col("_x.n") > 0)
            .select("phase", F.col("_x.channel").alias("channel"), F.col("_x.mean").alias("mean"),
                    F.when(F.col("_x.std") < F.lit(std_floor), F.lit(1.0)).otherwise(F.col("_x.std")).alias("std"),
                    F.col("n_rows").cast("long").alias("n_rows")))


def _wide_baseline(baseline: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per phase with mean/std columns per channel."""
    aggs = []
    for i, c in enumerate(channels):
        hit = F.col("channel") == F.lit(c)
        aggs.append(F.max(F.when(hit, F.col("mean"))).alias(f"_bm{i}"))
        aggs.append(F.max(F.when(hit, F.col("std"))).alias(f"_bs{i}"))
    return baseline.groupBy(F.col("phase").alias("_bphase")).agg(*aggs)


def _with_z(rows: DataFrame, baseline: DataFrame, channels: Sequence[str], phase: str) -> DataFrame:
    """C4: adds ``_z<i>`` = |x - mean| / std per channel from the (phase, channel) baseline; NULL when absent.

    The way is chosen by the baseline's size alone: at most the session's broadcast limit goes to every task as it is;
    more is shuffled to the rows, whose phases are cut by their measured share.
    """
    wide = _wide_baseline(baseline, channels)
    small = broadcast_if_small(wide)
    if small is wide:  # its estimate is too large or none: settle it, and its size is known
        wide = settled(wide, "baseline")
        small = broadcast_if_small(wide)
    if small is not wide:
        j = rows.join(small, F.col(phase).eqNullSafe(F.col("_bphase")), "left")
    else:
        seen = rows.groupBy(phase).agg(F.count(F.lit(1)).alias("_seen"))
        j = skew_join(rows, seen.join(wide, F.col(phase).eqNullSafe(F.col("_bphase")), "left").drop("_bphase"), [phase], "_seen")
    zs = [F.abs((F.col(c) - F.col(f"_bm{i}")) / F.col(f"_bs{i}")).alias(f"_z{i}")
          for i, c in enumerate(channels)]
    return j.select(*rows.columns, *zs)


def phase_channel_stats(rows: DataFrame, baseline: DataFrame, channels: Sequence[str],
                        key: str = "flight_id", phase: str = "phase",
                        z_threshold: float = dims.Z_THRESHOLD,
                        min_rows: int = dims.MIN_PHASE_ROWS,
                        persistence: float = dims.PERSISTENCE) -> DataFrame:
    """D10 (with the B16 point predicate |z| > threshold, strict): per (flight, channel, phase):
    n, n_flagged, pct_flagged, max_z, persistent.

    Pairs without a baseline entry and phases with fewer than ``min_rows``
    rows are skipped.
    """
    chans = list(channels)
    z = _with_z(rows, baseline, chans, phase)
    thr = F.lit(float(z_threshold))
    g = z.groupBy(key, phase).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f"_z{i}").alias(f"_k{i}") for i in range(len(chans))],
        *[F.sum(F.when(F.col(f"_z{i}") > thr, 1).otherwise(0)).alias(f"_f{i}") for i in range(len(chans))],
        *[F.max(f"_z{i}").alias(f"_x{i}") for i in range(len(chans))],
    )
    items = [F.struct(F.lit(c).alias("channel"), F.lit(i).alias("channel_idx"), F.col(f"_k{i}").alias("k"),
                      F.col(f"_f{i}").alias("nf"), F.col(f"_x{i}").alias("mz"))
             for i, c in enumerate(chans)]
    long = (g.where(F.col("n") >= F.lit(min_rows))
            .select(key, phase, "n", F.explode(F.array(*items)).alias("_s"))
            .where(F.col("_s.k") > 0))
    pct = F.col("_s.nf") / F.col("n")
    return long.select(
        key, F.col("_s.channel").alias("channel"), F.col("_s.channel_idx").alias("channel_idx"),
        F.col(phase).alias("phase"), F.col("n").cast("long").alias("n"),
        F.col("_s.nf").cast("long").alias("n_flagged"), pct.alias("pct_flagged"),
        F.col("_s.mz").alias("max_z"), (pct >= F.lit(persistence)).alias("persistent"))


def _maintenance_rows(stats: DataFrame, chanset: dims.ChannelSet) -> DataFrame:
    maint = chanset.select(lambda c: c.maintenance)
    return stats.where(F.col("persistent") & F.col("channel").isin(maint))


def anomaly_score(stats: DataFrame, flights: DataFrame, chanset: dims.ChannelSet,
                  key: str = "flight_id") -> DataFrame:
    """Weighted share over persistent maintenance pairs; 0 when none; capped at 1; 4 decimals."""
    p = _maintenance_rows(stats, chanset).withColumn("_w", phase_weight("phase"))
    s = p.groupBy(key).agg((F.sum(F.col("pct_flagged") * F.col("_w")) / F.sum("_w")).alias("_s"))
    return (flights.select(key).distinct().join(s, key, "left")
            .select(key, F.round(F.least(F.coalesce(F.col("_s"), F.lit(0.0)), F.lit(1.0)), 4)
                    .alias("anomaly_score")))


def phase_anomalies(stats: DataFrame, flights: DataFrame, chanset: dims.ChannelSet,
                    key: str = "flight_id") -> DataFrame:
    """Per flight and phase, sum of flagged counts x phase weight, truncated; all phases present."""
    p = _maintenance_rows(stats, chanset)
    s = p.groupBy(key, "phase").agg(F.sum(F.col("n_flagged") * phase_weight("phase")).alias("_w"))
    phases = F.array(*[F.struct(F.lit(n).alias("phase"), F.lit(o).alias("phase_ord")) for n, o, _ in dims.PHASES])
    grid = (flights.select(key).distinct().select(key, F.explode(phases).alias("_p"))
            .select(key, "_p.phase", "_p.phase_ord"))
    return (grid.join(s, [key, "phase"], "left")
            .select(key, "phase", "phase_ord", F.coalesce(F.col("_w"), F.lit(0.0)).cast("int").alias("count")))


def flagged_sensors(stats: DataFrame, chanset: dims.ChannelSet, key: str = "flight_id") -> DataFrame:
    """D13 (flat): distinct (flight, channel) persistent maintenance channels, pilot channels excluded."""
    pilot = chanset.select(lambda c: c.pilot)
    return (_maintenance_rows(stats, chanset).where(~F.col("channel").isin(pilot) if pilot else F.lit(True))
            .select(key, "channel").distinct())


def flagged_sensor_lists(stats: DataFrame, chanset: dims.ChannelSet, key: str = "flight_id") -> DataFrame:
    """Sorted distinct channel list per flight (bounded by the channel count)."""
    return (flagged_sensors(stats, chanset, key).groupBy(key)
            .agg(F.array_sort(F.collect_set("channel")).alias("flagged_sensors")))


def top_anomalies(stats: DataFrame, chanset: dims.ChannelSet, key: str = "flight_id", k: int = 5) -> DataFrame:
    """top k persistent maintenance anomalies per flight by max z (2 decimals), ties by channel then phase."""
    pilot = chanset.select(lambda c: c.pilot)
    p = _maintenance_rows(stats, chanset)
    if pilot:
        p = p.where(~F.col("channel").isin(pilot))
    p = p.withColumn("max_z", F.round("max_z", 2)).withColumn("_po", phase_ord("phase"))
    w = Window.partitionBy(key).orderBy(F.col("max_z").desc(), F.col("channel_idx"), F.col("_po"))
    return (p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(key, F.col("rank").cast("int").alias("rank"), F.col("channel").alias("sensor"), "phase",
                    "max_z", F.round(F.col("pct_flagged") * 100.0, 1).alias("pct_flagged")))


def anomaly_timeline(rows: DataFrame, baseline: DataFrame, channels: Sequence[str],
                     key: str = "flight_id", t: str | None = "t", phase: str = "phase",
                     z_threshold: float = dims.Z_THRESHOLD, min_rows: int = dims.MIN_PHASE_ROWS,
                     unordered: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """D14 (flat): per (flight, t) 1 when any scored channel exceeds the threshold in a phase
    that has at least ``min_rows`` rows and a baseline; no persistence rule.

    ``unordered``: the same rows before the step index was added (with the phase column);
    the phase row counts are then aggregated from it, so the ordering is not re-run for them.
    ``keep``: columns of ``rows`` that stay beside the flag, for operators that go on with the rows; such
    rows need no step index (``t`` None).
    """
    chans = list(channels)
    thr = F.lit(float(z_threshold))
    any_flag = F.greatest(*[is_true(F.col(f"_z{i}") > thr).cast("int") for i in range(len(chans))]) \
        if len(chans) > 1 else is_true(F.col("_z0") > thr).cast("int")
    # the flag is one number before the rows are shuffled to their counts, and only what is shown goes with it
    shown = dict.fromkeys([key, phase, *([] if t is None else [t]), *keep])
    z = _with_z(rows, baseline, chans, phase).select(*shown, any_flag.alias("_any"))
    n = (unordered if unordered is not None else rows).groupBy(key, phase).agg(F.count(F.lit(1)).alias("_pn"))
    j = skew_join(z, n, [key, phase], "_pn")
    return j.select(key, *([] if t is None else [F.col(t).cast("int").alias("t")]), *keep,
                    F.when(F.col("_pn") >= F.lit(min_rows), F.col("_any")).otherwise(F.lit(0)).alias("flag"))


def timeline_arrays(timeline: DataFrame, key: str = "flight_id", t: str = "t") -> DataFrame:
    """Per flight, the flags of its steps in order as one array (the record's form: one row per flight)."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), "flag")))
    return timeline.groupBy(key).agg(F.transform(steps, lambda x: x["flag"]).alias("anomaly_timeline"))


def detection_summary(stats: DataFrame, flights: DataFrame, chanset: dims.ChannelSet,
                      key: str = "flight_id", timeline: DataFrame | None = None) -> DataFrame:
    """Nested detection result per flight (score, flagged list, phase map, top anomalies, and the ordered
    timeline when its flat form is given)."""
    score = anomaly_score(stats, flights, chanset, key)
    pa = (phase_anomalies(stats, flights, chanset, key).groupBy(key)
          .agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("phase_ord", "phase", "count"))),
                                              lambda x: F.struct(x["phase"], x["count"])))
               .alias("phase_anomalies")))
    fl = flagged_sensor_lists(stats, chanset, key)
    top = (top_anomalies(stats, chanset, key).groupBy(key)
           .agg(F.array_sort(F.collect_list(F.struct("rank", "sensor", "phase", "max_z", "pct_flagged")))
                .alias("top_anomalies")))
    parts = score.join(pa, key, "left").join(fl, key, "left").join(top, key, "left")
    extra = []
    if timeline is not None:
        parts, extra = parts.join(timeline_arrays(timeline, key), key, "left"), ["anomaly_timeline"]
    return (parts
            .select(key, "anomaly_score", *extra,
                    F.coalesce("flagged_sensors", F.array().cast("array<string>")).alias("flagged_sensors"),
                    "phase_anomalies", "top_anomalies"))
