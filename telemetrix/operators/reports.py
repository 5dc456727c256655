"""Fleet and single-flight report tables.

Rankings over a whole fleet use :func:`chunked.dense_index` keyed by a
constant and chunked by a score or hash range, so no global window puts
the whole fleet into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import is_true, pct1, phase_ord, stable_hash_key
from ..session import materialize
from . import chunked


def global_rank(df: DataFrame, order: list[Column], chunk: Column, out: str = "rank") -> DataFrame:
    """1-based rank of every row along ``order`` (``chunk`` must be non-decreasing along it)."""
    r = chunked.dense_index(df.withColumn("_all", F.lit(0)), "_all", order, chunk, out="_r")
    return r.withColumn(out, (F.col("_r") + 1).cast("long")).drop("_all", "_r")


def rank_by_probability(scores: DataFrame, key: str = "flight_id", chunks: int = 256) -> DataFrame:
    """fleet rank by probability (descending, missing last), ties by flight id.

    Chunks lie between approximate quantiles of the probability, so a saturated score does not put
    most flights into one of them; flights at exactly a quantile's value (many, where the score
    saturates) are divided further by quantiles of their id.  The quantiles are one row.
    """
    steps = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    cuts = scores.agg(F.array_distinct(F.percentile_approx("probability", steps, 10 * chunks)).alias("_p"),
                      F.array_distinct(F.percentile_approx(key, steps, 10 * chunks)).alias("_k"))
    j = scores.withColumn("_j", F.lit(1)).join(F.broadcast(cuts.withColumn("_j", F.lit(1))), "_j").drop("_j")
    p = F.col("probability")
    above = F.size(F.filter("_p", lambda x: x > p))
    tied = F.array_contains("_p", p)
    place = F.when(tied, F.size(F.filter("_k", lambda x: x < F.col(key)))).otherwise(F.lit(0))
    chunk = F.when(p.isNull(), F.lit(2 * chunks * chunks)).otherwise(
        (2 * above + tied.cast("int")) * F.lit(chunks) + place).cast("long")
    return global_rank(j.withColumn("_rank_chunk", chunk).drop("_p", "_k"), [p.desc(), F.col(key)],
                       F.col("_rank_chunk"), "fleet_rank").drop("_rank_chunk")


def aircraft_ids(flights: DataFrame, key: str = "flight_id", seed: int = 42, prefix: str = "N",
                 start: int = 1000) -> DataFrame:
    """F8: identifiers N1000+i in selection order (selection order = md5(seed:id), id)."""
    h = stable_hash_key(seed, key)
    ids = flights.select(key).distinct().withColumn("_h", h)
    chunk = F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")
    r = global_rank(ids, [F.col("_h"), F.col(key)], chunk, "_sel")
    return r.select(key, F.concat(F.lit(prefix), (F.lit(start) + F.col("_sel") - 1).cast("string")).alias("aircraft_id"))


def label_subset(df: DataFrame, which: int | None, label: str = "label") -> DataFrame:
    """All flights, or only label 0 / label 1."""
    return df if which is None else df.where(F.col(label) == which)


def true_label_text(label) -> Column:
    """1 -> 'At-Risk', 0 -> 'Safe', else '—'."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == 1, F.lit("At-Risk")).when(c == 0, F.lit("Safe")).otherwise(F.lit("—"))


def priority_filter(df: DataFrame, severity: str = "severity") -> DataFrame:
    """Flights needing attention (CRITICAL or HIGH)."""
    return df.where(F.col(severity).isin("CRITICAL", "HIGH"))


def severity_counts(scores: DataFrame) -> DataFrame:
    """Flights per severity (all four present), share of the fleet, and the attention count."""
    sev = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(i).alias("severity_ord"))
                    for i, (s, _, _) in enumerate(dims.SEVERITIES)])
    g = scores.groupBy("severity").agg(F.count(F.lit(1)).alias("_n"))
    tot = scores.agg(F.count(F.lit(1)).alias("_t"),
                     F.count(F.when(F.col("severity").isin("CRITICAL", "HIGH"), 1)).alias("needs_attention"))
    grid = tot.select("_t", "needs_attention", F.explode(sev).alias("_s")).select("_t", "needs_attention", "_s.*")
    j = grid.join(g, "severity", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return j.select("severity", "severity_ord", n.cast("long").alias("n_flights"),
                    F.coalesce(F.try_divide(n * 100.0, F.col("_t")), F.lit(0.0)).alias("pct_fleet"),
                    F.col("needs_attention").cast("long").alias("needs_attention"))


def worst_phase(phase_counts: DataFrame, key: str = "flight_id") -> DataFrame:
    """Phase with the largest count, first in phase order on ties; 'N/A' when all are zero."""
    g = phase_counts.withColumn("_o", phase_ord("phase")).groupBy(key).agg(
        F.max_by("phase", F.struct(F.col("count"), -F.col("_o"))).alias("_p"), F.max("count").alias("_m"))
    return g.select(key, F.when(F.col("_m") > 0, F.col("_p")).otherwise(F.lit("N/A")).alias("worst_phase"))


def phase_share(phase_counts: DataFrame, key: str = "flight_id") -> DataFrame:
    """Count / max(total, 1) per flight and phase (percent)."""
    tot = phase_counts.groupBy(key).agg(F.sum("count").alias("_t"))
    return phase_counts.join(tot, key).select(
        key, "phase", "count", (F.col("count") * 100.0 / F.greatest(F.col("_t"), F.lit(1))).alias("share_pct"))


def separation_ratio(scores: DataFrame, labels: DataFrame, key: str = "flight_id", score: str = "anomaly_score",
                     label: str = "label") -> DataFrame:
    """Mean score of at-risk flights, of healthy flights, and their ratio."""
    j = scores.join(labels.select(key, label), key)
    g = j.agg(F.avg(F.when(F.col(label) == 0, F.col(score))).alias("mean_healthy"),
              F.avg(F.when(F.col(label) == 1, F.col(score))).alias("mean_at_risk"))
    return g.withColumn("ratio", F.try_divide(F.col("mean_at_risk"), F.col("mean_healthy")))


def fleet_status(scores: DataFrame, labels: DataFrame, local_score: DataFrame, top: DataFrame,
                 worst: DataFrame, n_display: int, key: str = "flight_id", seed: int = 42) -> DataFrame:
    """One row per flight with the report columns, ranked by probability (descending)."""
    ids = aircraft_ids(scores, key, seed)
    top1 = top.where(F.col("rank") == 1).select(key, F.col("channel").alias("top_sensor"))
    j = (scores.join(ids, key).join(labels.select(key, "label"), key, "left")
         .join(local_score.select(key, "local_score", "n_sensors_flagged"), key, "left")
         .join(top1, key, "left").join(worst, key, "left"))
    # written once (a row per flight): the ranking reads its rows several times, each of which would join all the parts again
    ranked = rank_by_probability(materialize(j, "fleet"), key)
    return ranked.select(
        "fleet_rank", "aircraft_id", key, true_label_text("label").alias("true_label"), "severity",
        F.concat(pct1("probability"), F.lit("%")).alias("maint_prob"),
        F.concat(pct1(F.coalesce(F.col("local_score"), F.lit(0.0))), F.lit("%")).alias("anomaly_score"),
        F.concat(F.coalesce(F.col("n_sensors_flagged"), F.lit(0)).cast("string"), F.lit(f" / {n_display}"))
        .alias("sensors_flagged"),
        F.coalesce(F.col("top_sensor"), F.lit("N/A")).alias("top_sensor"),
        F.coalesce(F.col("worst_phase"), F.lit("N/A")).alias("worst_phase"),
        F.col("message").alias("action"))


def flight_analysis(scores: DataFrame, detection: DataFrame, explanation: DataFrame, key: str = "flight_id"
                    ) -> DataFrame:
    """I7 + C6: score, detection and explanation per flight; a missing part stays NULL."""
    return (scores.join(detection, key, "left").join(explanation, key, "left"))


def alert_records(analysis: DataFrame, key: str = "flight_id", top: DataFrame | None = None) -> DataFrame:
    """Nested alert record per flight, plus its JSON text.

    ``top``: F2's rows; they become the record's ``top_channels`` in rank order.  The ordered
    ``anomaly_timeline`` is part of the record when the detection carries it.
    """
    shown = []
    if top is not None:
        entry = F.struct("rank", "channel", "description", "importance")
        lists = top.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("top_channels"))
        analysis, shown = analysis.join(lists, key, "left"), ["top_channels"]
    timeline = ["anomaly_timeline"] if "anomaly_timeline" in analysis.columns else []
    rec = F.struct(
        F.col(key).alias("flight_id"), "probability", "prediction", "severity", "threshold", "message",
        F.struct("anomaly_score", "flagged_sensors", "phase_anomalies", "top_anomalies", *timeline).alias("anomaly"), *shown,
        F.struct("summary", "driving_factors", "sensor_insights", "recommended_action").alias("explanation"))
    return analysis.select(key, rec.alias("alert")).withColumn("alert_json", F.to_json("alert"))


def flight_id_fallback(df: DataFrame, id_col: str, order: list[Column], chunk: Column,
                       out: str = "flight_id") -> DataFrame:
    """Use the id when present, else the row position (0-based, in ``order``)."""
    ranked = global_rank(df, order, chunk, "_pos")
    return ranked.withColumn(out, F.coalesce(F.col(id_col), F.col("_pos") - 1)).drop("_pos")


def single_flight_report(rows: DataFrame, channels: list[str], timeline: DataFrame, top: DataFrame,
                         phase_counts: DataFrame, key: str = "flight_id", t: str = "t",
                         z_threshold: float = dims.LOCAL_Z_THRESHOLD) -> dict[str, DataFrame]:
    """The data tables of the single-flight report, for every flight at once.

    smoothed signal (E6), local flags (D22), flagged-step segments (E7),
    combined durations (D27), phase shares (D26), flagged-sensor cards (C7).
    """
    from . import local as lc
    from . import timeseries as ts

    flags = lc.local_flags(rows, channels, key, z_threshold)
    share = lc.local_channel_share(flags, channels, key)
    return {
        "smoothed": ts.moving_average(rows, channels, key, t),
        "flags": flags,
        "segments": lc.anomaly_segments(lc.combined_any_flag(flags, channels, key, t), key, t),
        "durations": lc.combined_duration(flags, timeline, channels, key, t),
        "phase_share": phase_share(phase_counts, key),
        "sensor_cards": lc.worst_anomaly_detail(share, top, key),
    }
