"""Plain-language explanation per flight.

Pure column expressions over one row per flight: the top channels (at
most five per flight) are gathered with a bounded ``collect_list``; group
membership is an ``arrays_overlap`` with fixed channel groups; texts are
``format_string`` / ``concat_ws`` templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import any_of, is_true, pct1
from ..functions.fmt import fixed


def _group_members(chanset: dims.ChannelSet, group: str) -> list[str]:
    return chanset.select(lambda c: c.group == group)


def _level(imp: Column) -> Column:
    return (F.when(imp > 0.5, F.lit("strongly")).when(imp > 0.2, F.lit("moderately"))
            .otherwise(F.lit("slightly")))


def plain_explanation(scores: DataFrame, top: DataFrame, chanset: dims.ChannelSet,
                      detection: DataFrame | None = None, key: str = "flight_id") -> DataFrame:
    """Summary, driving factors (top 3), sensor insights, recommended action.

    ``scores``: key, probability, severity.  ``top``: key, rank, channel,
    description, importance (top 5).  ``detection`` (optional): key,
    anomaly_score, flagged_sensors (array, sorted).
    """
    factor = F.concat(F.col("description"), F.lit(" "), _level(F.col("importance")),
                      F.lit(" influenced this prediction (importance: "), fixed("importance", 2), F.lit(")"))
    tl = (top.withColumn("factor", factor).groupBy(key)
          .agg(F.array_sort(F.collect_list(F.struct("rank", "channel", "description", "importance", "factor")))
               .alias("_top")))
    j = scores.select(key, "probability", "severity").join(tl, key, "left")
    if detection is not None:
        j = j.join(detection.select(key, "anomaly_score", "flagged_sensors"), key, "left")
    else:
        j = j.withColumn("anomaly_score", F.lit(None).cast("double")) \
             .withColumn("flagged_sensors", F.lit(None).cast("array<string>"))
    top_arr = F.coalesce(F.col("_top"), F.array().cast(
        "array<struct<rank:int,channel:string,description:string,importance:double,factor:string>>"))
    names = F.transform(top_arr, lambda x: x["channel"])
    factors = F.transform(F.slice(top_arr, 1, 3), lambda x: x["factor"])
    hit = {g: any_of(_group_members(chanset, g), names) for g in dims.SENSOR_GROUPS}
    flagged = F.coalesce(F.col("flagged_sensors"), F.array().cast("array<string>"))
    stat = F.when(is_true(F.col("anomaly_score") > 0.05) & (F.size(flagged) > 0),
                  F.concat(F.lit("Statistical anomalies detected in: "), F.concat_ws(", ", F.slice(flagged, 1, 3)),
                           F.lit(".")))
    insights = F.filter(F.array(*[F.when(hit[g], F.lit(txt)) for g, txt in dims.GROUP_INSIGHTS], stat),
                        lambda x: x.isNotNull())
    prob = pct1("probability")
    summary = F.coalesce(*[F.when(F.col("severity") == s, F.format_string(tpl, prob))
                           for s, tpl in dims.SUMMARY_TEMPLATES.items()], F.lit(""))

    def priority(choices, fallback):
        expr = None
        for g, text in choices:
            expr = F.when(hit[g], F.lit(text)) if expr is None else expr.when(hit[g], F.lit(text))
        return expr.otherwise(F.lit(fallback))

    sev = F.col("severity")
    action = (F.when(sev == "CRITICAL", F.concat(F.lit(dims.CRITICAL_ACTION_PREFIX),
                                                 priority(dims.CRITICAL_PRIORITY, dims.CRITICAL_FALLBACK)))
              .when(sev == "HIGH", F.concat(F.lit(dims.HIGH_ACTION_PREFIX),
                                            priority(dims.HIGH_PRIORITY, dims.HIGH_FALLBACK)))
              .when(sev == "MEDIUM", F.lit(dims.MEDIUM_ACTION))
              .when(sev == "NORMAL", F.lit(dims.NORMAL_ACTION)).otherwise(F.lit("")))
    return j.select(key, summary.alias("summary"), factors.alias("driving_factors"),
                    insights.alias("sensor_insights"), action.alias("recommended_action"))


def flat_explanation(expl: DataFrame, key: str = "flight_id", sep: str = " || ") -> DataFrame:
    """The explanation with list fields joined into strings (the comparable flat form)."""
    return expl.select(key, "summary", F.concat_ws(sep, "driving_factors").alias("driving_factors"),
                       F.concat_ws(sep, "sensor_insights").alias("sensor_insights"), "recommended_action")
