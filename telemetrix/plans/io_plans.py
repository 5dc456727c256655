"""Registered queries: nested-array input (A8) and the arrival stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import anomaly as an
from ..operators import score as sc
from ..operators import split_norm as sn
from ..session import scratch_path
from ..sources import io
from ..sources import tables as tb
from ..streaming import arrivals
from . import score_plans as scp
from . import series_plans as sp
from . import split_plans as spl
from .common import PHASE_VALUES_SQL, rounded, sql_phase_case

EMB_STEPS, EMB_CHANNELS = 8, 8
EMB_COLS = [f"c{i}" for i in range(EMB_CHANNELS)]
J1_CHANNELS = spl.NORM_CHANNELS
J1_CHANSET = tb.lineitem_prepared_channels()


def q_nested_input(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    nested = emb.select(F.col("vec_id").alias("flight_id"),
                        io.reshape_vector("embedding", EMB_STEPS, EMB_CHANNELS).alias("flight_data"))
    valid, _ = io.validate_nested(nested, "flight_data", EMB_STEPS, EMB_CHANNELS)
    return rounded(io.explode_nested(valid, "flight_id", "flight_data", EMB_COLS))


def j1_baseline(spark, sf):
    """Static baseline for the stream: healthy train flights of the prepared sensor role."""
    p = spl.prepared_with_split(spark, sf)
    healthy = an.assign_phase(p.where("split = 'train' AND label = 0"), tb.LINEITEM_PHASES)
    return p, an.fit_baseline(healthy, J1_CHANSET.scored)


def q_stream_arrivals(spark, sf):
    p, base = j1_baseline(spark, sf)
    stats = sn.norm_stats(p.where("split = 'train'"), J1_CHANNELS)
    feats = sc.pooled_features(sn.apply_zscore(p, stats, J1_CHANNELS), J1_CHANNELS)
    coef = sc.fit_centroid_scorer(feats, p.where("split = 'train'").select("flight_id", "label").distinct(), J1_CHANNELS)
    run = scratch_path(spark, f"arrivals-{uuid.uuid4().hex[:12]}")
    arrivals.replay_as_files(io.nest_flights(p, "flight_id", J1_CHANNELS), f"{run}/in")
    arrivals.analyse_arrivals(spark, f"{run}/in", f"{run}/out", f"{run}/ckpt", base, J1_CHANSET,
                              J1_CHANNELS, tb.LINEITEM_PHASES, tb.LINEITEM_N, z_threshold=tb.LINEITEM_Z,
                              scorer=arrivals.Scorer(stats, coef))
    return rounded(spark.read.parquet(f"{run}/out/scores").select(
        "flight_id", "anomaly_score", "flagged_sensors", "probability", "prediction", "severity"))


def q_stream_rejects(spark, sf):
    """J1's reject arm: one flight of a wrong shape per supplier among the good ones."""
    p, base = j1_baseline(spark, sf)
    good = io.nest_flights(p, "flight_id", J1_CHANNELS)
    bad = spark.read.parquet(f"{sf}/supplier.parquet").select(
        (-F.col("s_suppkey") - 1).alias("flight_id"), F.array(F.array(F.col("s_acctbal"))).alias("flight_data"))
    run = scratch_path(spark, f"arrivals-{uuid.uuid4().hex[:12]}")
    arrivals.replay_as_files(good.unionByName(bad), f"{run}/in")
    arrivals.analyse_arrivals(spark, f"{run}/in", f"{run}/out", f"{run}/ckpt", base, J1_CHANSET,
                              J1_CHANNELS, tb.LINEITEM_PHASES, tb.LINEITEM_N, z_threshold=tb.LINEITEM_Z)
    return spark.read.parquet(f"{run}/out/rejects").select("flight_id", "reject_reason")


QUERIES = {
    "a_nested_input": q_nested_input,
    "j_stream_arrivals": q_stream_arrivals,
    "j_stream_rejects": q_stream_rejects,
}


# ---------------------------------------------------------------- SQL twins
def detect_sql(src: str, channels, maint, pilot, phase_case: str, healthy_where: str, z: float) -> str:
    """Detection CTEs (baseline fit on healthy rows, stats, persistent maintenance pairs) over ``src``."""
    long = " UNION ALL ".join(f"SELECT flight_id, phase, '{c}' AS channel, {i} AS channel_idx, {c} AS v FROM jr"
                              for i, c in enumerate(channels))
    return f"""
jr AS (SELECT *, {phase_case} AS phase FROM {src}),
jl AS ({long}),
jhok AS (SELECT flight_id, phase FROM jr WHERE {healthy_where} GROUP BY flight_id, phase HAVING count(*) >= 30),
jbase AS (SELECT phase, channel, avg(v) AS mean,
                 CASE WHEN stddev_pop(v) < 1e-6 THEN 1.0 ELSE stddev_pop(v) END AS std
          FROM jl SEMI JOIN jhok USING (flight_id, phase) GROUP BY phase, channel),
jst AS (SELECT jl.flight_id, jl.channel, jl.phase, count(*) AS n,
               sum(CASE WHEN abs((v - mean) / std) > {z} THEN 1 ELSE 0 END) AS nf
        FROM jl JOIN jbase USING (phase, channel) GROUP BY ALL HAVING count(*) >= 30),
jpm AS (SELECT jst.*, CAST(nf AS DOUBLE) / n AS pct, p.weight FROM jst JOIN {PHASE_VALUES_SQL} p USING (phase)
        WHERE CAST(nf AS DOUBLE) / n >= 0.05 AND channel IN ({', '.join(f"'{m}'" for m in maint)})),
jsc AS (SELECT flight_id, sum(pct * weight) / sum(weight) AS s FROM jpm GROUP BY flight_id),
jfl AS (SELECT flight_id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS fl FROM jpm
        WHERE channel NOT IN ({', '.join(f"'{m}'" for m in pilot) or "''"}) GROUP BY flight_id)
"""


_J1_PHASE = sql_phase_case("qty", "price", 25.0, 40000.0, 12.0, 20000.0)
_J1 = detect_sql("ps", J1_CHANSET.scored, J1_CHANSET.select(lambda c: c.maintenance),
                 J1_CHANSET.select(lambda c: c.pilot), _J1_PHASE, "split = 'train' AND label = 0", tb.LINEITEM_Z)

ORACLE = {
    "a_nested_input": f"""
        SELECT vec_id AS flight_id, CAST((i - 1) // {EMB_CHANNELS} AS INTEGER) AS t,
               {', '.join(f"round(CAST(embedding[i - ((i - 1) % {EMB_CHANNELS}) + {k}] AS DOUBLE), 6) AS c{k}" for k in range(EMB_CHANNELS))}
        FROM embeddings, range(1, {EMB_STEPS * EMB_CHANNELS} + 1, {EMB_CHANNELS}) AS r(i)
        WHERE len(embedding) = {EMB_STEPS * EMB_CHANNELS}""",
    "j_stream_arrivals": f"""WITH det AS (WITH {sp.CUTPAD_CTE}, {spl.SUPPLIER_SPLIT_CTE}, {_J1}
        SELECT f.flight_id, round(least(coalesce(jsc.s, 0.0), 1.0), 4) AS anomaly_score,
               coalesce(jfl.fl, '') AS flagged_sensors
        FROM (SELECT DISTINCT flight_id FROM ps) f LEFT JOIN jsc USING (flight_id) LEFT JOIN jfl USING (flight_id)),
        lin AS ({scp.ORACLE['i_linear_score']})
        SELECT flight_id, anomaly_score, flagged_sensors, probability, prediction, severity FROM det JOIN lin USING (flight_id)""",
    "j_stream_rejects": f"""SELECT -s_suppkey - 1 AS flight_id,
        'expected shape ({tb.LINEITEM_N}, {len(J1_CHANNELS)})' AS reject_reason FROM supplier""",
}
