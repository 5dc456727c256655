"""Registered queries: per-phase baseline and persistent-anomaly detection on the sensor role.

Sensor role = ``lineitem`` (flight = supplier), healthy flights = suppliers
with label 0, z threshold 1.7 (FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small, settled
from ..operators import anomaly as an
from ..operators import chunked
from ..sources import tables as tb
from .common import PHASE_VALUES_SQL, rounded, sql_phase_case


def _detect_inputs(spark: SparkSession, sf: str, with_t: bool = False, fit_only: bool = False):
    raw = an.assign_phase(tb.lineitem_sensor(spark, sf), tb.LINEITEM_PHASES)
    labels = tb.supplier_labels(spark, sf)
    # the fit needs no step order, so it reads the unordered rows
    healthy = raw.join(broadcast_if_small(labels.where("label = 0").select("flight_id")), "flight_id", "left_semi")
    base = an.fit_baseline(healthy, tb.LINEITEM_CHANNELS)
    if not fit_only:
        base = settled(base, "baseline")  # a fitted model: a few rows, computed once for all that detect with it
    rows = raw
    if with_t:
        rows = an.assign_phase(chunked.dense_index(tb.lineitem_sensor(spark, sf), "flight_id", tb.LINEITEM_ORDER),
                               tb.LINEITEM_PHASES)
    return rows, base


def _stats(spark, sf, base=None):
    """Rows, the fitted baseline (``base``, or fitted here) and the detection's statistics."""
    if base is None:
        rows, base = _detect_inputs(spark, sf)
    else:
        rows = an.assign_phase(tb.lineitem_sensor(spark, sf), tb.LINEITEM_PHASES)
    st = an.phase_channel_stats(rows, base, tb.LINEITEM_CHANNELS, z_threshold=tb.LINEITEM_Z)
    return rows, base, st


def q_flight_phase(spark, sf):
    rows = an.assign_phase(tb.lineitem_sensor(spark, sf), tb.LINEITEM_PHASES)
    return rows.groupBy("flight_id", "phase").agg(F.count(F.lit(1)).alias("n_rows"))


def q_baseline_fit(spark, sf):
    _, base = _detect_inputs(spark, sf, fit_only=True)
    return rounded(base)


def q_phase_channel_stats(spark, sf):
    _, _, st = _stats(spark, sf)
    return rounded(st.drop("channel_idx"))


def q_anomaly_score(spark, sf):
    rows, _, st = _stats(spark, sf)
    return an.anomaly_score(st, rows, tb.lineitem_channels())


def q_phase_anomalies(spark, sf):
    rows, _, st = _stats(spark, sf)
    return an.phase_anomalies(st, rows, tb.lineitem_channels()).drop("phase_ord")


def q_flagged_sensors(spark, sf):
    _, _, st = _stats(spark, sf)
    return an.flagged_sensors(st, tb.lineitem_channels())


def q_top_anomalies(spark, sf):
    _, _, st = _stats(spark, sf)
    return rounded(an.top_anomalies(st, tb.lineitem_channels()))


def _timeline(spark, sf):
    """The timeline and the baseline it was made with."""
    rows, base = _detect_inputs(spark, sf, with_t=True)
    raw = an.assign_phase(tb.lineitem_sensor(spark, sf), tb.LINEITEM_PHASES)
    return an.anomaly_timeline(rows, base, tb.LINEITEM_CHANNELS, z_threshold=tb.LINEITEM_Z, unordered=raw), base


def q_anomaly_timeline(spark, sf):
    return _timeline(spark, sf)[0]


QUERIES = {
    "b_flight_phase": q_flight_phase,
    "d_baseline_fit": q_baseline_fit,
    "d_phase_channel_stats": q_phase_channel_stats,
    "d_anomaly_score": q_anomaly_score,
    "d_phase_anomalies": q_phase_anomalies,
    "d_flagged_sensors": q_flagged_sensors,
    "f_top_anomalies": q_top_anomalies,
    "d_anomaly_timeline": q_anomaly_timeline,
}

# ---------------------------------------------------------------- SQL twins
_PHASE = sql_phase_case("l_quantity", "l_extendedprice", 25, 40000, 12, 20000)

SENSOR_CTE = f"""
s AS (
  SELECT l_suppkey AS flight_id, l_shipdate, l_orderkey, l_linenumber, l_partkey,
         CAST(l_quantity AS DOUBLE) AS qty, CAST(l_extendedprice AS DOUBLE) AS price,
         CAST(l_discount AS DOUBLE) AS disc, CAST(l_tax AS DOUBLE) AS tax,
         {_PHASE} AS phase
  FROM lineitem),
sl AS (
  SELECT flight_id, phase, 'qty' AS channel, 0 AS channel_idx, qty AS v FROM s UNION ALL
  SELECT flight_id, phase, 'price', 1, price FROM s UNION ALL
  SELECT flight_id, phase, 'disc', 2, disc FROM s UNION ALL
  SELECT flight_id, phase, 'tax', 3, tax FROM s),
hok AS (
  SELECT flight_id, phase FROM s
  WHERE flight_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 2500)
  GROUP BY flight_id, phase HAVING count(*) >= 30),
base AS (
  SELECT phase, channel, avg(v) AS mean,
         CASE WHEN stddev_pop(v) < 1e-6 THEN 1.0 ELSE stddev_pop(v) END AS std,
         count(*) AS n_rows
  FROM sl SEMI JOIN hok USING (flight_id, phase)
  GROUP BY phase, channel),
st AS (
  SELECT sl.flight_id, sl.channel, sl.channel_idx, sl.phase, count(*) AS n,
         sum(CASE WHEN abs((v - mean) / std) > 1.7 THEN 1 ELSE 0 END) AS n_flagged,
         max(abs((v - mean) / std)) AS max_z
  FROM sl JOIN base USING (phase, channel)
  GROUP BY sl.flight_id, sl.channel, sl.channel_idx, sl.phase HAVING count(*) >= 30),
stp AS (
  SELECT st.*, CAST(n_flagged AS DOUBLE) / n AS pct_flagged, CAST(n_flagged AS DOUBLE) / n >= 0.05 AS persistent
  FROM st),
pm AS (SELECT stp.*, p.weight, p.phase_ord FROM stp JOIN {PHASE_VALUES_SQL} p USING (phase)
       WHERE persistent AND channel IN ('disc', 'tax'))
"""

ORACLE = {
    "b_flight_phase": f"WITH {SENSOR_CTE} SELECT flight_id, phase, count(*) AS n_rows FROM s GROUP BY 1, 2",
    "d_baseline_fit": f"""WITH {SENSOR_CTE}
        SELECT phase, channel, round(mean, 6) AS mean, round(std, 6) AS std,
               n_rows FROM base""",
    "d_phase_channel_stats": f"""WITH {SENSOR_CTE}
        SELECT flight_id, channel, phase, n, CAST(n_flagged AS BIGINT) AS n_flagged,
               round(pct_flagged, 6) AS pct_flagged, round(max_z, 6) AS max_z, persistent FROM stp""",
    "d_anomaly_score": f"""WITH {SENSOR_CTE},
        sc AS (SELECT flight_id, sum(pct_flagged * weight) / sum(weight) AS s FROM pm GROUP BY flight_id)
        SELECT f.flight_id, round(least(coalesce(sc.s, 0.0), 1.0), 4) AS anomaly_score
        FROM (SELECT DISTINCT flight_id FROM s) f LEFT JOIN sc USING (flight_id)""",
    "d_phase_anomalies": f"""WITH {SENSOR_CTE},
        pa AS (SELECT flight_id, phase, sum(n_flagged * weight) AS w FROM pm GROUP BY 1, 2)
        SELECT f.flight_id, p.phase, CAST(trunc(coalesce(pa.w, 0.0)) AS INTEGER) AS count
        FROM (SELECT DISTINCT flight_id FROM s) f CROSS JOIN {PHASE_VALUES_SQL} p
        LEFT JOIN pa ON pa.flight_id = f.flight_id AND pa.phase = p.phase""",
    "d_flagged_sensors": f"""WITH {SENSOR_CTE}
        SELECT DISTINCT flight_id, channel FROM pm WHERE channel NOT IN ('qty', 'price')""",
    "f_top_anomalies": f"""WITH {SENSOR_CTE},
        r AS (SELECT flight_id, channel AS sensor, phase, round(max_z, 2) AS max_z,
                     round(pct_flagged * 100.0, 1) AS pct_flagged,
                     row_number() OVER (PARTITION BY flight_id ORDER BY round(max_z, 2) DESC, channel_idx, phase_ord) AS rank
              FROM pm WHERE channel NOT IN ('qty', 'price'))
        SELECT flight_id, CAST(rank AS INTEGER) AS rank, sensor, phase, max_z, pct_flagged FROM r WHERE rank <= 5""",
    "d_anomaly_timeline": f"""WITH {SENSOR_CTE},
        pn AS (SELECT flight_id, phase, count(*) AS pn FROM s GROUP BY 1, 2),
        z AS (SELECT s.flight_id, s.phase,
                 CAST(row_number() OVER (PARTITION BY s.flight_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS INTEGER) AS t,
                 abs((qty - bq.mean) / bq.std) AS zq, abs((price - bp.mean) / bp.std) AS zp,
                 abs((disc - bd.mean) / bd.std) AS zd, abs((tax - bt.mean) / bt.std) AS zt
              FROM s
              LEFT JOIN base bq ON bq.phase = s.phase AND bq.channel = 'qty'
              LEFT JOIN base bp ON bp.phase = s.phase AND bp.channel = 'price'
              LEFT JOIN base bd ON bd.phase = s.phase AND bd.channel = 'disc'
              LEFT JOIN base bt ON bt.phase = s.phase AND bt.channel = 'tax')
        SELECT z.flight_id, z.t,
               CASE WHEN pn.pn >= 30 AND (coalesce(zq > 1.7, false) OR coalesce(zp > 1.7, false)
                    OR coalesce(zd > 1.7, false) OR coalesce(zt > 1.7, false)) THEN 1 ELSE 0 END AS flag
        FROM z JOIN pn USING (flight_id, phase)""",
}
