"""Registered queries: local per-flight anomaly view, segments, durations, detail cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..operators import local as lc
from ..sources import tables as tb
from . import anomaly_plans as ap
from . import series_plans as sp
from .common import rounded

EV_CH = tb.EVENTS_CHANNELS
LI_DISPLAY = [c.name for c in tb.lineitem_channels().channels if c.display]
# lineitem channels are near uniform (|z| <= 1.73), so the local view there uses 1.6
LI_LOCAL_Z = 1.6


def _events_flags(spark, sf):
    return lc.local_flags(sp._events_ordered(spark, sf), EV_CH)


def q_local_flags(spark, sf):
    return _events_flags(spark, sf).select("flight_id", "t", *[f"{c}_flag" for c in EV_CH])


def q_local_flight_score(spark, sf):
    s = lc.local_flight_score(_events_flags(spark, sf), EV_CH)
    return rounded(s.withColumn("activity", lc.activity_label("local_score")))


def q_anomaly_segments(spark, sf):
    series = lc.combined_any_flag(_events_flags(spark, sf), EV_CH)
    return lc.anomaly_segments(series, chunk_steps=16)


def _lineitem_local(spark, sf):
    rows, base = ap._detect_inputs(spark, sf, with_t=True)
    return rows, base, lc.local_flags(rows, LI_DISPLAY, z_threshold=LI_LOCAL_Z)


def q_combined_duration(spark, sf):
    """Durations need no step order: the detector's flag stays beside the channels, and both views share the rows."""
    rows, base = ap._detect_inputs(spark, sf)
    seen = an.anomaly_timeline(rows, base, tb.LINEITEM_CHANNELS, t=None, z_threshold=tb.LINEITEM_Z, keep=LI_DISPLAY)
    return rounded(lc.combined_duration(lc.local_flags(seen, LI_DISPLAY, z_threshold=LI_LOCAL_Z), None, LI_DISPLAY))


def q_worst_anomaly_detail(spark, sf):
    rows, base, flags = _lineitem_local(spark, sf)
    st = an.phase_channel_stats(rows, base, tb.LINEITEM_CHANNELS, z_threshold=tb.LINEITEM_Z)
    top = an.top_anomalies(st, tb.lineitem_channels())
    return rounded(lc.worst_anomaly_detail(lc.local_channel_share(flags, LI_DISPLAY), top))


QUERIES = {
    "d_local_flags": q_local_flags,
    "d_local_flight_score": q_local_flight_score,
    "e_anomaly_segments": q_anomaly_segments,
    "d_combined_duration": q_combined_duration,
    "c_worst_anomaly_detail": q_worst_anomaly_detail,
}

# ---------------------------------------------------------------- SQL twins
EV_FLAGS_CTE = """
e AS (
  SELECT user_id AS flight_id, CAST(value AS DOUBLE) AS value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t
  FROM events),
es AS (SELECT flight_id, avg(value) AS mv, CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END AS sv,
              avg(k) AS mk, CASE WHEN stddev_pop(k) < 1e-6 THEN 1.0 ELSE stddev_pop(k) END AS sk
       FROM e GROUP BY flight_id),
ef AS (SELECT e.flight_id, e.t,
              CAST(coalesce(abs((value - mv) / sv) > 2.5, false) AS INTEGER) AS value_flag,
              CAST(coalesce(abs((k - mk) / sk) > 2.5, false) AS INTEGER) AS k_flag
       FROM e JOIN es USING (flight_id)),
eshare AS (SELECT flight_id, avg(value_flag) >= 0.03 AS pv, avg(k_flag) >= 0.03 AS pk FROM ef GROUP BY flight_id),
eany AS (SELECT ef.flight_id, ef.t,
                greatest(CASE WHEN pv THEN value_flag ELSE 0 END, CASE WHEN pk THEN k_flag ELSE 0 END) AS flag
         FROM ef JOIN eshare USING (flight_id))
"""

LI_LOCAL_CTE = """
lt AS (SELECT s.*, CAST(row_number() OVER (PARTITION BY flight_id
              ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS INTEGER) AS t FROM s),
ls AS (SELECT flight_id, avg(disc) AS md, CASE WHEN stddev_pop(disc) < 1e-6 THEN 1.0 ELSE stddev_pop(disc) END AS sd,
              avg(tax) AS mt, CASE WHEN stddev_pop(tax) < 1e-6 THEN 1.0 ELSE stddev_pop(tax) END AS stx
       FROM lt GROUP BY flight_id),
lf AS (SELECT lt.*, CAST(coalesce(abs((disc - md) / sd) > 1.6, false) AS INTEGER) AS disc_flag,
              CAST(coalesce(abs((tax - mt) / stx) > 1.6, false) AS INTEGER) AS tax_flag
       FROM lt JOIN ls USING (flight_id)),
lshare AS (SELECT flight_id, 'disc' AS channel, avg(disc_flag) AS share FROM lf GROUP BY flight_id
           UNION ALL SELECT flight_id, 'tax', avg(tax_flag) FROM lf GROUP BY flight_id)
"""

ORACLE = {
    "d_local_flags": f"WITH {EV_FLAGS_CTE} SELECT flight_id, t, value_flag, k_flag FROM ef",
    "d_local_flight_score": f"""WITH {EV_FLAGS_CTE},
        sc AS (SELECT flight_id, avg(CAST(flag AS DOUBLE)) AS local_score FROM eany GROUP BY flight_id),
        ch AS (SELECT flight_id, 'value' AS c FROM eshare WHERE pv UNION ALL SELECT flight_id, 'k' FROM eshare WHERE pk),
        li AS (SELECT flight_id, count(*) AS n, string_agg(c, ',' ORDER BY c) AS l FROM ch GROUP BY flight_id)
        SELECT sc.flight_id, round(local_score, 6) AS local_score, CAST(coalesce(n, 0) AS BIGINT) AS n_sensors_flagged,
               coalesce(l, '') AS sensors_flagged,
               CASE WHEN local_score > 0.20 THEN 'High anomaly activity'
                    WHEN local_score > 0.08 THEN 'Moderate anomaly activity' ELSE 'Low anomaly activity' END AS activity
        FROM sc LEFT JOIN li USING (flight_id)""",
    "e_anomaly_segments": f"""WITH {EV_FLAGS_CTE},
        fl AS (SELECT flight_id, t, lag(t) OVER (PARTITION BY flight_id ORDER BY t) AS prev FROM eany WHERE flag = 1),
        nw AS (SELECT *, sum(CASE WHEN prev IS NULL OR t - prev > 15 THEN 1 ELSE 0 END)
                          OVER (PARTITION BY flight_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS segment FROM fl)
        SELECT flight_id, CAST(segment AS INTEGER) AS segment, min(t) AS seg_start, max(t) AS seg_end
        FROM nw GROUP BY flight_id, segment""",
    "c_worst_anomaly_detail": f"""WITH {ap.SENSOR_CTE}, {LI_LOCAL_CTE},
        top AS (SELECT flight_id, channel AS sensor, phase, round(max_z, 2) AS max_z,
                       row_number() OVER (PARTITION BY flight_id ORDER BY round(max_z, 2) DESC, channel_idx, phase_ord) AS rank
                FROM pm WHERE channel NOT IN ('qty', 'price')),
        top5 AS (SELECT * FROM top WHERE rank <= 5),
        lastt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, sensor ORDER BY rank DESC) AS k
                                 FROM top5) WHERE k = 1)
        SELECT l.flight_id, l.channel AS sensor, round(l.share * 100.0, 6) AS pct_local,
               coalesce(lastt.phase, '') AS phase, round(coalesce(lastt.max_z, 0.0), 6) AS max_z
        FROM lshare l LEFT JOIN lastt ON lastt.flight_id = l.flight_id AND lastt.sensor = l.channel
        WHERE l.share >= 0.03""",
}

# D27 needs the detector timeline; written out in full here.
ORACLE["d_combined_duration"] = f"""WITH {ap.SENSOR_CTE}, {LI_LOCAL_CTE},
    pn AS (SELECT flight_id, phase, count(*) AS pn FROM s GROUP BY 1, 2),
    z AS (SELECT lf.flight_id, lf.t, lf.phase, lf.disc_flag, lf.tax_flag,
                 abs((qty - bq.mean) / bq.std) AS zq, abs((price - bp.mean) / bp.std) AS zp,
                 abs((disc - bd.mean) / bd.std) AS zd, abs((tax - bt.mean) / bt.std) AS zt
          FROM lf
          LEFT JOIN base bq ON bq.phase = lf.phase AND bq.channel = 'qty'
          LEFT JOIN base bp ON bp.phase = lf.phase AND bp.channel = 'price'
          LEFT JOIN base bd ON bd.phase = lf.phase AND bd.channel = 'disc'
          LEFT JOIN base bt ON bt.phase = lf.phase AND bt.channel = 'tax'),
    g AS (SELECT z.*, CASE WHEN pn.pn >= 30 AND (coalesce(zq > 1.7, false) OR coalesce(zp > 1.7, false)
                 OR coalesce(zd > 1.7, false) OR coalesce(zt > 1.7, false)) THEN 1 ELSE 0 END AS gf
          FROM z JOIN pn USING (flight_id, phase)),
    d AS (SELECT flight_id, count(*) AS n, sum(greatest(disc_flag, gf)) AS dd, sum(greatest(tax_flag, gf)) AS dt
          FROM g GROUP BY flight_id)
    SELECT flight_id, 'disc' AS channel, CAST(dd AS BIGINT) AS anomaly_duration, round(dd * 100.0 / n, 6) AS anomaly_pct FROM d
    UNION ALL
    SELECT flight_id, 'tax', CAST(dt AS BIGINT), round(dt * 100.0 / n, 6) FROM d"""
