"""Registered queries: drift (PSI), evaluation metrics, promotion and retrain rules.

Drift compares the normalised train split with the test split of the
prepared sensor role; metrics use the scored-flight role (FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import drift as dr
from ..operators import metrics as mt
from ..sources import tables as tb
from . import series_plans as sp
from . import split_plans as spl
from .common import rounded

CH = spl.NORM_CHANNELS


def _psi(spark, sf, p=None):
    # PSI is invariant under the per-channel affine z-score, so the prepared values are
    # compared directly; both engines then bin bit-identical inputs.
    z = spl.prepared_with_split(spark, sf) if p is None else p
    sides = dr.tag_split_sides(z, CH)
    return dr.psi_by_channel(sides, CH)


def q_psi_drift(spark, sf):
    p = _psi(spark, sf)
    return p.select("channel", F.round("psi", 4).alias("psi"),
                    (F.col("psi") > dims.DRIFT_THRESHOLD).alias("drifted"))


def q_drift_report(spark, sf):
    return rounded(dr.drift_report(_psi(spark, sf)))


def _metrics(spark, sf):
    return mt.evaluate(tb.scored_labels(spark, sf))


def q_classification_metrics(spark, sf):
    return rounded(_metrics(spark, sf))


def q_promotion_decision(spark, sf):
    return mt.promotion_decision(_metrics(spark, sf))


def q_retrain_trigger(spark, sf):
    rep = dr.drift_report(_psi(spark, sf)).select("avg_psi")
    m = _metrics(spark, sf).select("f1")
    j = rep.withColumn("_j", F.lit(1)).join(m.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return rounded(j.withColumn("retrain", mt.retrain_trigger("avg_psi", "f1")))


QUERIES = {
    "d_psi_drift": q_psi_drift,
    "d_drift_report": q_drift_report,
    "d_classification_metrics": q_classification_metrics,
    "i_promotion_decision": q_promotion_decision,
    "i_retrain_trigger": q_retrain_trigger,
}

# ---------------------------------------------------------------- SQL twins
_NB = dims.PSI_BINS
PSI_CTE = f"""
sides AS (SELECT 'expected' AS side, {', '.join(CH)} FROM ps WHERE split = 'train'
          UNION ALL SELECT 'actual', {', '.join(CH)} FROM ps WHERE split = 'test'),
lv AS ({' UNION ALL '.join(f"SELECT side, '{c}' AS channel, {i} AS idx, {c} AS v FROM sides" for i, c in enumerate(CH))}),
rg AS (SELECT channel, min(v) AS lo, max(v) AS hi FROM lv GROUP BY channel),
b0 AS (SELECT lv.side, lv.channel, lv.idx, lv.v, rg.lo, rg.hi, (rg.hi - rg.lo) / CAST({_NB} AS DOUBLE) AS step
       FROM lv JOIN rg USING (channel)),
b1 AS (SELECT *, CASE WHEN hi = lo THEN 0.0
                      ELSE CAST(least(greatest(floor((v - lo) / step), 0), {_NB - 1}) AS DOUBLE) END AS g FROM b0),
b2 AS (SELECT side, channel, idx, CASE WHEN hi = lo THEN {_NB - 1}
                                  WHEN g > 0 AND v < g * step + lo THEN CAST(g - 1 AS INTEGER)
                                  WHEN g < {_NB - 1} AND v >= (g + 1.0) * step + lo THEN CAST(g + 1 AS INTEGER)
                                  ELSE CAST(g AS INTEGER) END AS bin FROM b1),
sidecount AS (SELECT side, count(*) / {len(CH)} AS n FROM lv GROUP BY side),
grid AS (SELECT s.side, c.channel, c.idx, b.bin FROM (SELECT DISTINCT side FROM lv) s,
         (SELECT DISTINCT channel, idx FROM lv) c, (SELECT range AS bin FROM range({_NB})) b),
cnt AS (SELECT side, channel, bin, count(*) AS c FROM b2 GROUP BY ALL),
sh AS (SELECT grid.side, grid.channel, grid.idx, grid.bin,
              CAST(coalesce(cnt.c, 0) AS DOUBLE) / ns.n + 1e-6 AS share
       FROM grid JOIN sidecount ns USING (side) LEFT JOIN cnt USING (side, channel, bin)),
psi AS (SELECT e.channel, e.idx, sum((a.share - e.share) * ln(a.share / e.share)) AS psi
        FROM sh e JOIN sh a ON a.channel = e.channel AND a.bin = e.bin AND a.side = 'actual'
        WHERE e.side = 'expected' GROUP BY e.channel, e.idx),
rep AS (SELECT avg(round(psi, 4)) AS avg_psi, count(*) FILTER (WHERE psi > 0.2) AS n_drifted,
               coalesce(string_agg(channel, ',' ORDER BY idx) FILTER (WHERE psi > 0.2), '') AS drifted_channels
        FROM psi)
"""

SC_LABELS = """
sc AS (SELECT l.doc_id AS flight_id, CAST(l.toxic AS INTEGER) AS label,
              (CAST(d.n_chars AS DOUBLE) - 1000.0) / 1000.0 AS logit,
              1.0 / (1.0 + exp(-((CAST(d.n_chars AS DOUBLE) - 1000.0) / 1000.0))) AS prob
       FROM labels l JOIN documents d USING (doc_id)),"""

METRICS_CTE = """
cm AS (SELECT count(*) AS n,
              count(*) FILTER (WHERE prob >= 0.35 AND label = 1) AS tp,
              count(*) FILTER (WHERE prob >= 0.35 AND label <> 1) AS fp,
              count(*) FILTER (WHERE NOT (prob >= 0.35) AND label = 1) AS fn,
              count(*) FILTER (WHERE NOT (prob >= 0.35) AND label <> 1) AS tn FROM sc),
rk AS (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r FROM sc),
au AS (SELECT CASE WHEN n1 > 0 AND n0 > 0 THEN (sr - n1 * (n1 + 1) / 2.0) / (n1 * n0) ELSE 0.5 END AS auc
       FROM (SELECT sum(CASE WHEN label = 1 THEN r END) AS sr, count(*) FILTER (WHERE label = 1) AS n1,
                    count(*) FILTER (WHERE label = 0) AS n0 FROM rk)),
clw AS (SELECT CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE label = 1), 0) AS pos_weight
       FROM sc),
ll AS (SELECT avg(coalesce(clw.pos_weight, 1.0) * label * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))
                  + (1 - label) * (greatest(logit, 0) + ln(1 + exp(-abs(logit))))) AS loss FROM sc, clw),
mx AS (SELECT n, tp, fp, fn, tn,
              coalesce(CAST(tp + tn AS DOUBLE) / nullif(n, 0), 0.0) AS accuracy,
              coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
              coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
              coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
              auc, pos_weight, loss
       FROM cm, au, clw, ll)
"""

SCORED_CTE = SC_LABELS + METRICS_CTE


def _f4sql(x) -> str:
    return f"coalesce(printf('%.4f', {x}), 'nan')"


PROMO_CTE = f"""
ok AS (SELECT *, coalesce(f1 > {mt.CURRENT_F1} + 0.01, false) AS f1_better,
              coalesce(recall >= {mt.CURRENT_RECALL} - 0.02, false) AS recall_ok,
              coalesce(auc >= {mt.CURRENT_AUC} - 0.005, false) AS auc_ok FROM mx),
promo AS (
  SELECT f1_better AND recall_ok AND auc_ok AS promote,
         CASE WHEN f1_better AND recall_ok AND auc_ok THEN
              'F1: ' || {_f4sql(mt.CURRENT_F1)} || '→' || {_f4sql('f1')} || ' | Recall: ' || {_f4sql('recall')}
              || ' | AUC: ' || {_f4sql('auc')}
         ELSE concat_ws(' | ',
              CASE WHEN NOT f1_better THEN 'F1 not improved (' || {_f4sql(mt.CURRENT_F1)} || '→' || {_f4sql('f1')} || ')' END,
              CASE WHEN NOT recall_ok THEN 'Recall degraded (' || {_f4sql(mt.CURRENT_RECALL)} || '→' || {_f4sql('recall')} || ')' END,
              CASE WHEN NOT auc_ok THEN 'AUC degraded (' || {_f4sql(mt.CURRENT_AUC)} || '→' || {_f4sql('auc')} || ')' END)
         END AS reason,
         f1_better, recall_ok, auc_ok FROM ok)
"""

_NORM = f"WITH {sp.CUTPAD_CTE}, {spl.SUPPLIER_SPLIT_CTE}, {PSI_CTE}"

ORACLE = {
    "d_psi_drift": f"{_NORM} SELECT channel, round(psi, 4) AS psi, psi > 0.2 AS drifted FROM psi",
    "d_drift_report": f"""{_NORM} SELECT round(avg_psi, 6) AS avg_psi, n_drifted, drifted_channels,
        avg_psi > 0.2 AS drift_flag, CAST(0.2 AS DOUBLE) AS threshold FROM rep""",
    "d_classification_metrics": f"""WITH {SCORED_CTE}
        SELECT n, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
               round(recall, 6) AS recall, round(f1, 6) AS f1, round(auc, 6) AS auc,
               round(pos_weight, 6) AS pos_weight, round(loss, 6) AS loss FROM mx""",
    "i_promotion_decision": f"WITH {SCORED_CTE}, {PROMO_CTE} SELECT * FROM promo",
    "i_retrain_trigger": f"""{_NORM}, {SCORED_CTE}
        SELECT round(avg_psi, 6) AS avg_psi, round(f1, 6) AS f1,
               coalesce(avg_psi > 0.2, false) OR coalesce(({mt.CURRENT_F1} - f1) / {mt.CURRENT_F1} > 0.05, false) AS retrain
        FROM rep, mx""",
}
