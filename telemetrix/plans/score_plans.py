"""Registered queries: pooled features, linear scorer, attribution, explanation,
flight analysis, fleet report and its summaries.

Flights = suppliers, prepared and normalised (sensor role), with the exact
split; labels from the supplier table (FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import anomaly as an
from ..operators import drift as dr
from ..operators import metrics as mt
from ..operators import explain as ex
from ..operators import local as lc
from ..operators import reports as rp
from ..operators import score as sc
from ..operators import split_norm as sn
from ..operators import timeseries as ts
from ..operators import training as tr
from ..session import materialize
from ..sources import tables as tb
from . import anomaly_plans as ap
from . import series_plans as sp
from . import split_plans as spl
from .common import PHASE_VALUES_SQL, rounded

CH = spl.NORM_CHANNELS
CHSET = tb.lineitem_prepared_channels()
DISPLAY = CHSET.select(lambda c: c.display)
FILTERED = [f"value_d{d}" for d in sp.FILTER_DILATIONS]


def _flights(spark, sf):
    return sn.stratified_split(tb.supplier_labels(spark, sf), "flight_id", "label")


def _model(spark, sf, p=None):
    """Normalised rows (of ``p``, or prepared here), pooled features, fitted coefficients and scores.

    The feature, coefficient and score tables (one row per flight / channel) are
    written once, so the fit, the scoring and the report branches that all read them do not
    re-run the feature -> fit -> score chain over the rows.
    """
    z = spl.normalised(spark, sf, p)
    feats = materialize(sc.pooled_features(z, CH), "features")
    train = _flights(spark, sf).where("split = 'train'")
    coef = materialize(sc.fit_centroid_scorer(feats, train, CH), "coef")
    scores = materialize(sc.score_flights(feats, coef, CH), "scores")
    return z, feats, coef, scores


def _top(spark, sf):
    z, _, coef, scores = _model(spark, sf)
    return sc.top_channels(sc.channel_importance(z, scores, coef, CH), CHSET)


def q_pooled_features(spark, sf):
    return rounded(sc.pooled_features(spl.normalised(spark, sf), CH))


def q_pooled_filters(spark, sf):
    """I2 with E9: per flight, the mean over time of the value and of its rectified filter outputs."""
    e = ts.causal_dilated_filter(sp._events_ordered(spark, sf), "value", sp.FILTER_WEIGHTS, sp.FILTER_DILATIONS, chunk_steps=512)
    return rounded(sc.pooled_features(e, ["value", *FILTERED], rectify=FILTERED))


def q_scorer_coefficients(spark, sf):
    _, _, coef, _ = _model(spark, sf)
    return rounded(coef)


def q_linear_score(spark, sf):
    _, _, _, scores = _model(spark, sf)
    return rounded(scores)


def q_channel_importance(spark, sf):
    z, _, coef, scores = _model(spark, sf)
    return rounded(sc.channel_importance(z, scores, coef, CH).drop("idx"))


def q_temporal_importance(spark, sf):
    z, _, coef, scores = _model(spark, sf)
    return rounded(sc.temporal_importance(z, scores, coef, CH))


def q_top_channels(spark, sf):
    return rounded(_top(spark, sf))


def _explanation(spark, sf, with_timeline=False):
    """Scores, explanation, detection and top channels; the detection is planned once for all of them, and the timeline
    is made with the same baseline."""
    z, _, coef, scores = _model(spark, sf)
    top = sc.top_channels(sc.channel_importance(z, scores, coef, CH), CHSET)
    timeline, base = ap._timeline(spark, sf) if with_timeline else (None, None)
    rows, _, st = ap._stats(spark, sf, base)
    det = materialize(an.detection_summary(st, rows, tb.lineitem_channels(), timeline=timeline), "detection")
    return scores, ex.plain_explanation(scores, top, CHSET, det), det, top


def q_plain_explanation(spark, sf):
    _, e, _, _ = _explanation(spark, sf)
    return ex.flat_explanation(e)


def q_flight_analysis(spark, sf):
    scores, e, det, _ = _explanation(spark, sf)
    a = rp.flight_analysis(scores, det, ex.flat_explanation(e))
    return rounded(a.select("flight_id", "probability", "prediction", "severity", "anomaly_score",
                            F.size("flagged_sensors").alias("n_flagged_sensors"), "summary", "recommended_action"))


def q_alert_json(spark, sf):
    scores, e, det, top = _explanation(spark, sf, with_timeline=True)
    return rp.alert_records(rp.flight_analysis(scores, det, e), top=top).select("flight_id", "alert_json")


def q_alert_fields(spark, sf):
    """A9 + H9 checked: fields of the JSON text, read back by path."""
    j = F.col("alert_json")
    flags = F.from_json(F.get_json_object(j, "$.anomaly.anomaly_timeline"), "array<int>")
    return q_alert_json(spark, sf).select(
        "flight_id", F.get_json_object(j, "$.severity").alias("severity"),
        F.get_json_object(j, "$.anomaly.anomaly_score").cast("double").alias("anomaly_score"),
        F.json_array_length(F.get_json_object(j, "$.anomaly.flagged_sensors")).alias("n_flagged_sensors"),
        F.size(flags).alias("n_steps"), F.aggregate(flags, F.lit(0), lambda a, x: a + x).alias("n_flagged_steps"),
        F.coalesce(F.array_position(flags, 1) - 1, F.lit(-1)).cast("int").alias("first_flagged_step"),
        F.get_json_object(j, "$.top_channels[0].channel").alias("top_channel"),
        F.get_json_object(j, "$.top_channels[0].importance").cast("double").alias("top_importance"))


def _phase_counts(spark, sf):
    rows, _, st = ap._stats(spark, sf)
    return an.phase_anomalies(st, rows, tb.lineitem_channels())


def q_worst_phase(spark, sf):
    return rp.worst_phase(_phase_counts(spark, sf))


def q_phase_share(spark, sf):
    return rounded(rp.phase_share(_phase_counts(spark, sf)))


def q_separation_ratio(spark, sf):
    rows, _, st = ap._stats(spark, sf)
    score = an.anomaly_score(st, rows, tb.lineitem_channels())
    return rounded(rp.separation_ratio(score, tb.supplier_labels(spark, sf)))


def q_severity_counts(spark, sf):
    _, _, _, scores = _model(spark, sf)
    return rounded(rp.severity_counts(scores))


def q_fleet_ranking(spark, sf):
    _, _, _, scores = _model(spark, sf)
    ranked = rp.rank_by_probability(scores)
    return ranked.join(rp.aircraft_ids(scores), "flight_id").select("flight_id", "fleet_rank", "aircraft_id")


def q_priority_flights(spark, sf):
    _, _, _, scores = _model(spark, sf)
    return rounded(rp.priority_filter(scores).select("flight_id", "probability", "severity"))


def _fleet(spark, sf, which=None):
    z, _, coef, scores = _model(spark, sf)
    labels = tb.supplier_labels(spark, sf)
    flights = rp.label_subset(labels, which)
    scores = scores.join(flights.select("flight_id"), "flight_id", "left_semi")
    shown = z.select("flight_id", "t", *DISPLAY)  # the join with the flights' own statistics shuffles no other channel
    local = lc.local_flight_score(lc.local_flags(shown, DISPLAY), DISPLAY)
    top = sc.top_channels(sc.channel_importance(z, scores, coef, CH), CHSET)
    worst = rp.worst_phase(_phase_counts(spark, sf))
    return rp.fleet_status(scores, labels, local, top, worst, len(DISPLAY))


def q_fleet_status(spark, sf):
    return _fleet(spark, sf)


def q_fleet_at_risk(spark, sf):
    return _fleet(spark, sf, which=1)


def q_logistic_score(spark, sf):
    z = spl.normalised(spark, sf)
    feats = sc.pooled_features(z, CH)
    train = _flights(spark, sf).where("split = 'train'")
    model = sc.fit_logistic_scorer(feats, train, CH)
    return rounded(sc.apply_logistic_scorer(model, feats))


def _trained(spark, sf):
    feats = materialize(sc.pooled_features(spl.normalised(spark, sf), CH), "features")
    return feats, tr.fit(feats, _flights(spark, sf), CH)


def q_training_epochs(spark, sf):
    """Rate, train loss and validation F1 of each epoch until the early stop."""
    return rounded(tr.epoch_table(spark, _trained(spark, sf)[1]))


def q_trained_score(spark, sf):
    """I1(b): all flights scored with the weights of the best epoch."""
    feats, model = _trained(spark, sf)
    return rounded(tr.score(feats, model))


def q_trained_attribution(spark, sf):
    """I4 on I1(b): channel importance of the trained model; its coefficients are a table like any scorer's."""
    feats, model = _trained(spark, sf)
    z = spl.normalised(spark, sf)
    return rounded(sc.channel_importance(z, tr.score(feats, model), tr.coefficients(spark, model), CH).drop("idx"))


def _test_scored(spark, sf, p=None):
    _, _, _, scores = _model(spark, sf, p)
    test = _flights(spark, sf).where("split = 'test'").select("flight_id", "label")
    return scores.join(test, "flight_id").select("flight_id", "label", "logit", F.col("probability").alias("prob"))


def q_model_evaluation(spark, sf):
    return rounded(mt.evaluate_with_current(_test_scored(spark, sf)))


def q_retraining_run(spark, sf):
    from . import eval_plans as ep
    p = spl.prepared_with_split(spark, sf)  # drift and evaluation read the same prepared flights
    drift = dr.drift_report(ep._psi(spark, sf, p))
    fl = _flights(spark, sf)
    n_train = fl.where("split = 'train'").agg(F.count(F.lit(1)).alias("n"))
    n_test = fl.where("split = 'test'").agg(F.count(F.lit(1)).alias("n"))
    return rounded(mt.retraining_run(drift, mt.evaluate(_test_scored(spark, sf, p)), n_train, n_test))


QUERIES = {
    "i_pooled_features": q_pooled_features,
    "i_pooled_filters": q_pooled_filters,
    "i_scorer_coefficients": q_scorer_coefficients,
    "i_linear_score": q_linear_score,
    "i_channel_importance": q_channel_importance,
    "i_temporal_importance": q_temporal_importance,
    "f_top_channels": q_top_channels,
    "i_plain_explanation": q_plain_explanation,
    "i_flight_analysis": q_flight_analysis,
    "a_alert_json": q_alert_json, "a_alert_fields": q_alert_fields,
    "d_worst_phase": q_worst_phase,
    "d_phase_share": q_phase_share,
    "d_separation_ratio": q_separation_ratio,
    "d_severity_counts": q_severity_counts,
    "f_fleet_ranking": q_fleet_ranking,
    "b_priority_flights": q_priority_flights,
    "i_fleet_status": q_fleet_status,
    "b_fleet_label_subset": q_fleet_at_risk,
    "i_logistic_score": q_logistic_score,
    "i_training_epochs": q_training_epochs,
    "i_trained_score": q_trained_score,
    "i_trained_attribution": q_trained_attribution,
    "i_model_evaluation": q_model_evaluation,
    "i_retraining_run": q_retraining_run,
}

# ---------------------------------------------------------------- SQL twins
_N = len(CH)
_IDX = list(enumerate(CH))


def _groups_sql() -> dict[str, str]:
    out = {}
    for g in dims.SENSOR_GROUPS:
        members = CHSET.select(lambda c, g=g: c.group == g)
        out[g] = "(" + ", ".join(f"'{m}'" for m in members) + ")" if members else "('')"
    return out


_G = _groups_sql()

MODEL_CTE = f"""
feat AS (SELECT flight_id, count(*) AS n_steps, {', '.join(f'avg({c}) AS {c}' for c in CH)} FROM zn GROUP BY flight_id),
tf AS (SELECT feat.*, ssplit.label FROM feat JOIN ssplit USING (flight_id) WHERE ssplit.split = 'train'),
cst AS (SELECT {', '.join(f"avg({c}) AS mu{i}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd{i}, "
                          f"avg(CASE WHEN label = 1 THEN {c} END) AS p{i}, avg(CASE WHEN label = 0 THEN {c} END) AS q{i}"
                          for i, c in _IDX)} FROM tf),
cw0 AS (SELECT *, {', '.join(f"coalesce((p{i} - mu{i}) / sd{i} - (q{i} - mu{i}) / sd{i}, 0.0) AS w{i}, "
                             f"coalesce(((p{i} - mu{i}) / sd{i} + (q{i} - mu{i}) / sd{i}) / 2.0, 0.0) AS mid{i}"
                             for i, _ in _IDX)} FROM cst),
cw AS (SELECT *, {' + '.join(f'(-w{i}) * mid{i}' for i, _ in _IDX)} AS bias FROM cw0),
coef AS ({' UNION ALL '.join(f"SELECT '{c}' AS channel, {i} AS idx, mu{i} AS mu, sd{i} AS sd, w{i} AS w, bias FROM cw"
                             for i, c in _IDX)}),
sco0 AS (SELECT f.flight_id, bias {''.join(f' + w{i} * ({c} - mu{i}) / sd{i}' for i, c in _IDX)} AS logit FROM feat f, cw),
sco AS (SELECT flight_id, logit, 1.0 / (1.0 + exp(-logit)) AS probability FROM sco0),
scs AS (SELECT *, CAST(coalesce(probability >= 0.35, false) AS INTEGER) AS prediction,
               CASE WHEN probability >= 0.8 THEN 'CRITICAL' WHEN probability >= 0.6 THEN 'HIGH'
                    WHEN probability >= 0.4 THEN 'MEDIUM' ELSE 'NORMAL' END AS severity FROM sco),
scm AS (SELECT *, CASE severity {' '.join(f"WHEN '{s}' THEN '{m}'" for s, _, m in dims.SEVERITIES)} END AS message,
               CAST(0.35 AS DOUBLE) AS threshold FROM scs),
ga AS (SELECT flight_id, count(*) AS tt, {', '.join(f'avg(abs({c})) AS a{i}' for i, c in _IDX)} FROM zn GROUP BY flight_id),
ci AS ({' UNION ALL '.join(f"SELECT ga.flight_id, '{c}' AS channel, {i} AS idx, abs(probability * (1 - probability) * w{i} / (sd{i} * tt)) * a{i} AS raw FROM ga JOIN sco USING (flight_id), cw"
                           for i, c in _IDX)}),
cimp AS (SELECT flight_id, channel, idx, CASE WHEN max(raw) OVER (PARTITION BY flight_id) > 0
                THEN raw / max(raw) OVER (PARTITION BY flight_id) ELSE raw END AS importance FROM ci),
tc AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY importance DESC, idx DESC) AS rk FROM cimp),
top5 AS (SELECT flight_id, CAST(rk AS INTEGER) AS rank, channel, channel AS description,
                round(importance, 4) AS importance FROM tc WHERE rk <= 5)
"""

DET_CTE = """
det_sc AS (SELECT flight_id, sum(pct_flagged * weight) / sum(weight) AS s FROM pm GROUP BY flight_id),
det_fl AS (SELECT flight_id, list_sort(list(DISTINCT channel)) AS flagged FROM pm
           WHERE channel NOT IN ('qty', 'price') GROUP BY flight_id),
det AS (SELECT f.flight_id, round(least(coalesce(det_sc.s, 0.0), 1.0), 4) AS anomaly_score,
               coalesce(det_fl.flagged, []) AS flagged_sensors
        FROM (SELECT DISTINCT flight_id FROM s) f LEFT JOIN det_sc USING (flight_id) LEFT JOIN det_fl USING (flight_id))
"""


def _expl_cte() -> str:
    lvl = "CASE WHEN importance > 0.5 THEN 'strongly' WHEN importance > 0.2 THEN 'moderately' ELSE 'slightly' END"
    hits = ", ".join(f"max(CASE WHEN channel IN {_G[g]} THEN 1 ELSE 0 END) AS g_{g}" for g in dims.SENSOR_GROUPS)
    ins = ", ".join(f"CASE WHEN g_{g} = 1 THEN '{t}' END" for g, t in dims.GROUP_INSIGHTS)

    def prio(choices, fallback):
        return "CASE " + " ".join(f"WHEN g_{g} = 1 THEN '{t}'" for g, t in choices) + f" ELSE '{fallback}' END"

    summ = " ".join(f"WHEN '{s}' THEN '{t.replace('%s', '' + chr(39) + ' || pp || ' + chr(39)).replace('%%', '%')}'"
                    for s, t in dims.SUMMARY_TEMPLATES.items())
    return f"""
tg AS (SELECT flight_id, {hits},
              string_agg(CASE WHEN rank <= 3 THEN description || ' ' || {lvl} || ' influenced this prediction (importance: '
                              || printf('%.2f', importance) || ')' END, ' || ' ORDER BY rank) AS driving_factors
       FROM top5 GROUP BY flight_id),
ej AS (SELECT scm.flight_id, scm.probability, scm.severity, printf('%.1f', probability * 100.0) AS pp,
              {', '.join(f'tg.g_{g}' for g in dims.SENSOR_GROUPS)}, tg.driving_factors,
              det.anomaly_score, det.flagged_sensors
       FROM scm LEFT JOIN tg USING (flight_id) LEFT JOIN det USING (flight_id)),
expl AS (SELECT flight_id,
           coalesce(CASE severity {summ} END, '') AS summary,
           coalesce(driving_factors, '') AS driving_factors,
           array_to_string(list_filter([{ins},
               CASE WHEN coalesce(anomaly_score > 0.05, false) AND len(coalesce(flagged_sensors, [])) > 0
                    THEN 'Statistical anomalies detected in: ' || array_to_string(flagged_sensors[1:3], ', ') || '.' END],
               lambda x: x IS NOT NULL), ' || ') AS sensor_insights,
           CASE severity WHEN 'CRITICAL' THEN '{dims.CRITICAL_ACTION_PREFIX}' || {prio(dims.CRITICAL_PRIORITY, dims.CRITICAL_FALLBACK)}
                         WHEN 'HIGH' THEN '{dims.HIGH_ACTION_PREFIX}' || {prio(dims.HIGH_PRIORITY, dims.HIGH_FALLBACK)}
                         WHEN 'MEDIUM' THEN '{dims.MEDIUM_ACTION}' WHEN 'NORMAL' THEN '{dims.NORMAL_ACTION}' ELSE '' END
             AS recommended_action
         FROM ej)
"""


def _training_cte() -> str:
    """The rounds as a recursion over one row: row j holds the weights w after epoch j, and what the pass over the weights of
    epoch j - 1 found (loss, F1).  Lists: bias first."""
    s = tr.Settings()
    d = len(CH)
    logit = " + ".join(["w[1]", *(f"w[{i + 2}] * z{i}" for i in range(d))])
    pull = ", ".join(["sum(case when train then wt * (p - y) end) / n", *(
        f"sum(case when train then wt * (p - y) * z{i} end) / n" for i in range(d))])
    b1, b2 = s.betas
    rate = f"({s.least_rate!r} + ({s.rate!r} - {s.least_rate!r}) * (1 + cos(pi() * j / {s.epochs})) / 2)"
    carried = ", ".join(f"any_value({c}) as {c}" for c in ("w", "m", "v", "best_f1", "best_j", "best_w"))
    fits = "(j > 0 and f1_now > best_f1)"
    return f"""
trs AS (SELECT {', '.join(f"avg({c}) AS mu{i}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd{i}" for i, c in _IDX)},
               count(*) AS n, count(*) FILTER (WHERE label = 0) * 1.0 / count(*) FILTER (WHERE label = 1) AS pw FROM tf),
trx AS (SELECT split = 'train' AS train, CAST(label AS DOUBLE) AS y, CASE WHEN label = 1 THEN pw ELSE 1.0 END AS wt, n,
               {', '.join(f'({c} - mu{i}) / sd{i} AS z{i}' for i, c in _IDX)}
        FROM feat JOIN ssplit USING (flight_id), trs WHERE split IN ('train', 'val')),
steps AS (
  SELECT 0 AS j, list_transform(range({d + 1}), lambda i: 0.0::double) AS w, list_transform(range({d + 1}), lambda i: 0.0::double) AS m,
         list_transform(range({d + 1}), lambda i: 0.0::double) AS v, CAST(NULL AS DOUBLE) AS loss, CAST(NULL AS DOUBLE) AS f1,
         CAST(-1.0 AS DOUBLE) AS best_f1, 0 AS best_j, list_transform(range({d + 1}), lambda i: 0.0::double) AS best_w
  UNION ALL
  SELECT j + 1, list_transform(range(1, {d + 2}), lambda i: w[i] * (1 - {rate} * {s.weight_decay!r})
                  - {rate} * (m1[i] / (1 - power({b1}, j + 1))) / (sqrt(v1[i] / (1 - power({b2}, j + 1))) + {s.epsilon!r})),
         m1, v1, loss_now, f1_now, CASE WHEN {fits} THEN f1_now ELSE best_f1 END, CASE WHEN {fits} THEN j ELSE best_j END,
         CASE WHEN {fits} THEN w ELSE best_w END
  FROM (SELECT *, list_transform(range(1, {d + 2}), lambda i: {b1} * m[i] + (1 - {b1}) * g1[i]) AS m1,
               list_transform(range(1, {d + 2}), lambda i: {b2} * v[i] + (1 - {b2}) * g1[i] * g1[i]) AS v1
        FROM (SELECT *, list_transform(g, lambda x: x * least(1.0, {s.clip!r} / (sqrt(list_sum(list_transform(g, lambda q: q * q))) + 1e-6))) AS g1
              FROM (SELECT j, {carried}, [{pull.replace('/ n', '/ any_value(n)')}] AS g,
                           sum(CASE WHEN train THEN wt * (greatest(CASE WHEN y = 1 THEN -z ELSE z END, 0.0) + ln(1 + exp(-abs(z)))) END) / any_value(n) AS loss_now,
                           coalesce(2.0 * count(*) FILTER (WHERE NOT train AND p >= {s.threshold} AND y = 1)
                             / nullif(2 * count(*) FILTER (WHERE NOT train AND p >= {s.threshold} AND y = 1)
                                      + count(*) FILTER (WHERE NOT train AND p >= {s.threshold} AND y = 0)
                                      + count(*) FILTER (WHERE NOT train AND p < {s.threshold} AND y = 1), 0), 0.0) AS f1_now
                    FROM (SELECT *, 1.0 / (1.0 + exp(-z)) AS p FROM (SELECT steps.*, trx.*, {logit} AS z FROM steps, trx
                          WHERE j <= {s.epochs} AND (j <= 1 OR j - 1 - best_j < {s.patience}))) GROUP BY j)))),
trained AS (SELECT best_w AS w FROM steps ORDER BY j DESC LIMIT 1),
tsc AS (SELECT flight_id, w[1] {''.join(f' + w[{i + 2}] * (({c} - mu{i}) / sd{i})' for i, c in _IDX)} AS logit FROM feat, trs, trained),
tsp AS (SELECT flight_id, logit, 1.0 / (1.0 + exp(-logit)) AS probability FROM tsc),
tss AS (SELECT *, CAST(probability >= 0.35 AS INTEGER) AS prediction,
               CASE WHEN probability >= 0.8 THEN 'CRITICAL' WHEN probability >= 0.6 THEN 'HIGH'
                    WHEN probability >= 0.4 THEN 'MEDIUM' ELSE 'NORMAL' END AS severity FROM tsp),
tci AS ({' UNION ALL '.join(f"SELECT ga.flight_id, '{c}' AS channel, abs(probability * (1 - probability) * w[{i + 2}] / (sd{i} * tt)) * a{i} AS raw "
                            f"FROM ga JOIN tsp USING (flight_id), trs, trained" for i, c in _IDX)})
"""


_BASE = f"WITH {sp.CUTPAD_CTE}, {spl.SUPPLIER_SPLIT_CTE}, {MODEL_CTE}"
_FULL = f"WITH {sp.CUTPAD_CTE}, {spl.SUPPLIER_SPLIT_CTE}, {MODEL_CTE}, {ap.SENSOR_CTE}, {DET_CTE}, {_expl_cte()}"
_DETONLY = f"WITH {ap.SENSOR_CTE}"
_TRAINED = f"WITH RECURSIVE {sp.CUTPAD_CTE}, {spl.SUPPLIER_SPLIT_CTE}, {MODEL_CTE}, {_training_cte()}"


def _r6(cols):
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


_PA = f"""
pa AS (SELECT flight_id, phase, sum(n_flagged * weight) AS w FROM pm GROUP BY 1, 2),
pc AS (SELECT f.flight_id, p.phase, p.phase_ord, CAST(trunc(coalesce(pa.w, 0.0)) AS INTEGER) AS count
       FROM (SELECT DISTINCT flight_id FROM s) f CROSS JOIN {PHASE_VALUES_SQL} p
       LEFT JOIN pa ON pa.flight_id = f.flight_id AND pa.phase = p.phase),
wp AS (SELECT flight_id, CASE WHEN max(count) > 0 THEN arg_max(phase, count * 10 - phase_ord) ELSE 'N/A' END AS worst_phase
       FROM pc GROUP BY flight_id)
"""

_LOCAL = f"""
lzs AS (SELECT flight_id, {', '.join(f"avg({c}) AS lm_{c}, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1.0 ELSE stddev_pop({c}) END AS ls_{c}" for c in DISPLAY)}
        FROM zn GROUP BY flight_id),
lzf AS (SELECT zn.flight_id, zn.t, {', '.join(f"CAST(coalesce(abs(({c} - lm_{c}) / ls_{c}) > 2.5, false) AS INTEGER) AS f_{c}" for c in DISPLAY)}
        FROM zn JOIN lzs USING (flight_id)),
lzh AS (SELECT flight_id, {', '.join(f"avg(f_{c}) >= 0.03 AS h_{c}" for c in DISPLAY)} FROM lzf GROUP BY flight_id),
lzsc AS (SELECT lzf.flight_id, avg(CAST(greatest({', '.join(f"CASE WHEN h_{c} THEN f_{c} ELSE 0 END" for c in DISPLAY)}) AS DOUBLE)) AS local_score,
                max({' + '.join(f"CAST(h_{c} AS INTEGER)" for c in DISPLAY)}) AS n_sensors_flagged
         FROM lzf JOIN lzh USING (flight_id) GROUP BY lzf.flight_id)
"""

_FLEET = f"""
sel AS (SELECT flight_id, row_number() OVER (ORDER BY md5('42:' || CAST(flight_id AS VARCHAR)), flight_id) AS sel FROM scm),
fr AS (SELECT flight_id, row_number() OVER (ORDER BY probability DESC, flight_id) AS fleet_rank FROM scm),
lab AS (SELECT s_suppkey AS flight_id, CAST(s_acctbal < 2500 AS INTEGER) AS label FROM supplier),
fleet AS (
  SELECT fr.fleet_rank, 'N' || CAST(1000 + sel.sel - 1 AS VARCHAR) AS aircraft_id, scm.flight_id,
         CASE WHEN lab.label = 1 THEN 'At-Risk' WHEN lab.label = 0 THEN 'Safe' ELSE '—' END AS true_label,
         scm.severity, printf('%.1f', scm.probability * 100.0) || '%' AS maint_prob,
         printf('%.1f', coalesce(lzsc.local_score, 0.0) * 100.0) || '%' AS anomaly_score,
         CAST(coalesce(lzsc.n_sensors_flagged, 0) AS VARCHAR) || ' / {len(DISPLAY)}' AS sensors_flagged,
         coalesce(t1.channel, 'N/A') AS top_sensor, coalesce(wp.worst_phase, 'N/A') AS worst_phase,
         scm.message AS action, lab.label
  FROM scm JOIN sel USING (flight_id) JOIN fr USING (flight_id) LEFT JOIN lab USING (flight_id)
  LEFT JOIN lzsc USING (flight_id) LEFT JOIN (SELECT flight_id, channel FROM top5 WHERE rank = 1) t1 USING (flight_id)
  LEFT JOIN wp USING (flight_id))
"""

_FLEET_COLS = ("fleet_rank, aircraft_id, flight_id, true_label, severity, maint_prob, anomaly_score, "
               "sensors_flagged, top_sensor, worst_phase, action")


def _pooled_filters_sql() -> str:
    k, outs = len(sp.FILTER_WEIGHTS), []
    for d, name in zip(sp.FILTER_DILATIONS, FILTERED):
        terms = [f"{w} * value" if i == k - 1 else
                 f"{w} * lag(value, {(k - 1 - i) * d}, 0.0) OVER (PARTITION BY flight_id ORDER BY t)"
                 for i, w in enumerate(sp.FILTER_WEIGHTS)]
        outs.append(f"{' + '.join(terms)} AS {name}")
    pooled = ", ".join(f"round(avg(CASE WHEN {c} < 0 THEN 0.0 ELSE {c} END), 6) + 0.0 AS {c}" for c in FILTERED)
    return (f"WITH {sp.EVENTS_CTE}, y AS (SELECT flight_id, value, {', '.join(outs)} FROM e) "
            f"SELECT flight_id, count(*) AS n_steps, round(avg(value), 6) + 0.0 AS value, {pooled} FROM y GROUP BY flight_id")


ORACLE = {
    "i_pooled_filters": _pooled_filters_sql(),
    "i_training_epochs": f"""{_TRAINED} SELECT a.j AS epoch, round({tr.Settings().least_rate!r} + ({tr.Settings().rate!r} - {tr.Settings().least_rate!r})
             * (1 + cos(pi() * (a.j - 1) / {tr.Settings().epochs})) / 2, 6) AS rate, round(a.loss, 6) AS train_loss, round(b.f1, 6) AS val_f1,
             b.best_j = a.j AS best FROM steps a JOIN steps b ON b.j = a.j + 1 WHERE a.j >= 1""",
    "i_trained_score": f"""{_TRAINED} SELECT flight_id, round(logit, 6) AS logit, round(probability, 6) AS probability, prediction, severity,
             CASE severity {' '.join(f"WHEN '{s}' THEN '{m}'" for s, _, m in dims.SEVERITIES)} END AS message FROM tss""",
    "i_trained_attribution": f"""{_TRAINED} SELECT flight_id, channel, round(CASE WHEN max(raw) OVER (PARTITION BY flight_id) > 0
             THEN raw / max(raw) OVER (PARTITION BY flight_id) ELSE raw END, 6) AS importance FROM tci""",
    "i_pooled_features": f"{_BASE} SELECT flight_id, n_steps, {_r6(CH)} FROM feat",
    "i_scorer_coefficients": f"{_BASE} SELECT channel, idx, {_r6(['mu', 'sd', 'w', 'bias'])} FROM coef",
    "i_linear_score": f"{_BASE} SELECT flight_id, {_r6(['logit', 'probability'])}, prediction, severity, message, threshold FROM scm",
    "i_channel_importance": f"{_BASE} SELECT flight_id, channel, {_r6(['importance'])} FROM cimp",
    "i_temporal_importance": f"""{_BASE},
        ti AS (SELECT zn.flight_id, zn.t, ({' + '.join(f'abs(probability * (1 - probability) * w{i} / (sd{i} * tt) * {c})' for i, c in _IDX)}) / {float(_N)} AS raw
               FROM zn JOIN ga USING (flight_id) JOIN sco USING (flight_id), cw),
        tmx AS (SELECT flight_id, max(raw) AS mx FROM ti GROUP BY flight_id)
        SELECT flight_id, t, round(CASE WHEN mx > 0 THEN raw / mx ELSE raw END, 6) + 0.0 AS importance
        FROM ti JOIN tmx USING (flight_id)""",
    "f_top_channels": f"{_BASE} SELECT flight_id, rank, channel, description, round(importance, 6) AS importance FROM top5",
    "i_plain_explanation": f"{_FULL} SELECT * FROM expl",
    "i_flight_analysis": f"""{_FULL}
        SELECT scm.flight_id, round(scm.probability, 6) AS probability, scm.prediction, scm.severity,
               round(det.anomaly_score, 6) AS anomaly_score, CAST(len(det.flagged_sensors) AS INTEGER) AS n_flagged_sensors,
               expl.summary, expl.recommended_action
        FROM scm LEFT JOIN det USING (flight_id) LEFT JOIN expl USING (flight_id)""",
    "d_worst_phase": f"{_DETONLY}, {_PA} SELECT flight_id, worst_phase FROM wp",
    "d_phase_share": f"""{_DETONLY}, {_PA}
        SELECT flight_id, phase, count, round(count * 100.0 / greatest(sum(count) OVER (PARTITION BY flight_id), 1), 6)
               AS share_pct FROM pc""",
    "d_separation_ratio": f"""{_DETONLY}, {DET_CTE},
        j AS (SELECT det.anomaly_score, CAST(s_acctbal < 2500 AS INTEGER) AS label FROM det JOIN supplier ON s_suppkey = det.flight_id)
        SELECT round(avg(CASE WHEN label = 0 THEN anomaly_score END), 6) AS mean_healthy,
               round(avg(CASE WHEN label = 1 THEN anomaly_score END), 6) AS mean_at_risk,
               round(avg(CASE WHEN label = 1 THEN anomaly_score END) / nullif(avg(CASE WHEN label = 0 THEN anomaly_score END), 0), 6)
               AS ratio FROM j""",
    "d_severity_counts": f"""{_BASE},
        sv AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {i})" for i, (s, _, _) in enumerate(dims.SEVERITIES))}) AS v(severity, severity_ord)),
        tot AS (SELECT count(*) AS t, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS needs_attention FROM scm),
        g AS (SELECT severity, count(*) AS n FROM scm GROUP BY severity)
        SELECT sv.severity, sv.severity_ord, CAST(coalesce(g.n, 0) AS BIGINT) AS n_flights,
               round(coalesce(coalesce(g.n, 0) * 100.0 / nullif(tot.t, 0), 0.0), 6) AS pct_fleet,
               CAST(tot.needs_attention AS BIGINT) AS needs_attention
        FROM sv CROSS JOIN tot LEFT JOIN g USING (severity)""",
    "f_fleet_ranking": f"""{_BASE}, {_FLEET.split('lab AS')[0].rstrip().rstrip(',')}
        SELECT flight_id, CAST(fleet_rank AS BIGINT) AS fleet_rank, 'N' || CAST(1000 + sel - 1 AS VARCHAR) AS aircraft_id
        FROM fr JOIN sel USING (flight_id)""",
    "b_priority_flights": f"""{_BASE} SELECT flight_id, round(probability, 6) AS probability, severity FROM scm
        WHERE severity IN ('CRITICAL', 'HIGH')""",
    "i_fleet_status": f"{_FULL}, {_PA}, {_LOCAL}, {_FLEET} SELECT {_FLEET_COLS} FROM fleet",
}

_TEST_SC = """
sc AS (SELECT scm.flight_id, ssplit.label, scm.logit, scm.probability AS prob
       FROM scm JOIN ssplit USING (flight_id) WHERE ssplit.split = 'test'),"""


def _eval_sql():
    from . import eval_plans as ep
    return ep


_EP = _eval_sql()
_MCOLS = ("n, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, "
          "round(recall, 6) AS recall, round(f1, 6) AS f1, round(auc, 6) AS auc, "
          "round(pos_weight, 6) AS pos_weight, round(loss, 6) AS loss")
ORACLE["i_model_evaluation"] = f"""{_BASE}, {_TEST_SC} {_EP.METRICS_CTE}
    SELECT {_MCOLS}, CAST({mt.CURRENT_F1} AS DOUBLE) AS full_test_f1, CAST({mt.CURRENT_AUC} AS DOUBLE) AS full_test_auc,
           CAST({mt.CURRENT_RECALL} AS DOUBLE) AS full_test_recall FROM mx"""
ORACLE["i_retraining_run"] = f"""{_EP._NORM}, {MODEL_CTE}, {_TEST_SC} {_EP.METRICS_CTE}, {_EP.PROMO_CTE}
    SELECT round(round(avg_psi, 4), 6) AS drift_avg_psi, avg_psi > 0.2 AS drift_detected,
           promote AS promotion_decision, reason AS promotion_reason,
           round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(f1, 6) AS f1, round(auc, 6) AS auc, round(loss, 6) AS loss,
           (SELECT count(*) FROM ssplit WHERE split = 'train') AS train_flights,
           (SELECT count(*) FROM ssplit WHERE split = 'test') AS test_flights,
           coalesce(round(avg_psi, 4) > 0.2, false) OR coalesce(({mt.CURRENT_F1} - f1) / {mt.CURRENT_F1} > 0.05, false)
             AS retrain,
           'evaluate_only' AS pipeline_type
    FROM rep, mx, promo"""

ORACLE["a_alert_fields"] = f"""WITH fa AS ({ORACLE['i_flight_analysis']}),
    tl AS ({ap.ORACLE['d_anomaly_timeline']}), tc AS ({ORACLE['f_top_channels']})
    SELECT fa.flight_id, severity, anomaly_score, CAST(n_flagged_sensors AS INTEGER) AS n_flagged_sensors, n_steps, n_flagged_steps,
           first_flagged_step, tc.channel AS top_channel, tc.importance AS top_importance
    FROM fa JOIN (SELECT flight_id, CAST(count(*) AS INTEGER) AS n_steps, CAST(sum(flag) AS INTEGER) AS n_flagged_steps,
                         CAST(coalesce(min(CASE WHEN flag = 1 THEN t END), -1) AS INTEGER) AS first_flagged_step
                  FROM tl GROUP BY flight_id) USING (flight_id)
    JOIN tc USING (flight_id) WHERE tc.rank = 1"""

_FLEET_SUB = (_FLEET.replace("FROM scm),", "FROM scm_sub),").replace("FROM scm JOIN sel", "FROM scm_sub scm JOIN sel"))
ORACLE["b_fleet_label_subset"] = f"""{_FULL}, {_PA}, {_LOCAL},
    scm_sub AS (SELECT * FROM scm WHERE flight_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2500)),
    {_FLEET_SUB} SELECT {_FLEET_COLS} FROM fleet"""
