"""Evaluation metrics and the promotion rule.

Confusion counts, log-loss and class weight are one global aggregate.
ROC-AUC is the rank-sum statistic computed from distinct scores: group by
score (positives / negatives per value), a running sum of negatives over
the score order (chunked between quantiles of the distinct scores, so no
single-task global window over all rows), then one more aggregate.  Ties count one half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import is_true, softplus
from . import chunked

# Current production figures the promotion rule compares against (fixed values).
CURRENT_F1 = 0.5211
CURRENT_AUC = 0.6973
CURRENT_RECALL = 0.871


def roc_auc(scored: DataFrame, prob: str = "prob", label: str = "label", chunks: int = 256) -> DataFrame:
    """One row ``auc``; 0.5 when only one class is present.  A missing score ranks lowest.

    Scores may have any range and crowd anywhere in it: the running sum is cut between quantiles of the distinct scores.
    """
    y = F.col(label) == 1
    per = scored.groupBy(F.coalesce(F.col(prob).cast("double"), F.lit(float("-inf"))).alias("_p")).agg(
        F.count(F.when(y, 1)).alias("_pos"), F.count(F.when(~y, 1)).alias("_neg"))
    steps = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    cuts = per.agg(F.array_distinct(F.percentile_approx("_p", steps, 10 * chunks)).alias("_cuts"))  # one row
    met = per.withColumn("_k", F.lit(0)).join(F.broadcast(cuts.withColumn("_k", F.lit(0))), "_k")
    chunk = F.size(F.filter("_cuts", lambda x: x < F.col("_p"))).cast("long")
    cum = chunked.running_sum(met, "_k", ["_p"], chunk, "_neg", "_cneg")
    g = cum.agg(F.sum(F.col("_pos") * (F.col("_cneg") - F.col("_neg") + 0.5 * F.col("_neg"))).alias("_u"),
                F.sum("_pos").alias("_n1"), F.sum("_neg").alias("_n0"))
    return g.select(F.when((F.col("_n1") > 0) & (F.col("_n0") > 0),
                           F.col("_u") / (F.col("_n1") * F.col("_n0"))).otherwise(F.lit(0.5)).alias("auc"))


def evaluate(scored: DataFrame, threshold: float = dims.DECISION_THRESHOLD, prob: str = "prob",
             label: str = "label", logit: str = "logit") -> DataFrame:
    """I8: one-row metrics table (counts, rates, auc, class weight, loss weighted by it).

    Counts, class weight and loss come from one aggregate: the weighted
    log-loss mean is (pw * sum(y * softplus(-x)) + sum((1 - y) * softplus(x))) / n,
    so the class weight pw can be applied after the sums.  AUC is the only
    second pass (it groups by score).  A missing probability counts as the lowest: not flagged, ranked last.
    Rows without a logit or label have no loss and do not count in its mean.
    """
    pred = is_true(F.col(prob) >= F.lit(float(threshold)))
    pos = F.col(label) == 1
    y = F.col(label).cast("double")
    x = F.col(logit)
    g = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(pred & pos, 1)).alias("tp"), F.count(F.when(pred & ~pos, 1)).alias("fp"),
        F.count(F.when(~pred & pos, 1)).alias("fn"), F.count(F.when(~pred & ~pos, 1)).alias("tn"),
        F.count(F.when(F.col(label) == 0, 1)).alias("_n0"), F.count(F.when(F.col(label) == 1, 1)).alias("_n1"),
        F.sum(y * softplus(-x)).alias("_lp"), F.sum((F.lit(1.0) - y) * softplus(x)).alias("_ln"),
        F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("_nl"))
    z = F.lit(0.0)
    pw = F.try_divide(F.col("_n0").cast("double"), F.col("_n1").cast("double"))
    m = g.select(
        "n", "tp", "fp", "fn", "tn",
        F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("n")), z).alias("accuracy"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), z).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), z).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), z).alias("f1"),
        pw.alias("pos_weight"),
        F.try_divide(F.coalesce(pw, F.lit(1.0)) * F.col("_lp") + F.col("_ln"), F.col("_nl").cast("double"))
        .alias("loss"))
    auc = roc_auc(scored, prob, label)
    one = F.lit(1)
    return (m.withColumn("_j", one).join(auc.withColumn("_j", one), "_j").drop("_j")
            .select("n", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "auc", "pos_weight",
                    "loss"))


def _f4(c):
    """'%.4f' text; a missing value prints as 'nan', as the reference's formatting of NaN does."""
    from ..functions.fmt import fixed
    return F.coalesce(fixed(c, 4), F.lit("nan"))


def promotion_decision(new: DataFrame, current_f1: float = CURRENT_F1, current_recall: float = CURRENT_RECALL,
                       current_auc: float = CURRENT_AUC) -> DataFrame:
    """I9 (+C8): promote when F1 > cur+0.01, recall >= cur-0.02 and AUC >= cur-0.005; missing = not ok."""
    cf1, crec, cauc = F.lit(float(current_f1)), F.lit(float(current_recall)), F.lit(float(current_auc))
    f1, rec, auc = F.col("f1"), F.col("recall"), F.col("auc")
    f1_better = is_true(f1 > cf1 + F.lit(0.01))
    recall_ok = is_true(rec >= crec - F.lit(0.02))
    auc_ok = is_true(auc >= cauc - F.lit(0.005))
    promote = f1_better & recall_ok & auc_ok
    ok_text = F.concat(F.lit("F1: "), _f4(cf1), F.lit("→"), _f4(f1), F.lit(" | Recall: "), _f4(rec),
                       F.lit(" | AUC: "), _f4(auc))
    reasons = F.concat_ws(
        " | ",
        F.when(~f1_better, F.concat(F.lit("F1 not improved ("), _f4(cf1), F.lit("→"), _f4(f1), F.lit(")"))),
        F.when(~recall_ok, F.concat(F.lit("Recall degraded ("), _f4(crec), F.lit("→"), _f4(rec), F.lit(")"))),
        F.when(~auc_ok, F.concat(F.lit("AUC degraded ("), _f4(cauc), F.lit("→"), _f4(auc), F.lit(")"))))
    return new.select(promote.alias("promote"), F.when(promote, ok_text).otherwise(reasons).alias("reason"),
                      f1_better.alias("f1_better"), recall_ok.alias("recall_ok"), auc_ok.alias("auc_ok"))


def retrain_trigger(avg_psi, f1, psi_threshold: float = dims.DRIFT_THRESHOLD, reference_f1: float = CURRENT_F1,
                    max_relative_drop: float = 0.05) -> F.Column:
    """Retrain when the average PSI exceeds the threshold or F1 fell more than 5 % below the reference."""
    drop = (F.lit(float(reference_f1)) - F.col(f1)) / F.lit(float(reference_f1))
    return is_true(F.col(avg_psi) > F.lit(float(psi_threshold))) | is_true(drop > F.lit(float(max_relative_drop)))


def evaluate_with_current(scored: DataFrame, threshold: float = dims.DECISION_THRESHOLD,
                          sample_n: int | None = None, seed: int = 42, key: str = "flight_id") -> DataFrame:
    """I8: metrics of the scored flights (optionally a seeded sample of n flights, F4) with the
    current production figures alongside."""
    if sample_n is not None:
        from .split_norm import seeded_sample
        scored = scored.join(seeded_sample(scored, key, sample_n, seed), key, "left_semi")
    m = evaluate(scored, threshold)
    return (m.withColumn("full_test_f1", F.lit(CURRENT_F1)).withColumn("full_test_auc", F.lit(CURRENT_AUC))
            .withColumn("full_test_recall", F.lit(CURRENT_RECALL)))


def retraining_run(drift: DataFrame, metrics: DataFrame, n_train: DataFrame, n_test: DataFrame) -> DataFrame:
    """Drift -> evaluate -> decide, as one row of run parameters and metrics (no training step).

    ``drift``: one-row drift report; ``metrics``: one-row evaluation; ``n_train`` / ``n_test``:
    one-row flight counts (column ``n``).
    """
    dec = promotion_decision(metrics)
    one = F.lit(1)
    j = (drift.select(F.round("avg_psi", 4).alias("drift_avg_psi"), F.col("drift_flag").alias("drift_detected"))
         .withColumn("_j", one)
         .join(dec.select(F.col("promote").alias("promotion_decision"), F.col("reason").alias("promotion_reason"))
               .withColumn("_j", one), "_j")
         .join(metrics.select("accuracy", "precision", "recall", "f1", "auc", "loss").withColumn("_j", one), "_j")
         .join(n_train.select(F.col("n").alias("train_flights")).withColumn("_j", one), "_j")
         .join(n_test.select(F.col("n").alias("test_flights")).withColumn("_j", one), "_j").drop("_j"))
    return j.withColumn("retrain", retrain_trigger("drift_avg_psi", "f1")) \
            .withColumn("pipeline_type", F.lit("evaluate_only"))
