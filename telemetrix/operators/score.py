"""Flight scoring (I1-I3) and gradient x input attribution.

The network itself is not reproduced (no weights ship with the
reference).  Scoring keeps its interface and outputs: probability,
decision, severity, attribution.  Two scorers are provided:

* a linear scorer fitted in plain SQL (``fit_centroid_scorer``): channels
  are pooled over time per flight (global average pooling), standardised
  on train flights, and weighted by the difference of the class centroids;
  coefficients are one row per channel (fixed size, broadcast);
* an MLlib ``LogisticRegression`` with class weights on the same pooled
  features (``fit_logistic_scorer``), for a fitted model.

For a linear score on pooled means, the gradient of the probability with
respect to the input at (channel c, step t) is p(1-p) w_c / (sd_c T), so
gradient x input attribution needs no autodiff.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import is_true, severity, severity_message, sigmoid
from ..functions.joins import skew_join


def pooled_features(rows: DataFrame, channels: Sequence[str], key: str = "flight_id",
                    rectify: Sequence[str] = ()) -> DataFrame:
    """Per flight, the mean over time of every channel (rectified channels use max(x, 0), and NULL stays NULL)."""
    aggs = []
    for c in channels:
        x = F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) if c in rectify else F.col(c)
        aggs.append(F.avg(x).alias(c))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_steps"), *aggs)


def fit_centroid_scorer(features: DataFrame, labels: DataFrame, channels: Sequence[str],
                        key: str = "flight_id", label: str = "label") -> DataFrame:
    """Coefficient table (channel, idx, mu, sd, w, bias) from train flights.

    z = (x - mu) / sd on train flights; w = mean z of positives - mean z of
    negatives; bias = -sum_c w_c (zbar1_c + zbar0_c) / 2.
    """
    chans = list(channels)
    f = features.join(labels.select(key, label), key)
    st = f.agg(*[F.avg(c).alias(f"_mu{i}") for i, c in enumerate(chans)],
               *[F.stddev_pop(c).alias(f"_sd{i}") for i, c in enumerate(chans)],
               *[F.avg(F.when(F.col(label) == 1, F.col(c))).alias(f"_p{i}") for i, c in enumerate(chans)],
               *[F.avg(F.when(F.col(label) == 0, F.col(c))).alias(f"_q{i}") for i, c in enumerate(chans)])
    items = []
    for i, c in enumerate(chans):
        sd = F.when(F.coalesce(F.col(f"_sd{i}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"_sd{i}"))
        zp = (F.col(f"_p{i}") - F.col(f"_mu{i}")) / sd
        zq = (F.col(f"_q{i}") - F.col(f"_mu{i}")) / sd
        w = F.coalesce(zp - zq, F.lit(0.0))
        mid = F.coalesce((zp + zq) / 2.0, F.lit(0.0))
        items.append(F.struct(F.lit(c).alias("channel"), F.lit(i).alias("idx"), F.col(f"_mu{i}").alias("mu"),
                              sd.alias("sd"), w.alias("w"), (-w * mid).alias("b")))
    coef = st.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")
    return coef.withColumn("bias", F.sum("b").over(Window.partitionBy())).drop("b")


def _wide_coef(coef: DataFrame, channels: Sequence[str]) -> DataFrame:
    aggs = [F.max("bias").alias("_bias")]
    for i, c in enumerate(channels):
        hit = F.col("channel") == c
        aggs += [F.max(F.when(hit, F.col("mu"))).alias(f"_mu{i}"), F.max(F.when(hit, F.col("sd"))).alias(f"_sd{i}"),
                 F.max(F.when(hit, F.col("w"))).alias(f"_w{i}")]
    return coef.agg(*aggs)


def _with_coef(df: DataFrame, coef: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Adds _bias, _mu<i>, _sd<i>, _w<i> from the coefficients as one broadcast row; NULL for a missing channel."""
    wide = _wide_coef(coef, channels)
    return df.withColumn("_j", F.lit(1)).join(F.broadcast(wide.withColumn("_j", F.lit(1))), "_j").drop("_j")


def score_flights(features: DataFrame, coef: DataFrame, channels: Sequence[str], key: str = "flight_id",
                  threshold: float = dims.DECISION_THRESHOLD) -> DataFrame:
    """Logit, probability, B21 decision (probability >= threshold), B20 severity, B22 message."""
    chans = list(channels)
    j = _with_coef(features, coef, chans)
    logit = F.col("_bias")
    for i, c in enumerate(chans):
        logit = logit + F.col(f"_w{i}") * (F.col(c) - F.col(f"_mu{i}")) / F.col(f"_sd{i}")
    out = j.select(key, logit.alias("logit")).withColumn("probability", sigmoid("logit"))
    return (out.withColumn("prediction", is_true(F.col("probability") >= F.lit(float(threshold))).cast("int"))
            .withColumn("severity", severity("probability"))
            .withColumn("message", severity_message("severity"))
            .withColumn("threshold", F.lit(float(threshold))))


def channel_importance(rows: DataFrame, scores: DataFrame, coef: DataFrame, channels: Sequence[str],
                       key: str = "flight_id") -> DataFrame:
    """I4 + D30 + E8: per (flight, channel) mean over t of |grad * x|, scaled by the flight maximum."""
    chans = list(channels)
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_T"), *[F.avg(F.abs(F.col(c))).alias(f"_a{i}")
                                                                for i, c in enumerate(chans)])
    j = _with_coef(g.join(scores.select(key, "probability"), key), coef, chans)
    p = F.col("probability")
    items = [F.struct(F.lit(c).alias("channel"), F.lit(i).alias("idx"),
                      (F.abs(p * (1 - p) * F.col(f"_w{i}") / (F.col(f"_sd{i}") * F.col("_T"))) * F.col(f"_a{i}"))
                      .alias("raw"))
             for i, c in enumerate(chans)]
    long = j.select(key, F.explode(F.array(*items)).alias("_x")).select(key, "_x.channel", "_x.idx", "_x.raw")
    mx = F.max("raw").over(Window.partitionBy(key))  # one row per channel and flight
    return long.withColumn("importance", F.when(mx > 0, F.col("raw") / mx).otherwise(F.col("raw"))).drop("raw")


def temporal_importance(rows: DataFrame, scores: DataFrame, coef: DataFrame, channels: Sequence[str],
                        key: str = "flight_id", t: str = "t") -> DataFrame:
    """I4 + D30 + E8: per (flight, t) mean over channels of |grad * x|, scaled by the flight maximum."""
    chans = list(channels)
    per_flight = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_T")).join(scores.select(key, "probability"), key)
    j = _with_coef(skew_join(rows, per_flight, [key], "_T"), coef, chans)
    p = F.col("probability")
    terms = [F.abs(p * (1 - p) * F.col(f"_w{i}") / (F.col(f"_sd{i}") * F.col("_T")) * F.col(c))
             for i, c in enumerate(chans)]
    raw = sum(terms[1:], terms[0]) / F.lit(float(len(chans)))
    v = j.select(key, t, raw.alias("raw"))
    mx = v.groupBy(key).agg(F.max("raw").alias("_mx"), F.count(F.lit(1)).alias("_n"))
    return skew_join(v, mx, [key], "_n").select(key, t, F.when(F.col("_mx") > 0, F.col("raw") / F.col("_mx"))
                                  .otherwise(F.col("raw")).alias("importance"))


def top_channels(importance: DataFrame, chanset: dims.ChannelSet, key: str = "flight_id", k: int = 5) -> DataFrame:
    """F2 + C5: top k channels by importance (ties: higher index first), with description fallback."""
    w = Window.partitionBy(key).orderBy(F.col("importance").desc(), F.col("idx").desc())
    desc = F.create_map(*[x for c in chanset.channels for x in (F.lit(c.name), F.lit(c.description or c.name))])
    return (importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(key, F.col("rank").cast("int").alias("rank"), "channel",
                    F.coalesce(F.element_at(desc, F.col("channel")), F.col("channel")).alias("description"),
                    F.round("importance", 4).alias("importance")))


def fit_logistic_scorer(features: DataFrame, labels: DataFrame, channels: Sequence[str], key: str = "flight_id",
                        label: str = "label"):
    """Class-weighted logistic regression on pooled features (MLlib); returns a fitted PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    f = features.join(labels.select(key, label), key)
    cw = f.agg(F.try_divide(F.count(F.when(F.col(label) == 0, 1)).cast("double"),
                            F.count(F.when(F.col(label) == 1, 1)).cast("double")).alias("_pw"))
    f = (f.withColumn("_j", F.lit(1)).join(F.broadcast(cw.withColumn("_j", F.lit(1))), "_j")
         .withColumn("_wt", F.when(F.col(label) == 1, F.coalesce("_pw", F.lit(1.0))).otherwise(F.lit(1.0)))
         .withColumn("_y", F.col(label).cast("double")))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(channels), outputCol="_raw", handleInvalid="keep"),
                            StandardScaler(inputCol="_raw", outputCol="_feat", withMean=True, withStd=True),
                            LogisticRegression(featuresCol="_feat", labelCol="_y", weightCol="_wt", maxIter=50)])
    return pipe.fit(f)


def apply_logistic_scorer(model, features: DataFrame, key: str = "flight_id",
                          threshold: float = dims.DECISION_THRESHOLD) -> DataFrame:
    """I1(b): probability, decision, severity from the fitted model."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(features).select(key, vector_to_array("probability").getItem(1).alias("probability"))
    return (out.withColumn("prediction", is_true(F.col("probability") >= F.lit(float(threshold))).cast("int"))
            .withColumn("severity", severity("probability"))
            .withColumn("message", severity_message("severity")))
