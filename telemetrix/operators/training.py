"""Classifier training with early stopping on the validation F1 (I3), and scoring with the result.

A linear scorer on pooled flight features is trained by full-batch AdamW rounds: positives weigh n_neg / n_pos, gradients are
clipped by norm, the rate follows a cosine, weights decay apart from the gradient.  Each round is one distributed
aggregate over the flights: train rows add up the weighted gradient and loss (combined per task before one row meets the
driver), validation rows of the same pass the confusion counts of the weights at hand.  The driver holds the d + 1 weights
and their moments only.  Training stops when the validation F1 has not risen for ``patience`` epochs, and the weights of the
best epoch are kept.

Features are standardised by the train split (missing ones count as the mean) and written once, one row a flight, so a
round reads a table and a lost executor loses no state; the table is deleted at the end.  Rounds differ in the weights only, which
travel as one array literal, so all rounds share one compiled plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import is_true, severity, severity_message, sigmoid, softplus
from ..session import materialize, release


@dataclass(frozen=True)
class Settings:
    """Training parameters: epochs, patience, decay, clipping and threshold as the reference sets them; the rate suits full
    batches of a linear model."""

    epochs: int = 30
    patience: int = 7
    rate: float = 0.05
    least_rate: float = 1e-6
    weight_decay: float = 1e-4
    clip: float = 1.0
    threshold: float = dims.DECISION_THRESHOLD
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8

    def rate_of(self, epoch: int) -> float:
        """Cosine from ``rate`` (epoch 1) towards ``least_rate``."""
        return self.least_rate + (self.rate - self.least_rate) * (1 + math.cos(math.pi * (epoch - 1) / self.epochs)) / 2


@dataclass
class Trained:
    """The kept weights (bias first) on standardised channels, and what each epoch reached."""

    channels: list[str]
    mean: list[float]
    std: list[float]
    weights: list[float]
    best_epoch: int
    epochs: list[dict] = field(default_factory=list)


def standardised(channels: Sequence[str], mean: Sequence[float], std: Sequence[float]) -> Column:
    return F.array(*[F.coalesce((F.col(c) - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0))
                     for c, m, s in zip(channels, mean, std)])


def linear(x: Column, weights: Sequence[float]) -> Column:
    """bias + weights . x, with the weights as one literal."""
    w = F.lit([float(v) for v in weights])
    terms = F.zip_with(x, F.slice(w, 2, len(weights) - 1), lambda a, b: a * b)
    return F.aggregate(terms, F.get(w, F.lit(0)), lambda s, v: s + v)


def _round(table: DataFrame, weights: Sequence[float], threshold: float) -> dict:
    """Gradient and loss of the train rows and confusion counts of the validation rows, in one aggregate."""
    rows = table.withColumn("_z", linear(F.col("x"), weights)).withColumn("_p", sigmoid("_z"))
    train, y = F.col("train"), F.col("y")
    pull = F.when(train, F.col("weight") * (F.col("_p") - y))
    hit, pos = F.col("_p") >= F.lit(threshold), y == 1
    loss = F.col("weight") * F.when(pos, softplus(-F.col("_z"))).otherwise(softplus(F.col("_z")))
    return rows.agg(
        F.count(F.when(train, 1)).alias("n"), F.sum(F.when(train, loss)).alias("loss"),
        F.array(F.sum(pull), *[F.sum(pull * F.get("x", F.lit(i))) for i in range(len(weights) - 1)]).alias("pull"),
        F.count(F.when(~train & hit & pos, 1)).alias("tp"), F.count(F.when(~train & hit & ~pos, 1)).alias("fp"),
        F.count(F.when(~train & ~hit & pos, 1)).alias("fn")).first().asDict()


def fit(features: DataFrame, flights: DataFrame, channels: Sequence[str], key: str = "flight_id", label: str = "label",
        split: str = "split", settings: Settings = Settings()) -> Trained:
    """Train on the flights of split 'train', stop by those of split 'val'.

    ``features``: one row per flight; ``flights``: key, label (0 / 1; others and missing take no part) and split.  Without
    train rows the weights stay zero.
    """
    chans, s = list(channels), settings
    rows = (features.join(flights.select(key, F.col(label).alias("_y"), F.col(split).alias("_split")), key)
            .where(F.col("_y").isin(0, 1) & F.col("_split").isin("train", "val")))
    train = F.col("_split") == "train"
    st = rows.where(train).agg(
        F.count(F.when(F.col("_y") == 0, 1)).alias("n0"), F.count(F.when(F.col("_y") == 1, 1)).alias("n1"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(chans)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(chans)]).first()
    mean = [st[f"m{i}"] or 0.0 for i in range(len(chans))]
    std = [st[f"s{i}"] or 1.0 for i in range(len(chans))]
    pos_weight = st["n0"] / st["n1"] if st["n1"] else 1.0
    table = materialize(rows.select(
        train.alias("train"), F.col("_y").cast("double").alias("y"),
        F.when(F.col("_y") == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)).alias("weight"),
        standardised(chans, mean, std).alias("x")), "training")
    w = [0.0] * (len(chans) + 1)
    first, second = w[:], w[:]
    out, best_f1 = Trained(chans, mean, std, w[:], 0), -1.0
    last = None
    for epoch in range(s.epochs + 1):  # pass number ``epoch`` sees the weights that epoch left
        found = _round(table, w, s.threshold)
        if epoch:
            f1 = 2 * found["tp"] / max(2 * found["tp"] + found["fp"] + found["fn"], 1)
            out.epochs.append({"epoch": epoch, "rate": s.rate_of(epoch), "train_loss": last["loss"] / last["n"], "val_f1": f1,
                               "best": f1 > best_f1})
            if f1 > best_f1:
                best_f1, out.best_epoch, out.weights = f1, epoch, w[:]
            if epoch - out.best_epoch >= s.patience:
                break
        if not found["n"] or epoch == s.epochs:
            break
        last = found
        g = [v / found["n"] for v in found["pull"]]
        shrink = min(1.0, s.clip / (math.sqrt(sum(v * v for v in g)) + 1e-6))
        rate, (b1, b2) = s.rate_of(epoch + 1), s.betas
        for i, v in enumerate(g):
            first[i] = b1 * first[i] + (1 - b1) * v * shrink
            second[i] = b2 * second[i] + (1 - b2) * (v * shrink) ** 2
            step = (first[i] / (1 - b1 ** (epoch + 1))) / (math.sqrt(second[i] / (1 - b2 ** (epoch + 1))) + s.epsilon)
            w[i] = w[i] * (1 - rate * s.weight_decay) - rate * step
    release(table)
    return out


def epoch_table(spark, model: Trained) -> DataFrame:
    """epoch, rate, train_loss, val_f1, best of each epoch that ran."""
    return spark.createDataFrame([tuple(e.values()) for e in model.epochs],
                                 "epoch int, rate double, train_loss double, val_f1 double, best boolean")


def coefficients(spark, model: Trained) -> DataFrame:
    """channel, idx, mu, sd, w, bias: the table that the linear scorer, its attribution and its reports read."""
    return spark.createDataFrame(
        [(c, i, m, s, w, model.weights[0]) for i, (c, m, s, w) in enumerate(zip(model.channels, model.mean, model.std, model.weights[1:]))],
        "channel string, idx int, mu double, sd double, w double, bias double")


def score(features: DataFrame, model: Trained, key: str = "flight_id", threshold: float = dims.DECISION_THRESHOLD) -> DataFrame:
    """I1(b): logit, probability, decision, severity and message of each flight."""
    z = linear(standardised(model.channels, model.mean, model.std), model.weights)
    out = features.select(key, z.alias("logit")).withColumn("probability", sigmoid("logit"))
    return (out.withColumn("prediction", is_true(F.col("probability") >= F.lit(float(threshold))).cast("int"))
            .withColumn("severity", severity("probability"))
            .withColumn("message", severity_message("severity")))
