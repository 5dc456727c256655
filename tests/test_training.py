"""Early-stopped training against the same rounds in numpy, and exact split totals."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetrix.operators import score as sc
from telemetrix.operators import split_norm as sn
from telemetrix.operators import training as tr

CH = ["a", "b", "c"]


def data(spark, n=400, seed=1, signal=1.0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 3)) * [1, 10, 0.1] + [5, -3, 0]
    y = (signal * (x[:, 0] - 5) + 0.3 * (x[:, 1] + 3) / 10 + rnd.normal(size=n) > 0.8).astype(int)
    split = np.where(np.arange(n) % 10 < 7, "train", np.where(np.arange(n) % 10 < 9, "val", "test"))
    feats = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "flight_id long, a double, b double, c double")
    flights = spark.createDataFrame([(i, int(v), str(s)) for i, (v, s) in enumerate(zip(y, split))], "flight_id long, label int, split string")
    return x, y, split, feats, flights


def numpy_rounds(x, y, split, s):
    t, v = split == "train", split == "val"
    mean, std = x[t].mean(0), x[t].std(0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / std])
    pw = (y[t] == 0).sum() / (y[t] == 1).sum()
    w = np.zeros(4)
    m, q = np.zeros(4), np.zeros(4)
    best, best_epoch, best_w, f1s = -1, 0, w.copy(), []
    for e in range(1, s.epochs + 1):
        p = 1 / (1 + np.exp(-z[t] @ w))
        g = (np.where(y[t] == 1, pw, 1)[:, None] * (p - y[t])[:, None] * z[t]).mean(0)
        g = g * min(1, s.clip / (np.linalg.norm(g) + 1e-6))
        m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
        lr = s.least_rate + (s.rate - s.least_rate) * (1 + math.cos(math.pi * (e - 1) / s.epochs)) / 2
        w = w * (1 - lr * s.weight_decay) - lr * (m / (1 - 0.9 ** e)) / (np.sqrt(q / (1 - 0.999 ** e)) + 1e-8)
        hit = 1 / (1 + np.exp(-z[v] @ w)) >= s.threshold
        tp, fp, fn = (hit & (y[v] == 1)).sum(), (hit & (y[v] == 0)).sum(), (~hit & (y[v] == 1)).sum()
        f1s.append(2 * tp / max(2 * tp + fp + fn, 1))
        if f1s[-1] > best:
            best, best_epoch, best_w = f1s[-1], e, w.copy()
        if e - best_epoch >= s.patience:
            break
    return best_epoch, best_w, f1s


@pytest.mark.parametrize("settings", [tr.Settings(), tr.Settings(epochs=12, patience=2, rate=0.5, clip=0.05), tr.Settings(epochs=3)])
def test_rounds_like_numpy(spark, settings):
    x, y, split, feats, flights = data(spark)
    model = tr.fit(feats, flights, CH, settings=settings)
    epoch, w, f1s = numpy_rounds(x, y, split, settings)
    assert model.best_epoch == epoch and np.allclose(model.weights, w, atol=1e-9)
    assert np.allclose([e["val_f1"] for e in model.epochs], f1s) and [e["best"] for e in model.epochs].count(True) >= 1
    losses = [e["train_loss"] for e in model.epochs]
    assert losses[0] > losses[-1] and math.isclose(losses[0], math.log(2) * 2 * (y[split == "train"] == 0).mean(), rel_tol=1e-9)


def test_stops_early_and_keeps_the_best(spark):
    *_, feats, flights = data(spark, signal=0.0, seed=4)
    model = tr.fit(feats, flights, CH, settings=tr.Settings(epochs=25, patience=3))
    f1s = [e["val_f1"] for e in model.epochs]
    assert len(f1s) < 25 and len(f1s) - model.best_epoch == 3 and f1s[model.best_epoch - 1] == max(f1s)


def test_score_and_attribution_by_finite_differences(spark):
    x, y, _, feats, flights = data(spark)
    model = tr.fit(feats, flights, CH, settings=tr.Settings(epochs=6))
    base = {r.flight_id: r for r in tr.score(feats, model).collect()}
    z = (x - model.mean) / np.array(model.std)
    logit = model.weights[0] + z @ model.weights[1:]
    assert np.allclose([base[i].logit for i in range(len(x))], logit)
    # the closed-form gradient of the probability, along the features themselves, is the directional difference
    step = 1e-5
    ahead = {r.flight_id: r.probability for r in tr.score(feats.select("flight_id", *[(F.col(c) * (1 + step)).alias(c) for c in CH]), model).collect()}
    p = 1 / (1 + np.exp(-logit))
    closed = p * (1 - p) * (x * model.weights[1:] / np.array(model.std)).sum(1)
    assert np.allclose([(ahead[i] - base[i].probability) / step for i in range(len(x))], closed, atol=1e-3, rtol=1e-3)
    coef = tr.coefficients(spark, model)
    linear = {r.flight_id: r.logit for r in sc.score_flights(feats, coef, CH).collect()}
    assert np.allclose([linear[i] for i in range(len(x))], logit)
    rows = feats.withColumn("t", F.lit(0))
    got = {(r.flight_id, r.channel): r.importance for r in sc.channel_importance(rows, tr.score(feats, model), coef, CH).collect()}
    pull = np.abs((p * (1 - p))[:, None] * x * model.weights[1:] / np.array(model.std))
    want = pull / pull.max(1, keepdims=True)
    assert np.allclose([[got[i, c] for c in CH] for i in range(len(x))], want)


def test_odd_inputs(spark):
    _, _, _, feats, flights = data(spark, n=60)
    none = tr.fit(feats, flights.where("false"), CH)
    assert none.weights == [0.0] * 4 and none.epochs == []
    assert {r.probability for r in tr.score(feats, none).collect()} == {0.5}
    one = tr.fit(feats.withColumn("b", F.lit(None).cast("double")).withColumn("c", F.lit(2.0)),
                 flights.withColumn("label", F.when(F.col("flight_id") % 5 > 0, 0)), CH, settings=tr.Settings(epochs=2))
    assert len(one.epochs) == 2 and all(math.isfinite(v) for v in one.weights) and one.epochs[-1]["val_f1"] == 0


def quotas(counts, first=0.3, second=0.333):
    """Labels' val and test flights by largest remainders, in exact fractions."""
    def deal(have, seats):
        total = sum(have.values())
        share = {k: Fraction(v * seats, total) for k, v in have.items()}
        out = {k: int(v) for k, v in share.items()}
        for k in sorted(have, key=lambda k: (-(share[k] - out[k]), k))[:seats - sum(out.values())]:
            out[k] += 1
        return out

    n = sum(counts.values())
    temp_n = math.ceil(first * n)
    train = deal(counts, n - temp_n)
    temp = {k: v - train[k] for k, v in counts.items()}
    val = deal(temp, temp_n - math.ceil(second * temp_n))
    return {k: (train[k], val[k], temp[k] - val[k]) for k in counts}


@pytest.mark.parametrize("labels,n", [(2, 1003), (3, 100), (50, 1517), (7, 7), (1, 11)])
def test_split_totals_are_exact(spark, labels, n):
    rnd = random.Random(labels)
    rows = [(i, None if labels > 2 and i % labels == 0 else rnd.randrange(labels)) for i in range(n)]
    out = sn.stratified_split(spark.createDataFrame(rows, "flight_id long, label int"), "flight_id", "label").collect()
    assert sorted(r.flight_id for r in out) == list(range(n))
    counts, got = {}, {}
    for r in out:
        k = "-" if r.label is None else f"+{r.label}"
        counts[k] = counts.get(k, 0) + 1
        got.setdefault(k, {"train": 0, "val": 0, "test": 0})[r.split] += 1
    assert {k: (v["train"], v["val"], v["test"]) for k, v in got.items()} == quotas(counts)
    temp = math.ceil(0.3 * n)
    assert sum(v["test"] for v in got.values()) == math.ceil(0.333 * temp) and sum(v["train"] for v in got.values()) == n - temp
