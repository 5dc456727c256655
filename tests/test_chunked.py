"""The chunked (skew-safe) scans must equal plain per-key windows for any chunk width."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from telemetrix.operators import chunked
from telemetrix.operators import timeseries as ts


def _rows(seed=7, n_keys=3):
    rnd = random.Random(seed)
    rows = []
    for k in range(n_keys):
        n = rnd.randint(20, 90)
        for i in range(n):
            v = None if rnd.random() < 0.3 else rnd.uniform(-5, 5)
            rows.append((k, i * 3 + rnd.randint(0, 2), v))
    return rows


def test_dense_index_matches_row_number(spark):
    df = spark.createDataFrame(_rows(), "k long, ts long, v double")
    want = df.withColumn("t", F.row_number().over(Window.partitionBy("k").orderBy("ts")) - 1)
    for width in (5, 17, 10_000):
        got = chunked.dense_index(df, "k", ["ts"], F.floor(F.col("ts") / width), "t", "n")
        a = sorted((r.k, r.ts, r.t) for r in got.collect())
        b = sorted((r.k, r.ts, r.t) for r in want.collect())
        assert a == b


def test_fill_matches_plain_window(spark):
    df = chunked.dense_index(spark.createDataFrame(_rows(3), "k long, ts long, v double"), "k", ["ts"], F.lit(0))
    w = Window.partitionBy("k").orderBy("t")
    plain = df.withColumn("v", F.coalesce(F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                                          F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
                                          F.lit(0.0)))
    want = sorted((r.k, r.t, r.v) for r in plain.collect())
    for width in (3, 8, 4096):
        got = sorted((r.k, r.t, r.v) for r in ts.fill_gaps(df, ["v"], key="k", chunk_steps=width).collect())
        assert got == want


def test_running_sum(spark):
    df = spark.createDataFrame([(1, t, t % 3) for t in range(50)], "k long, t int, v int")
    for width in (4, 1000):
        rs = {r.t: r.cs for r in chunked.running_sum(df, "k", ["t"], chunked.step_chunk("t", width), "v", "cs").collect()}
        assert rs[49] == sum(t % 3 for t in range(50)) and rs[0] == 0


def test_dilated_filter_matches_numpy(spark):
    import numpy as np
    x = np.arange(1, 301, dtype=float)
    df = spark.createDataFrame([(1, int(t), float(v)) for t, v in enumerate(x)], "flight_id long, t int, x double")
    w = (0.25, 0.5, 0.25)
    for width in (300, 4096):
        out = ts.causal_dilated_filter(df, "x", w, (1, 4, 64), chunk_steps=width).orderBy("t").collect()
        for d in (1, 4, 64):
            want = np.zeros_like(x)
            for k, wk in enumerate(w):
                lag = (len(w) - 1 - k) * d
                want += wk * np.concatenate([np.zeros(lag), x[:len(x) - lag]]) if lag else wk * x
            assert np.allclose([r[f"x_d{d}"] for r in out], want)
