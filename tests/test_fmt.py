"""Rounding and fixed-point text against Python's own, on random values and on every kind of tie."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemetrix.functions.fmt import fixed, round_exact


def values():
    rnd = random.Random(11)
    out = [0.0, 0.235, 2.675, 1.005, 0.5, 1.5, 2.5, 0.125, 0.375, 1e-9, -1e-9, -0.005, 1e15, 4503599627370495.5, 99999.995, 1 / 3]
    out += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-6, 9) for _ in range(300_000)]
    for d in range(7):  # next to and at half units of each decimal
        for _ in range(8000):
            x = (rnd.randrange(10 ** rnd.randint(1, 8)) + 0.5) / 10 ** d
            out += [x, -x, math.nextafter(x, math.inf), math.nextafter(x, -math.inf)]
    out += [(rnd.randrange(1 << 30) * 2 + 1) / 2 ** rnd.randint(1, 12) for _ in range(40_000)]  # exact binary ties
    return out


@pytest.fixture(scope="module")
def table(spark):
    data = values()
    return data, spark.createDataFrame(pd.DataFrame({"i": range(len(data)), "x": data})).repartition(4)


@pytest.mark.parametrize("decimals", [0, 1, 2, 4, 6])
def test_like_python(table, decimals):
    data, df = table
    got = df.select("i", fixed("x", decimals).alias("t"), round_exact("x", decimals).alias("r")).toPandas().sort_values("i")
    texts, numbers = [format(x, f".{decimals}f") for x in data], [round(x, decimals) for x in data]
    bad = [(x, a, b) for x, a, b in zip(data, got["t"], texts) if a != b]
    assert not bad, bad[:5]
    worse = [(x, a, b) for x, a, b in zip(data, got["r"], numbers) if a != b]
    assert not worse, worse[:5]


def test_odd_values_and_no_python_worker(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (1e300,), (12.0,)], "x double")
    out = df.select(fixed("x", 2).alias("t"), round_exact(F.col("x"), 1).alias("r"))
    rows = [tuple(r) for r in out.collect()]
    assert rows[0] == (None, None) and rows[1][0] is None and math.isnan(rows[1][1])
    assert rows[2:4] == [("inf", math.inf), ("-inf", -math.inf)] and rows[4][1] == 1e300 and rows[5] == ("12.00", 12.0)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
