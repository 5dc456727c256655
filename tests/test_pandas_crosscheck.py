"""K3: the per-flight pandas procedure (sort, clip, ffill/bfill/0, derive, cut/pad) run per flight with
applyInPandas as an independent cross-check of the Spark plan, on real lineitem flights."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from telemetrix.functions import dims
from telemetrix.operators import timeseries as ts
from telemetrix.sources import tables as tb

N = 600
CH = tb.LINEITEM_CHANNELS
OUT = CH + dims.DERIVED_CHANNELS


def test_prepare_matches_per_flight_pandas(spark, sf_small):
    def _per_flight(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tb.LINEITEM_ORDER).reset_index(drop=True)
        if len(pdf) < dims.MIN_FLIGHT_ROWS:
            return pd.DataFrame(columns=["flight_id", "t", *OUT])
        x = pdf[CH].copy()
        for c, (lo, hi) in tb.LINEITEM_CLIP.items():
            x[c] = x[c].clip(lower=lo, upper=hi)
        x = x.ffill().bfill().fillna(0.0)
        d = tb.LINEITEM_DERIVE
        cht, egt = x[list(d["cht"])].values, x[list(d["egt"])].values
        x["cht_spread"] = cht.max(axis=1) - cht.min(axis=1)
        x["cht_mean"] = cht.mean(axis=1)
        x["cht4_minus_cht1"] = cht[:, -1] - cht[:, 0]
        x["egt_spread"] = egt.max(axis=1) - egt.min(axis=1)
        x["egt_mean"] = egt.mean(axis=1)
        x["egt_cht_divergence"] = x["egt_mean"] - x["cht_mean"]
        x["fqty_imbalance"] = x[d["fqty"][0]] - x[d["fqty"][1]]
        x["is_cruise"] = ((x[d["ias"]] > d["cruise_ias"]) & (x[d["alt"]] > d["cruise_alt"])).astype(float)
        arr = x[OUT].values
        arr = arr[-N:] if len(arr) >= N else np.vstack([np.zeros((N - len(arr), len(OUT))), arr])
        out = pd.DataFrame(arr, columns=OUT)
        out.insert(0, "t", np.arange(N, dtype=np.int32))
        out.insert(0, "flight_id", int(pdf["flight_id"].iloc[0]))
        return out

    sensor = tb.lineitem_sensor(spark, sf_small, inject_gaps=True)
    schema = "flight_id long, t int, " + ", ".join(f"{c} double" for c in OUT)
    want = sensor.groupBy("flight_id").applyInPandas(_per_flight, schema).toPandas()
    for chunk, rows in ((F.floor(F.unix_date(F.to_date("l_shipdate")) / 8), 1), (F.lit(0), 1), (None, 1 << 19), (None, 80)):
        got = ts.prepare_flights(sensor, CH, tb.LINEITEM_ORDER, chunk, tb.LINEITEM_CLIP,
                                 tb.LINEITEM_DERIVE, n_steps=N, max_rows=rows).toPandas()
        _compare(want, got)


def _compare(want, got):
    key = ["flight_id", "t"]
    a = want.sort_values(key).reset_index(drop=True)
    b = got.sort_values(key).reset_index(drop=True)[a.columns]
    assert len(a) == len(b) and (a[key].values == b[key].values).all()
    assert np.allclose(a[OUT].values, b[OUT].values, rtol=1e-9, atol=1e-9)
