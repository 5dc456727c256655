"""End to end on the real flight schema (hand-made rows in the source layout)."""

import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from telemetrix import api
from telemetrix.functions import dims
from telemetrix.session import materialize
from telemetrix.sources import io

SOURCE = {dst: src for src, dst in io.SENSOR_SOURCE_COLUMNS.items()}


def _fixture(spark):
    rng = np.random.default_rng(7)
    d = tempfile.mkdtemp(prefix="telemetrix-api-")
    rows = []
    for fid in range(1, 31):
        n = int(rng.integers(100, 180))
        for t in rng.permutation(n):  # unsorted on purpose
            rec = {"Master Index": fid, "timestep": int(t), "cluster": "c"}
            for ch in dims.RAW_SENSORS:
                lo, hi = dims.CLIP_BOUNDS[ch]
                v = float(rng.uniform(lo - 0.1 * (hi - lo), hi + 0.1 * (hi - lo)))
                rec[SOURCE[ch]] = float("nan") if rng.random() < 0.05 else v
            rows.append(rec)
    pd.DataFrame(rows).to_parquet(os.path.join(d, "sensor.parquet"))
    hdr = ["Master Index,before_after,date_diff,flight_length,label,hierarchy,number_flights_before"]
    for fid in range(1, 31):
        dd = int(rng.integers(-12, 12))
        ba = "before" if dd < 0 else ("same" if dd == 0 else "after")
        hdr.append(f"{fid},{ba},{dd},{2000 + fid},magneto failure,,{fid % 3}")
    hdr.append(hdr[1])  # an exact duplicate row
    with open(os.path.join(d, "header.csv"), "w") as f:
        f.write("\n".join(hdr) + "\n")
    return io.load_data(spark, os.path.join(d, "header.csv"), os.path.join(d, "sensor.parquet"))


def test_real_schema_end_to_end(spark):
    data = _fixture(spark)
    t = api.run_transformation(data["header"])
    assert t["clean"].count() == 30  # the duplicate collapses
    prepared = api.run_feature_engineering(data["sensor"], t["clean"], t["labelled"], n_steps=128,
                                           chunk_steps=64).cache()
    per = {r.flight_id: r["count"] for r in prepared.groupBy("flight_id").count().collect()}
    assert per and set(per.values()) == {128}
    nulls = prepared.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in dims.ALL_CHANNELS]).collect()[0]
    assert all(v == 0 for v in nulls)
    bounds = prepared.agg(F.min("e1_oilt").alias("lo"), F.max("e1_oilt").alias("hi")).collect()[0]
    assert bounds.lo >= 0 and bounds.hi <= 300
    stats, z = api.normalize(prepared)
    z = materialize(z, "normalised")  # the prepared dataset is written once, as in a real run
    baseline = api.fit_detector(z)
    det = api.detect(z, baseline).collect()
    assert det and all(0.0 <= r.anomaly_score <= 1.0 for r in det)
    coef, scores = api.fit_and_score(z)
    s = scores.collect()
    assert len(s) == len(per) and all(0.0 <= r.probability <= 1.0 for r in s)
    alerts = api.predict(z, baseline, coef, scores).collect()
    assert len(alerts) == len(per) and alerts[0].alert.explanation.summary
    log = tempfile.mkdtemp(prefix="telemetrix-runs-")
    run = api.run_retraining(z, scores, log_path=log).collect()
    assert len(run) == 1 and run[0].pipeline_type == "evaluate_only"
    logged = spark.read.parquet(log).collect()
    assert len(logged) == 1 and logged[0].params["pipeline_type"] == "evaluate_only" and "f1" in logged[0].metrics
