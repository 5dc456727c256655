"""Hand-made cases for the semantic traps (FIXTURES.md part 3)."""

import math

from pyspark.sql import functions as F

from telemetrix.functions import dims
from telemetrix.functions.exprs import clip, nan_to_null, phase_expr
from telemetrix.operators import anomaly as an
from telemetrix.operators import drift as dr
from telemetrix.operators import header as hd
from telemetrix.operators import local as lc
from telemetrix.operators import metrics as mt
from telemetrix.operators import timeseries as ts
from telemetrix.operators import split_norm as sn
from telemetrix.sources import io


def test_clip_keeps_null_and_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 50.0), (4, -1.0), (5, 10.0)], "id int, x double")
    out = {r.id: r.y for r in df.select("id", clip(nan_to_null("x"), 0, 35).alias("y")).collect()}
    assert out == {1: None, 2: None, 3: 35.0, 4: 0.0, 5: 10.0}


def _series(spark, rows):
    return spark.createDataFrame(rows, "flight_id long, t int, a double, b double")


def test_fill_leading_inner_trailing_and_all_missing(spark):
    rows = [(1, 0, None, None), (1, 1, 2.0, None), (1, 2, None, None), (1, 3, 4.0, None), (1, 4, None, None)]
    for width in (2, 4096):
        out = ts.fill_gaps(_series(spark, rows), ["a", "b"], chunk_steps=width).orderBy("t").collect()
        assert [r.a for r in out] == [2.0, 2.0, 2.0, 4.0, 4.0]
        assert [r.b for r in out] == [0.0] * 5


def test_cut_and_pad_lengths(spark):
    rows = []
    for fid, n in [(1, 9), (2, 10), (3, 11), (4, 12), (5, 13)]:
        rows += [(fid, i, 1.0 + i, 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "flight_id long, ts long, a double, b double")
    out = ts.prepare_flights(df, ["a", "b"], ["ts"], F.floor(F.col("ts") / 4), {}, None, n_steps=12)
    counts = {r.flight_id: r["count"] for r in out.groupBy("flight_id").count().collect()}
    assert counts == {2: 12, 3: 12, 4: 12, 5: 12}  # flight 1 (9 rows) is dropped
    f2 = out.where("flight_id = 2").orderBy("t").collect()
    assert [r.is_pad for r in f2[:2]] == [True, True] and f2[0].a == 0.0 and f2[2].a == 1.0
    f5 = out.where("flight_id = 5").orderBy("t").collect()
    assert f5[0].a == 2.0 and f5[-1].a == 13.0  # last 12 steps kept


def test_gap_value_carried_in_from_before_the_cut(spark):
    rows = [(1, 0, 7.0, 1.0), (1, 1, None, 1.0), (1, 2, None, 1.0), (1, 3, None, 1.0), (1, 4, 9.0, 1.0)]
    rows += [(1, i, 1.0, 1.0) for i in range(5, 12)]
    df = spark.createDataFrame(rows, "flight_id long, ts long, a double, b double")
    out = ts.prepare_flights(df, ["a", "b"], ["ts"], F.lit(0), {}, None, n_steps=10).orderBy("t").collect()
    assert out[0].a == 7.0  # t=2 in the source, filled from before the cut


def test_dedup_ignores_key_and_nulls_equal(spark):
    rows = [(10, "before", -1, 2000.0, "x", None, 1), (11, "before", -1, 2000.0, "x", None, 2),
            (12, "after", 3, 2000.0, "x", "h", 3)]
    df = spark.createDataFrame(rows, "master_index long, before_after string, date_diff int, flight_length double, "
                                     "label string, hierarchy string, ingest_order long")
    out = sorted(r.master_index for r in hd.dedup_keep_first(df).collect())
    assert out == [10, 12]


def test_same_filter_keeps_missing_and_label_to_other(spark):
    rows = [(1, None, -5, 2000.0, "unknown label", None, 1), (2, "same", 0, 2000.0, "magneto failure", None, 2),
            (3, "before", -3, 2000.0, "magneto failure", None, 3)]
    df = spark.createDataFrame(rows, "master_index long, before_after string, date_diff int, flight_length double, "
                                     "label string, hierarchy string, ingest_order long")
    clean = hd.clean_header(df)
    h = {r.master_index: r.hierarchy for r in clean.collect()}
    assert h == {1: "other", 2: "engine", 3: "engine"}
    lab = {r.master_index: r.label_binary for r in hd.construct_labels(clean).collect()}
    assert lab == {1: 1, 3: 1}


def test_phase_edges(spark):
    spec = dims.PhaseSpec(ias="ias", alt="alt", cruise_ias=70, cruise_alt=1500, taxi_ias=30, taxi_alt=500)
    rows = [(70.0, 2000.0), (71.0, 1500.0), (71.0, 1501.0), (29.0, 499.0), (30.0, 499.0), (30.0, 1500.0), (29.0, 600.0)]
    df = spark.createDataFrame(rows, "ias double, alt double")
    got = [r.p for r in df.select(phase_expr("ias", "alt", spec).alias("p")).collect()]
    assert got == ["descent", "takeoff", "cruise", "taxi", "takeoff", "takeoff", "descent"]


def test_min_rows_and_persistence_edges(spark):
    # flight 1: 29 rows in cruise (skipped), flight 2: 30 rows (kept); constant channel -> std 1
    rows = [(1, t, "cruise", 5.0) for t in range(29)] + [(2, t, "cruise", 5.0) for t in range(30)]
    df = spark.createDataFrame(rows, "flight_id long, t int, phase string, x double")
    base = an.fit_baseline(df, ["x"])
    b = base.collect()
    assert len(b) == 1 and b[0].std == 1.0 and b[0].n_rows == 30
    # exactly 5 % flagged on 40 rows = 2 rows -> persistent; 1 row -> not
    rows2 = [(3, t, "cruise", 5.0 + (10.0 if t < 2 else 0.0)) for t in range(40)]
    rows2 += [(4, t, "cruise", 5.0 + (10.0 if t < 1 else 0.0)) for t in range(40)]
    st = an.phase_channel_stats(spark.createDataFrame(rows2, df.schema), base, ["x"], z_threshold=2.5)
    got = {r.flight_id: r.persistent for r in st.collect()}
    assert got == {3: True, 4: False}


def test_flight_without_anomaly(spark):
    cs = dims.ChannelSet((dims.Channel("x", maintenance=True),))
    rows = [(1, t, "cruise", 5.0) for t in range(40)]
    df = spark.createDataFrame(rows, "flight_id long, t int, phase string, x double")
    base = an.fit_baseline(df, ["x"])
    st = an.phase_channel_stats(df, base, ["x"])
    det = an.detection_summary(st, df, cs).collect()[0]
    assert det.anomaly_score == 0.0 and det.flagged_sensors == [] and set(det.phase_anomalies.values()) == {0}
    from telemetrix.operators import reports as rp
    wp = rp.worst_phase(an.phase_anomalies(st, df, cs)).collect()[0]
    assert wp.worst_phase == "N/A"


def test_psi_identical_constant_and_max_value(spark):
    a = spark.createDataFrame([(float(i), 3.0) for i in range(100)], "x double, c double")
    sides = dr.tag_sides(a, a, ["x", "c"])
    psi = {r.channel: r.psi for r in dr.psi_by_channel(sides, ["x", "c"]).collect()}
    assert abs(psi["x"]) < 1e-12 and abs(psi["c"]) < 1e-12
    # maximum value falls into the last bin: shift one side's max
    b = spark.createDataFrame([(0.0, 1.0), (10.0, 1.0)], "x double, c double")
    c = spark.createDataFrame([(10.0, 1.0), (10.0, 1.0)], "x double, c double")
    p = {r.channel: r.psi for r in dr.psi_by_channel(dr.tag_sides(b, c, ["x", "c"]), ["x", "c"]).collect()}
    e, a_ = [0.5 + 1e-6] + [1e-6] * 8 + [0.5 + 1e-6], [1e-6] * 9 + [1.0 + 1e-6]
    want = sum((y - x) * math.log(y / x) for x, y in zip(e, a_))
    assert abs(p["x"] - want) < 1e-9


def test_metrics_zero_division_one_class_and_ties(spark):
    df = spark.createDataFrame([(1, 0, 0.1, -2.0), (2, 0, 0.2, -1.0)], "flight_id long, label int, prob double, logit double")
    m = mt.evaluate(df).collect()[0]
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1 == 0.0 and m.auc == 0.5
    tied = spark.createDataFrame([(1, 1, 0.5, 0.0), (2, 0, 0.5, 0.0), (3, 1, 0.9, 2.0), (4, 0, 0.1, -2.0)],
                                 "flight_id long, label int, prob double, logit double")
    assert abs(mt.roc_auc(tied).collect()[0].auc - 0.875) < 1e-12


def test_promotion_rules(spark):
    def run(f1, recall, auc):
        df = spark.createDataFrame([(f1, recall, auc)], "f1 double, recall double, auc double")
        return mt.promotion_decision(df).collect()[0]

    assert run(0.6, 0.9, 0.7).promote
    r = run(0.5, 0.9, 0.7)
    assert not r.promote and r.reason.startswith("F1 not improved (0.5211→0.5000)")
    assert run(0.6, 0.8, 0.7).reason == "Recall degraded (0.8710→0.8000)"
    assert run(0.6, 0.9, 0.6).reason == "AUC degraded (0.6973→0.6000)"
    r = run(0.5, 0.8, None)
    assert not r.promote and r.reason.count(" | ") == 2 and "AUC degraded (0.6973→" in r.reason


def test_segments_gap_rule_and_cap(spark):
    flagged = [0, 15, 31, 32] + [100 + 20 * k for k in range(20)]
    rows = [(1, t, 1 if t in flagged else 0) for t in range(600)]
    df = spark.createDataFrame(rows, "flight_id long, t int, flag int")
    for width in (16, 4096):
        seg = [(r.segment, r.seg_start, r.seg_end) for r in lc.anomaly_segments(df, chunk_steps=width)
               .orderBy("segment").collect()]
        assert seg[0] == (1, 0, 15) and seg[1] == (2, 31, 32) and len(seg) == 22
        assert lc.anomaly_segments(df, max_segments=15, chunk_steps=width).count() == 15


def test_moving_average_edges(spark):
    rows = [(1, t, float(t + 1)) for t in range(30)]
    df = spark.createDataFrame(rows, "flight_id long, t int, x double")
    import numpy as np
    want = np.convolve(np.arange(1, 31, dtype=float), np.ones(20) / 20, mode="same")
    for width in (16, 4096):
        got = [r.x_ma for r in ts.moving_average(df, ["x"], chunk_steps=width).orderBy("t").collect()]
        assert np.allclose(got, want)


def test_nested_input_shape_check(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[1.0, 2.0], [3.0]]), (3, [[1.0, 2.0]])]
    df = spark.createDataFrame(rows, "flight_id long, flight_data array<array<double>>")
    valid, rejects = io.validate_nested(df, "flight_data", 2, 2)
    assert [r.flight_id for r in valid.collect()] == [1]
    assert sorted(r.flight_id for r in rejects.collect()) == [2, 3]
    ex = io.explode_nested(valid, "flight_id", "flight_data", ["a", "b"]).orderBy("t").collect()
    assert [(r.t, r.a, r.b) for r in ex] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]


def test_split_is_exact_disjoint_and_complete(spark):
    df = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(1000)], "flight_id long, label int")
    out = sn.stratified_split(df, "flight_id", "label").cache()
    assert out.count() == 1000 and out.select("flight_id").distinct().count() == 1000
    c = {(r.split, r.label): r["count"] for r in out.groupBy("split", "label").count().collect()}
    assert [sum(v for (k, _), v in c.items() if k == s) for s in ("test", "val", "train")] == [100, 200, 700]
    assert c[("train", 1)] == 175 and c[("val", 1)] == 50 and c[("test", 1)] == 25


def test_absent_channel_becomes_zero(spark):
    df = spark.createDataFrame([(1, 0, 5.0)], "flight_id long, timestep int, a double")
    out = ts.project_channels(df, ["flight_id", "timestep"], ["a", "b"]).collect()[0]
    assert out.a == 5.0 and out.b == 0.0


def test_flight_id_fallback_and_first_n(spark):
    from telemetrix.operators import reports as rp
    df = spark.createDataFrame([(None, 0.2), (7, 0.9), (None, 0.5)], "fid long, p double")
    out = rp.flight_id_fallback(df, "fid", [F.col("p")], F.lit(0)).orderBy("p").collect()
    assert [r.flight_id for r in out] == [0, 1, 7]
    rows = spark.createDataFrame([(k, t) for k in (5, 1, 3, 9) for t in range(3)], "flight_id long, t int")
    assert sorted({r.flight_id for r in dr.first_n_flights(rows, "flight_id", 2).collect()}) == [1, 3]


def test_single_flight_report_tables(spark):
    from telemetrix.operators import reports as rp
    rows = spark.createDataFrame([(1, t, float(t % 7) + (30.0 if 50 <= t <= 53 else 0.0)) for t in range(100)],
                                 "flight_id long, t int, x double")
    timeline = rows.select("flight_id", "t", F.lit(0).alias("flag"))
    top = spark.createDataFrame([(1, 1, "x", "cruise", 3.2)], "flight_id long, rank int, sensor string, "
                                                               "phase string, max_z double")
    pc = spark.createDataFrame([(1, "taxi", 0), (1, "cruise", 3)], "flight_id long, phase string, count int")
    rep = rp.single_flight_report(rows, ["x"], timeline, top, pc)
    assert set(rep) == {"smoothed", "flags", "segments", "durations", "phase_share", "sensor_cards"}
    seg = rep["segments"].collect()
    assert [(r.seg_start, r.seg_end) for r in seg] == [(50, 53)]
    card = rep["sensor_cards"].collect()[0]
    assert card.sensor == "x" and card.phase == "cruise" and card.max_z == 3.2
    assert {r.phase: r.share_pct for r in rep["phase_share"].collect()} == {"taxi": 0.0, "cruise": 100.0}
