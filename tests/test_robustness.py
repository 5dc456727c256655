"""Missing and unusual input: no row vanishes, no digits are lost, no size switch changes a result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetrix.functions.joins import threshold_bytes
from telemetrix.operators import anomaly, chunked, metrics, score, split_norm
from telemetrix.sources import io


def test_any_phase_names_are_detected(spark):
    rng = np.random.default_rng(1)
    rows = [(f, p, float(rng.normal())) for f in range(6) for p in ("click", "view") for _ in range(40)]
    rows += [(99, "click", 50.0)] * 30 + [(99, "click", 0.0)] * 10 + [(99, "other", 1.0)] * 40
    df = spark.createDataFrame(rows, "flight_id long, phase string, x double")
    base = anomaly.fit_baseline(df.where("flight_id < 6"), ["x"], min_rows=10)
    got = {(r.flight_id, r.phase): r for r in anomaly.phase_channel_stats(df, base, ["x"], min_rows=10).collect()}
    assert got[99, "click"].n_flagged == 30 and (99, "other") not in got and len(got) == 13


def test_baseline_keeps_its_digits(spark):
    rows = [(f, "a", 1234.567, 3333333.33, 1e7 + 0.01 * (i % 7)) for f in range(3) for i in range(70)]
    df = spark.createDataFrame(rows, "flight_id long, phase string, c double, d double, e double")
    got = {r.channel: r for r in anomaly.fit_baseline(df, ["c", "d", "e"]).collect()}
    assert got["c"].std == 1.0 and got["d"].std == 1.0
    assert got["e"].std == pytest.approx(0.02, rel=1e-3)
    check = split_norm.post_norm_check(df.withColumn("split", F.lit("train")), ["e"]).first()
    assert check["std"] == pytest.approx(0.02, rel=1e-3)


def test_missing_statistics_give_null(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "flight_id long, a double, b double")
    stats = split_norm.norm_stats(df.where("false"), ["a", "b"]).where("channel = 'a'")
    row = split_norm.apply_zscore(df, stats, ["a", "b"]).first()
    assert row.a is None and row.b is None
    coef = spark.createDataFrame([("a", 0, 0.0, 1.0, 1.0, 0.0)], "channel string, idx int, mu double, sd double, w double, bias double")
    assert score.score_flights(df, coef, ["a", "b"]).first().probability is None


def test_rows_without_a_step_stay(spark):
    rows = [(1, t, float(t)) for t in range(19)] + [(1, None, 99.0)]
    df = spark.createDataFrame(rows, "flight_id long, timestep long, x double")
    out, lengths = chunked.ordered_fill(df, "flight_id", ["timestep"], chunked.step_chunk("timestep", 4), ["x"])
    got = sorted((r.t, r.x) for r in out.collect())
    assert got == [(t, float(t)) for t in range(19)] + [(19, 99.0)]
    assert lengths.first().n_rows == 20
    dense = chunked.dense_index(df, "flight_id", ["timestep"], chunked.step_chunk("timestep", 4))
    assert sorted(r.t for r in dense.collect()) == list(range(20))


def test_split_keeps_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "flight_id long, label int")
    got = split_norm.stratified_split(df, "flight_id", "label").collect()
    assert len(got) == 40 and sum(r.label is None and r.split != "train" for r in got) == 3


def test_missing_score_ranks_lowest(spark):
    df = spark.createDataFrame([(1, 0.95, 2.0), (1, 0.2, -1.0), (0, 0.9, 1.0), (0, None, None)], "label int, prob double, logit double")
    assert metrics.roc_auc(df).first().auc == 0.75
    got = metrics.evaluate(df, threshold=0.5).first()
    assert (got.n, got.tp, got.fp, got.fn, got.tn) == (4, 1, 1, 1, 1)
    x = np.array([2.0, -1.0, 1.0])
    assert got.loss == pytest.approx((np.log1p(np.exp(-x[:2])).sum() + np.log1p(np.exp(x[2]))) / 3)


def test_header_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Master Index,date_diff,before_after,flight_length,label,hierarchy,number_flights_before\n"
        "7,-3.0,before,120,x,1,2.0\n8,,after,,y,1,\n")
    got = io.read_header_csv(spark, str(tmp_path / "a.csv")).orderBy("ingest_order").collect()
    assert [(r.master_index, r.date_diff, r.before_after, r.number_flights_before) for r in got] == [
        (7, -3, "before", 2), (8, None, "after", None)]
    (tmp_path / "b.csv").write_text(
        "Master Index,date_diff,before_after,flight_length,label,hierarchy,number_flights_before\n9,soon,before,1,x,1,2\n")
    with pytest.raises(Exception):
        io.read_header_csv(spark, str(tmp_path / "b.csv")).collect()
    both = io.read_header_csv(spark, str(tmp_path)).select("master_index", "ingest_order").orderBy("ingest_order")
    assert [r.master_index for r in both.collect()] == [7, 8, 9]


def test_broadcast_threshold_of_the_session(spark):
    try:
        for text, want in (("-1", -1), ("10m", 10 << 20), ("1g", 1 << 30), ("512", 512), ("3KB", 3 << 10)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert threshold_bytes(spark) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fleet_rank_of_saturated_scores(spark):
    from telemetrix.operators import reports
    rows = [(i * 7 % 1000, 1.0 if i % 3 else (None if i % 30 == 0 else i / 1000)) for i in range(1000)]
    df = spark.createDataFrame(rows, "flight_id long, probability double")
    got = {r.flight_id: r.fleet_rank for r in reports.rank_by_probability(df, chunks=16).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {f: n + 1 for n, (f, _) in enumerate(want)}


def test_auc_of_crowded_scores(spark):
    """Scores crowded into a sliver of the range, ties, negatives and a missing one, against all pairs."""
    import random
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 1), rnd.choice([None, -5.0, 0.5, *(0.5 + rnd.random() * 1e-9 for _ in range(6))])) for _ in range(600)]
    df = spark.createDataFrame(rows, "label int, prob double")
    key = lambda p: float("-inf") if p is None else p
    pos, neg = [key(p) for y, p in rows if y], [key(p) for y, p in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    for chunks in (4, 256):
        assert abs(metrics.roc_auc(df, chunks=chunks).first().auc - want) < 1e-12


def test_cleaning_audit_reads_the_rows_once(spark, sf_small):
    from telemetrix.operators import header
    from telemetrix.session import executed_plan
    df = spark.createDataFrame(
        [(i, a, d, f, "x", None, i) for i, (a, d, f) in enumerate([
            ("before", -3, 2000.0), ("before", -3, 2000.0), ("same", 0, 2000.0), (None, None, 1800.0), ("after", 31, 5000.0),
            ("after", 30, 1799.0), ("before", -3, None)])],
        "master_index int, before_after string, date_diff int, flight_length double, label string, hierarchy string, ingest_order int")
    got = [tuple(r) for r in header.cleaning_audit(df).orderBy("step_ord").select("step", "rows_in", "rows_out", "dropped").collect()]
    assert got == [("raw", None, 7, None), ("dedup", 7, 6, 1), ("length_filter", 6, 4, 2), ("drop_same", 4, 3, 1), ("date_range", 3, 2, 1)]
    assert [r.rows_out for r in header.cleaning_audit(df.limit(0)).collect()] == [0] * 5
    table = spark.read.parquet(f"{sf_small}/orders.parquet").selectExpr(
        "o_orderkey as master_index", "o_orderstatus as before_after", "1 as date_diff", "o_totalprice as flight_length", "o_orderkey as ingest_order")
    assert executed_plan(header.cleaning_audit(table)).count("Scan parquet") == 1
