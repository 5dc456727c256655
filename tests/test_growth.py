"""What grows with the tables is shuffled, fitted and prepared once: plans and calls of the larger queries."""

import re

import pytest
from pyspark.sql import functions as F

from telemetrix.functions import joins
from telemetrix.operators import anomaly as an
from telemetrix.operators import chunked
from telemetrix.operators import local as lc
from telemetrix.operators import reports as rp
from telemetrix.operators import split_norm as sn
from telemetrix.plans import score_plans as scp
from telemetrix.plans import split_plans as spl
from telemetrix.session import executed_plan, materialize
from telemetrix.sources import io
from telemetrix.streaming import arrivals


@pytest.fixture
def series(spark):
    rows = [(None if k == 3 else k, (i * 37) % 101, i, None if (i + k) % 5 == 0 or (k == 2 and i < 9) else float(i * k))
            for k in range(5) for i in range(40 + 7 * k)]
    return spark.createDataFrame(rows, "k long, a long, b long, x double")


@pytest.fixture
def unbroadcast(spark):
    """AQE off and no broadcasts: the plan shows each exchange once, as at sizes beyond the broadcast limit."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    kept = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "-1")
    yield
    for n, v in zip(names, kept):
        spark.conf.set(n, v)


def _counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)

    def run(*args, **named):
        calls.append(args)
        return real(*args, **named)

    monkeypatch.setattr(module, name, run)
    return calls


def _shuffles(plan):
    return len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan))


def test_f3_short_keys_are_shuffled_once(series, unbroadcast):
    filled, _ = chunked.ordered_fill(series, "k", ["a", "b"], None, ["x"])
    assert _shuffles(executed_plan(filled)) == 1
    assert _shuffles(executed_plan(chunked.dense_index(series, "k", ["a", "b"], length_col="n"))) == 1


def test_f3_one_window_a_key_equals_chunks(series):
    def found(max_rows):
        rows, lengths = chunked.ordered_fill(series, "k", ["a", "b"], None, ["x"], {"x": F.col("x") + 1}, max_rows=max_rows)
        index = chunked.dense_index(series, "k", ["a", "b"], length_col="n", max_rows=max_rows)
        return [sorted(map(repr, f.collect())) for f in (rows, lengths, index)] + [f.dtypes for f in (rows, lengths, index)]

    assert found(1 << 19) == found(10)


def test_f3_long_keys_are_shuffled_once_for_rows_and_summary(series, unbroadcast):
    chunk = F.floor(F.col("a") / 10).cast("long")
    filled, _ = chunked.ordered_fill(series, "k", ["a", "b"], chunk, ["x"])
    assert re.search(r"ReusedExchange \[_key#\d+L, _no_key#\d+, _chunk#\d+L, a#", executed_plan(filled))


def test_f3_retraining_prepares_the_flights_once(spark, sf_small, monkeypatch):
    calls = _counted(monkeypatch, spl, "prepared_with_split")
    scp.q_retraining_run(spark, sf_small)
    assert len(calls) == 1


def test_f3_split_meets_the_prepared_rows_without_a_shuffle(spark, sf_small, monkeypatch):
    plans, real = [], spl.materialize
    monkeypatch.setattr(spl, "materialize", lambda df, name: (plans.append(executed_plan(df)), real(df, name))[1])
    spl.prepared_with_split(spark, sf_small)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_f9_features_and_statistics_are_computed_once(spark, sf_small, monkeypatch):
    stats, written = _counted(monkeypatch, sn, "norm_stats"), _counted(monkeypatch, scp, "materialize")
    z, feats, _, _ = scp._model(spark, sf_small)
    assert len(stats) == 1 and "features" in [a[1] for a in written]
    assert "FileScan parquet" in executed_plan(feats) and "HashAggregate" not in executed_plan(feats.select("n_steps"))
    assert "avg(" not in executed_plan(z)


def test_f2_timeline_and_statistics_share_a_fit(spark, sf_small, monkeypatch):
    fits = _counted(monkeypatch, an, "fit_baseline")
    scp.q_alert_json(spark, sf_small)
    assert len(fits) == 1


def test_f6_timeline_shuffles_its_flag_only(spark, monkeypatch):
    rows = spark.createDataFrame([(f, t, "cruise", float(t % 7), float(t)) for f in range(3) for t in range(50)],
                                 "flight_id long, t int, phase string, x double, other double")
    met = _counted(monkeypatch, an, "skew_join")
    flags = an.anomaly_timeline(rows, an.fit_baseline(rows, ["x"]), ["x"], z_threshold=1.2)
    assert met[0][0].columns == ["flight_id", "phase", "t", "_any"]
    assert sum(r["flag"] for r in flags.collect()) == sum(abs(t % 7 - 2.94) / 2.0235 > 1.2 for t in range(50)) * 3


def test_f8_local_score_joins_patterns_not_rows(spark, monkeypatch):
    rows = [(f, int((i * f) % 9 == 0), int((i + f) % 50 == 0)) for f in range(1, 5) for i in range(200)] + [(9, None, None)]
    flags = spark.createDataFrame(rows, "flight_id long, x_flag int, y_flag int")
    met = _counted(monkeypatch, lc, "skew_join")
    found = {r["flight_id"]: r["local_score"] for r in lc.local_flight_score(flags, ["x", "y"], min_share=0.05).collect()}
    assert met[0][0].count() <= 4 * 4 + 1
    for f in range(1, 5):
        mine = [r for r in rows if r[0] == f]
        picked = [i for i in (1, 2) if sum(r[i] for r in mine) / len(mine) >= 0.05]
        assert found[f] == pytest.approx(sum(any(r[i] for i in picked) for r in mine) / len(mine))
    assert found[9] is None


def test_f4_f8_ranking_reads_written_rows(spark, sf_small, monkeypatch):
    written = _counted(monkeypatch, rp, "materialize")
    scp.q_fleet_status(spark, sf_small)
    scp.q_fleet_at_risk(spark, sf_small)
    assert [a[1] for a in written] == ["fleet", "fleet"]


def test_f5_nested_flights_are_gathered_in_parts_that_grow(spark, monkeypatch):
    table = materialize(spark.range(20_000).select(F.col("id").alias("flight_id"), F.lit(0).alias("t"), F.rand(1).alias("x")), "t")
    size = joins.estimated_bytes(table)
    assert joins.parts_for(table, size // 50) >= 50
    assert joins.parts_for(table) == joins.parts_for(spark.createDataFrame([(1,)], "x long")) == 4
    monkeypatch.setattr(io, "parts_for", lambda df: 11)
    assert io.nest_flights(table, "flight_id", ["x"]).rdd.getNumPartitions() == 11


def test_f7_batches_are_not_persisted(spark, tmp_path, monkeypatch):
    flights = spark.createDataFrame([(f, [[float(t)] for t in range(3)]) for f in range(4)] + [(9, [[1.0]])],
                                    "flight_id long, flight_data array<array<double>>")
    arrivals.replay_as_files(flights, str(tmp_path / "in"), 2)
    seen = []

    def score(batch, *args):
        seen.append(batch.is_cached)
        return batch.select("flight_id"), batch.where(F.size("flight_data") != 3).select("flight_id")

    monkeypatch.setattr(arrivals, "score_batch", score)
    base = spark.createDataFrame([("p", "x", 0.0, 1.0)], "phase string, channel string, mean double, std double")
    arrivals.analyse_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), base, None, ["x"], None, 3)
    assert seen == [False] and spark.read.parquet(str(tmp_path / "out" / "scores")).count() == 5
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).select("flight_id").collect()] == [9]
