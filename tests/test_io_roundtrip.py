"""Write/read round trips for the sinks (A4-A7, A10) and the header / sensor scans (A1, A2)."""

import os
import tempfile

from pyspark.sql import functions as F

from telemetrix.operators import split_norm as sn
from telemetrix.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="telemetrix-test-")


def test_header_csv_and_sensor_parquet_scans(spark):
    d = _tmp()
    with open(os.path.join(d, "h.csv"), "w") as f:
        f.write("Master Index,before_after,date_diff,flight_length,label,hierarchy,number_flights_before\n")
        f.write("5,before,-3,2000.5,magneto failure,,2\n7,same,0,1500,oil leak/pressure issue,oil,-1\n")
    h = io.read_header_csv(spark, os.path.join(d, "h.csv")).orderBy("ingest_order").collect()
    assert [r.master_index for r in h] == [5, 7] and h[0].hierarchy is None and h[1].date_diff == 0
    sensor = spark.createDataFrame([(5, 0, "c1", float("nan"), 3.0)], "`Master Index` long, timestep int, cluster string, "
                                                                      "`E1 OilT` double, IAS double")
    sensor.write.parquet(os.path.join(d, "s"))
    s = io.read_sensor_parquet(spark, os.path.join(d, "s")).collect()[0]
    assert s.flight_id == 5 and s.e1_oilt is None and s.ias == 3.0 and "cluster" not in s.asDict()


def test_prepared_sink_and_split_scan(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, 0, 1.0, 0, "train"), (2, 0, 2.0, 1, "test")],
                               "flight_id long, t int, a double, label int, split string")
    io.write_prepared(df, d)
    back = io.read_prepared(spark, d, "test")
    assert [r.flight_id for r in back.collect()] == [2]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan
    stats = sn.norm_stats(df.where("split = 'train'"), ["a"])
    m = io.dataset_manifest(df, stats, ["a"]).collect()[0]
    assert m.total_flights == 2 and m.channels == ["a"] and m.norm_std == [1.0]
    io.write_manifest(io.dataset_manifest(df, stats, ["a"]), os.path.join(d, "_manifest"))


def test_baseline_round_trip(spark):
    d = _tmp()
    base = spark.createDataFrame([("cruise", "x", 1.0, 2.0), ("taxi", "x", 0.5, 1.0)],
                                 "phase string, channel string, mean double, std double")
    io.save_baseline(base, d, 3.0)
    rows, settings = io.load_baseline(spark, d)
    assert sorted(tuple(r) for r in rows.collect()) == sorted(tuple(r) for r in base.collect())
    s = settings.collect()[0]
    assert s.z_threshold == 3.0 and s.is_fitted


def test_run_log_append(spark):
    d = _tmp()
    m = spark.createDataFrame([(0.5, 0.7)], "f1 double, auc double")
    for _ in range(2):
        io.append_run(io.run_record(spark, "retrain", {"threshold": "0.35"}, m), d)
    back = spark.read.parquet(d)
    rows = back.collect()
    assert len(rows) == 2 and rows[0].params["threshold"] == "0.35" and rows[0].metrics["auc"] == 0.7
    assert rows[0].run_name.startswith("retrain_") and len(rows[0].run_name) == len("retrain_20260101_000000")
    assert back.select(F.countDistinct("run_id")).collect()[0][0] == 2


def test_checked_broadcast(spark, sf_small):
    from telemetrix.functions.joins import broadcast_if_small, estimated_bytes
    nation = spark.read.parquet(f"{sf_small}/nation.parquet")
    assert estimated_bytes(nation) is not None
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet").select("l_suppkey")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        off = li.join(broadcast_if_small(nation), li.l_suppkey == nation.n_nationkey)
        assert "BroadcastHashJoin" not in off._jdf.queryExecution().executedPlan().toString()
        small = li.join(broadcast_if_small(nation, max_bytes=1 << 20), li.l_suppkey == nation.n_nationkey)
        big = li.join(broadcast_if_small(nation, max_bytes=1), li.l_suppkey == nation.n_nationkey)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in big._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
