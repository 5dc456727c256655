"""Keys that hold most rows, tied order values, missing keys and phases, and any number of phases."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from telemetrix.functions.joins import PARTS_A_TASK, settled, skew_join
from telemetrix.operators import anomaly as an
from telemetrix.operators import chunked, local
from telemetrix.operators import timeseries as ts
from telemetrix.session import executed_plan
from telemetrix.sources import tables as tb


@contextmanager
def conf(spark, **values):
    """Spark SQL settings for a while; dots are written as two underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def skewed_lineitem(spark):
    """``lineitem`` with nine tenths of the rows on one flight and a third of those on one day."""
    rows = tb.lineitem_sensor(spark, "/root/testdata/sf0.01", inject_gaps=True)
    hot = F.pmod(F.xxhash64(*tb.LINEITEM_ORDER), F.lit(10)) < 9
    day = F.when(hot & (F.pmod(F.xxhash64("l_orderkey"), F.lit(3)) == 0), F.lit("1997-01-01")).otherwise(F.col("l_shipdate").cast("string"))
    return rows.withColumns({"flight_id": F.when(hot, F.lit(1)).otherwise(F.col("flight_id")),
                             "l_shipdate": day.cast(rows.schema["l_shipdate"].dataType)})


@pytest.mark.parametrize("max_rows", [300, 2000])
def test_chunks_hold_a_bounded_number_of_rows(spark, max_rows):
    df = skewed_lineitem(spark).cache()
    cut = chunked.row_chunks(df, "flight_id", tb.LINEITEM_ORDER, max_rows)
    sizes = cut.groupBy("flight_id", "_chunk").agg(F.count(F.lit(1)).alias("n"))
    n, most, flights = sizes.agg(F.count(F.lit(1)), F.max("n"), F.countDistinct("flight_id")).first()
    assert most <= 2 * max_rows and flights > 50
    assert n <= flights + 2 * df.count() / max_rows
    w = Window.partitionBy("flight_id").orderBy(*tb.LINEITEM_ORDER)
    steps = cut.withColumn("_back", F.lag("_chunk").over(w)).where("_chunk < _back")
    assert steps.count() == 0  # chunks rise along the order
    want = df.select("flight_id", *tb.LINEITEM_ORDER, (F.row_number().over(w) - 1).alias("t"))
    got = chunked.dense_index(df, "flight_id", tb.LINEITEM_ORDER, max_rows=max_rows).select("flight_id", *tb.LINEITEM_ORDER, "t")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    df.unpersist()


def test_no_task_orders_more_than_two_chunks_worth(spark):
    """Rows a task takes in the window stage, for a flight with nine tenths of the rows, with and without broadcast edges."""
    df = skewed_lineitem(spark)
    total = df.count()
    with conf(spark, spark__sql__shuffle__partitions="16", spark__sql__adaptive__enabled="false"):
        for limit in ("10485760", "-1"):
            with conf(spark, spark__sql__autoBroadcastJoinThreshold=limit):
                cut = chunked.row_chunks(df, "flight_id", tb.LINEITEM_ORDER, 150)
                w = Window.partitionBy("flight_id", "_chunk").orderBy(*tb.LINEITEM_ORDER)
                placed = cut.withColumn("_rn", F.row_number().over(w)).withColumn("p", F.spark_partition_id())
                tasks = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("_rn").alias("most")).collect()
                assert len(tasks) == 16 and max(r.n for r in tasks) < 2 * total / 16 and max(r.most for r in tasks) <= 300


def test_ties_missing_values_and_text_order(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, "a", "b"]), rnd.choice([None, "x", "x", "x", "y" * rnd.randint(1, 3)]), i, rnd.choice([None, 1.0 * i]))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o string, i long, v double")
    w = Window.partitionBy("k").orderBy(F.col("o").asc_nulls_last(), "i")
    want = rows_of(df.select("k", "o", "i", (F.row_number().over(w) - 1).alias("t")))
    assert len(want) == 3000
    for chunk, max_rows in ((None, 100), (None, 1 << 19), (F.lit(None), 1)):
        got = chunked.dense_index(df, "k", ["o", "i"], chunk, length_col="n", max_rows=max_rows)
        assert rows_of(got.select("k", "o", "i", "t")) == want
    # fills: the same for tiny chunks, one chunk, and plain windows
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    plain = rows_of(df.select("k", "i", F.coalesce(F.last("v", True).over(up), F.first("v", True).over(down), F.lit(0.0)).alias("v")))
    for max_rows in (90, 1 << 19):
        filled, lengths = chunked.ordered_fill(df, "k", ["o", "i"], None, ["v"], max_rows=max_rows)
        assert rows_of(filled.select("k", "i", "v")) == plain
        assert rows_of(lengths) == rows_of(df.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("n_rows")))
    dense = chunked.dense_index(df, "k", ["o", "i"], max_rows=100)
    assert rows_of(ts.fill_gaps(dense, ["v"], key="k", chunk_steps=64).select("k", "i", "v")) == plain
    total = chunked.running_sum(df, "k", ["o", "i"], None, F.lit(1), "s", max_rows=100)
    assert rows_of(total.select("k", "o", "i", (F.col("s") - 1).cast("int").alias("t"))) == want
    flags = dense.withColumn("flag", (F.col("i") % 40 == 0).cast("int"))
    seg = local.anomaly_segments(flags, "k", "t", chunk_steps=64)
    assert rows_of(seg) == rows_of(local.anomaly_segments(flags, "k", "t")) and seg.where("k is null").count() > 0


@pytest.mark.parametrize("make", [lambda s: s.range(300).selectExpr("if(id % 3 = 0, null, timestamp_seconds(id % 7)) as k", "id as i"),
                                  lambda s: s.range(300).selectExpr("if(id % 3 = 0, null, array(id % 7)) as k", "id as i"),
                                  lambda s: s.range(300).selectExpr("if(id % 3 = 0, null, id % 7 = 1) as k", "id as i")])
def test_missing_keys_of_any_type(spark, make):
    df = make(spark)
    want = rows_of(df.select("k", "i", (F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1).alias("t")))
    assert rows_of(chunked.dense_index(df, "k", ["i"], max_rows=80).select("k", "i", "t")) == want
    rows, lengths = chunked.ordered_fill(df, "k", ["i"], None, [])
    assert rows.count() == 300 and lengths.count() == df.select("k").distinct().count()


def test_skew_join_equals_join_and_copies_hot_keys_only(spark):
    rows = spark.range(6000).selectExpr("case when id % 10 < 9 then 1 when id % 50 = 9 then null else id end as k", "id as v")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).where("k is null or k <> 469")
    other = per_key.withColumnRenamed("k", "k_")
    for how in ("inner", "left"):
        want = rows_of(rows.join(other, F.col("k").eqNullSafe(F.col("k_")), how).select("k", "v", "n", "s"))
        assert rows_of(skew_join(rows, per_key, ["k"], "n", how)) == want
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false",
              spark__sql__shuffle__partitions="16"):
        j = skew_join(rows, per_key, ["k"], "n", "left")
        tasks = [r["count"] for r in j.groupBy(F.spark_partition_id()).count().collect()]
        assert max(tasks) <= 2 * 6000 / 16  # nine tenths of the rows have one key
        salts = F.ceil(F.col("n") * 16 * PARTS_A_TASK / per_key.agg(F.sum("n")).scalar())
        assert {r.k for r in per_key.where(salts > 1).collect()} == {1, None}  # cold keys are not copied


def test_settled_tables_have_a_known_size(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    for most in (65_536, 3):
        assert rows_of(settled(df, "small", most)) == rows_of(df)
    assert "LocalTableScan" in executed_plan(settled(df, "small"))


def phase_rows(spark, phases, with_null=True):
    """Forty rows of a flight in each phase, values around a level of the phase."""
    rows = spark.range(phases * 40).select(
        (F.col("id") % 4).alias("flight_id"), (F.col("id") % phases).alias("p"), F.col("id").alias("t"))
    null = F.lit(with_null) & (F.col("p") == 0)
    return rows.select("flight_id", "t", F.when(~null, F.concat(F.lit("p"), F.col("p"))).alias("phase"),
                       (1e6 * F.col("p") + F.pmod(F.xxhash64("t"), F.lit(1000))).alias("a"),
                       F.when(F.col("t") % 11 > 0, F.pmod(F.xxhash64("t", "p"), F.lit(50)).cast("double")).alias("b"))


def test_any_number_of_phases(spark):
    """20,000 phases: the broadcast and the shuffle way give the same rows, as does the plain definition."""
    rows = phase_rows(spark, 20_000).cache()
    base = settled(an.fit_baseline(rows, ["a", "b"], min_rows=5), "baseline")
    assert base.select("phase").distinct().count() == 20_000
    found = []
    for limit in ("-1", "104857600"):
        with conf(spark, spark__sql__autoBroadcastJoinThreshold=limit):
            stats = an.phase_channel_stats(rows, base, ["a", "b"], min_rows=5)
            plan = executed_plan(an._with_z(rows, base, ["a", "b"], "phase"))
            assert ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan) == (limit == "-1")
            found.append((stats.count(), stats.agg(F.sum(F.xxhash64("flight_id", "phase", "channel", "n", "n_flagged", F.round("max_z", 9))
                                                               .cast("decimal(38)"))).first()[0]))
            flags = an.anomaly_timeline(rows, base, ["a", "b"], min_rows=5)
            found[-1] += (flags.count(), flags.agg(F.sum("flag")).first()[0])
    assert found[0] == found[1] and found[0][0] == 2 * 20_000 and found[0][2] == rows.count()
    rows.unpersist()


def test_rows_without_a_phase_stay(spark):
    rows = phase_rows(spark, 4)
    base = an.fit_baseline(rows, ["a", "b"], min_rows=5)
    want = rows.groupBy("phase").agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.avg("b").alias("mb"), F.stddev_pop("b").alias("sb"))
    got = {(r.phase, r.channel): (r["mean"], r["std"], r.n_rows) for r in base.collect()}
    assert len(got) == 8
    for r in want.collect():
        assert got[r.phase, "a"] == pytest.approx((r.m, r.s, 40), rel=1e-7) and got[r.phase, "b"] == pytest.approx((r.mb, r.sb, 40), rel=1e-9)
    stats = an.phase_channel_stats(rows, base, ["a", "b"], min_rows=5)
    assert stats.where("phase is null").count() == 2 * rows.where("phase is null").select("flight_id").distinct().count()
    line = an.anomaly_timeline(rows, base, ["a", "b"], min_rows=5, z_threshold=1.0)
    assert line.count() == rows.count()
    z = rows.join(want, rows["phase"].eqNullSafe(want["phase"])).select(
        "t", F.coalesce((F.abs(F.col("a") - F.col("m")) / F.col("s") > 1) | (F.abs(F.col("b") - F.col("mb")) / F.col("sb") > 1), F.lit(False)).cast("int").alias("f"),
        (F.abs(F.col("a") - F.col("m")) / F.col("s") > 1).cast("int").alias("fa"))
    want_flags = {r.t: max(r.f or 0, r.fa) for r in z.collect()}
    assert {r.t: r.flag for r in line.collect()} == want_flags
