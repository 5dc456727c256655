"""Registered queries: sources and sinks as write/read round trips on the given tables (A1-A7, A10, H10),
column projection (B9), id fallback (C9), first-n flights (F5) and detection on event types."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..operators import drift
from ..operators import reports as rp
from ..operators import split_norm as sn
from ..operators import timeseries as ts
from ..session import scratch_path
from ..sources import io
from .common import rounded

EVENT_MIN_ROWS = 10
EVENT_Z = 1.5
FIRST_N = 7
CHANNELS = ["volt1", "e1_fflow", "ias", "oat"]


def _folder(spark, name):
    return scratch_path(spark, f"roundtrip/{name}-{uuid.uuid4().hex[:12]}")


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def q_header_csv(spark, sf):
    """A1: orders as a header CSV with shuffled columns and integers written as -3.0, read back by name."""
    o = _table(spark, sf, "orders")
    source = o.select(
        F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("Master Index"),
        F.when(F.col("o_orderkey") % 5 > 0, (F.pmod("o_custkey", F.lit(11)) - 5).cast("double")).alias("date_diff"),
        F.col("o_orderstatus").alias("before_after"), F.col("o_totalprice").alias("flight_length"),
        F.concat(F.lit("h, "), F.col("o_orderstatus")).alias("hierarchy"),
        F.pmod("o_orderkey", F.lit(4)).cast("double").alias("number_flights_before"))
    path = _folder(spark, "header")
    source.write.option("header", True).csv(path)
    return rounded(io.read_header_csv(spark, path).drop("ingest_order"))


def _sensor_source(spark, sf):
    li = _table(spark, sf, "lineitem")
    gap = (F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0
    return li.select(
        F.col("l_orderkey").alias("Master Index"), F.col("l_linenumber").alias("timestep"), F.lit("c").alias("cluster"),
        F.when(gap, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("volt1"),
        F.col("l_extendedprice").alias("E1 FFlow"), F.col("l_tax").alias("IAS"))


def q_sensor_parquet(spark, sf):
    """A2 + B9: sensor Parquet with NaN and a dropped column, in a fixed channel order; an absent channel is 0."""
    path = _folder(spark, "sensor")
    _sensor_source(spark, sf).write.parquet(path)
    return rounded(ts.project_channels(io.read_sensor_parquet(spark, path), ["flight_id", "timestep"], CHANNELS))


def q_load_data(spark, sf):
    """A3: header and sensor files as one bundle, joined by flight."""
    header, sensor = _folder(spark, "header"), _folder(spark, "sensor")
    _table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Master Index"), F.lit("x").alias("before_after"), F.lit(1.0).alias("date_diff"),
        F.col("o_totalprice").alias("flight_length"), F.lit("l").alias("label"), F.lit("h").alias("hierarchy"),
        F.lit(0).alias("number_flights_before")).write.option("header", True).csv(header)
    _sensor_source(spark, sf).write.parquet(sensor)
    both = io.load_data(spark, header, sensor)
    rows = both["sensor"].groupBy("flight_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("volt1").alias("n_volt1"))
    return rounded(both["header"].join(rows, F.col("master_index") == F.col("flight_id"))
                   .select("master_index", "flight_length", "n_rows", "n_volt1"))


def _prepared(spark, sf):
    li = _table(spark, sf, "lineitem")
    split = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "val").otherwise("test")
    return li.select(F.col("l_orderkey").alias("flight_id"), F.col("l_linenumber").alias("t"),
                     F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"),
                     F.pmod("l_orderkey", F.lit(2)).cast("int").alias("label"), split.alias("split"))


def q_prepared_split(spark, sf):
    """A4 + A6: prepared rows written by split, one split read back through partition pruning."""
    path = _folder(spark, "prepared")
    io.write_prepared(_prepared(spark, sf), path)
    return rounded(io.read_prepared(spark, path, "train").select("flight_id", "t", "qty", "tax", "label", "split"))


def q_manifest(spark, sf):
    """A5: the manifest written as JSON, read back and laid flat by split."""
    p = _prepared(spark, sf)
    path = _folder(spark, "manifest")
    io.write_manifest(io.dataset_manifest(p, sn.norm_stats(p, ["qty", "tax"]), ["qty", "tax"]), path)
    kinds = ("total_flights long, n_channels int, channels array<string>, norm_mean array<double>, norm_std array<double>, "
             "splits map<string, struct<n_flights: long, n_label_0: long, n_label_1: long>>")
    m = spark.read.schema(kinds).json(path)
    return rounded(m.select("total_flights", "n_channels", F.concat_ws(",", "channels").alias("channels"),
                            F.col("norm_mean")[0].alias("mean_qty"), F.col("norm_std")[1].alias("std_tax"),
                            F.explode("splits").alias("split", "s")).select("*", "s.*").drop("s"))


def _event_baseline(spark, sf):
    e = _table(spark, sf, "events").select(F.col("user_id").alias("flight_id"), F.col("event_type").alias("phase"), "value")
    return e, an.fit_baseline(e.where(F.col("flight_id") % 3 > 0), ["value"], min_rows=EVENT_MIN_ROWS)


def q_baseline_json(spark, sf):
    """A baseline over event types saved as JSON and loaded again."""
    path = _folder(spark, "baseline")
    io.save_baseline(_event_baseline(spark, sf)[1], path, EVENT_Z)
    rows, settings = io.load_baseline(spark, path)
    return rounded(rows.join(F.broadcast(settings)))  # one settings row


def q_event_phase_stats(spark, sf):
    """D10 with the event type as the phase: any phase names, baseline of two thirds of the users."""
    e, base = _event_baseline(spark, sf)
    st = an.phase_channel_stats(e, base, ["value"], z_threshold=EVENT_Z, min_rows=EVENT_MIN_ROWS)
    return rounded(st.drop("channel_idx"))


def q_run_log(spark, sf):
    """A10: two appended run records, read back; names without their time stamp."""
    path = _folder(spark, "runs")
    o = _table(spark, sf, "orders")
    for name, half in (("first", 0), ("second", 1)):
        m = o.where(F.col("o_orderkey") % 2 == half).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"))
        io.append_run(io.run_record(spark, name, {"half": str(half)}, m), path)
    r = spark.read.parquet(path)
    return rounded(r.select(F.substring_index("run_name", "_", 1).alias("name"), F.col("params")["half"].alias("half"),
                            F.col("metrics")["n"].alias("n"), F.col("metrics")["mean_price"].alias("mean_price")))


def q_time_text(spark, sf):
    """Time stamps as run-name text."""
    return _table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("ts_text"))


def q_id_fallback(spark, sf):
    """The id where present, else the row's place by key."""
    o = _table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("id"))
    out = rp.flight_id_fallback(o, "id", [F.col("o_orderkey")], F.floor(F.col("o_orderkey") / 1000).cast("long"))
    return out.select("o_orderkey", F.col("flight_id").cast("long").alias("flight_id"))


def q_first_n(spark, sf):
    """all rows of the n smallest flights."""
    li = _table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("flight_id"), "l_orderkey", "l_linenumber")
    return drift.first_n_flights(li, "flight_id", FIRST_N)


QUERIES = {
    "a_header_csv": q_header_csv, "a_sensor_parquet": q_sensor_parquet, "a_load_data": q_load_data,
    "a_prepared_split": q_prepared_split, "a_manifest": q_manifest, "a_baseline_json": q_baseline_json,
    "a_run_log": q_run_log, "h_time_text": q_time_text, "c_id_fallback": q_id_fallback, "f_first_n": q_first_n,
    "d_event_phase_stats": q_event_phase_stats,
}

_PREPARED = """p AS (SELECT l_orderkey AS flight_id, l_linenumber AS t, l_quantity AS qty, l_tax AS tax,
    CAST(l_orderkey % 2 AS INTEGER) AS label,
    CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'val' ELSE 'test' END AS split FROM lineitem)"""
_EVENTS = f"""e AS (SELECT user_id AS flight_id, event_type AS phase, value FROM events),
ok AS (SELECT flight_id, phase FROM e WHERE flight_id % 3 > 0 GROUP BY ALL HAVING count(*) >= {EVENT_MIN_ROWS}),
base AS (SELECT phase, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END AS std
         FROM e SEMI JOIN ok USING (flight_id, phase) GROUP BY phase)"""

ORACLE = {
    "a_header_csv": """SELECT o_orderkey AS master_index, o_orderstatus AS before_after,
        CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 11 - 5 AS INTEGER) END AS date_diff,
        round(o_totalprice, 6) AS flight_length, o_orderpriority AS label, 'h, ' || o_orderstatus AS hierarchy,
        CAST(o_orderkey % 4 AS INTEGER) AS number_flights_before FROM orders""",
    "a_sensor_parquet": """SELECT l_orderkey AS flight_id, l_linenumber AS timestep,
        CASE WHEN (l_orderkey + l_linenumber) % 7 > 0 THEN round(l_quantity, 6) END AS volt1,
        round(l_extendedprice, 6) AS e1_fflow, round(l_tax, 6) AS ias, CAST(0.0 AS DOUBLE) AS oat FROM lineitem""",
    "a_load_data": """SELECT o_orderkey AS master_index, round(any_value(o_totalprice), 6) AS flight_length, count(*) AS n_rows,
        count(CASE WHEN (l_orderkey + l_linenumber) % 7 > 0 THEN 1 END) AS n_volt1
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "a_prepared_split": f"""WITH {_PREPARED} SELECT flight_id, t, round(qty, 6) AS qty, round(tax, 6) AS tax, label, split
        FROM p WHERE split = 'train'""",
    "a_manifest": f"""WITH {_PREPARED},
        s AS (SELECT split, count(DISTINCT flight_id) AS n_flights,
                     count(DISTINCT CASE WHEN label = 1 THEN flight_id END) AS n_label_1 FROM p GROUP BY split)
        SELECT CAST((SELECT sum(n_flights) FROM s) AS BIGINT) AS total_flights, 2 AS n_channels, 'qty,tax' AS channels,
               (SELECT round(avg(qty), 6) FROM p) AS mean_qty, (SELECT round(stddev_pop(tax), 6) FROM p) AS std_tax,
               split, n_flights, n_flights - n_label_1 AS n_label_0, n_label_1 FROM s""",
    "a_baseline_json": f"""WITH {_EVENTS} SELECT phase, 'value' AS channel, round(mean, 6) AS mean, round(std, 6) AS std,
        CAST({EVENT_Z} AS DOUBLE) AS z_threshold, true AS is_fitted FROM base""",
    "a_run_log": """SELECT CASE o_orderkey % 2 WHEN 0 THEN 'first' ELSE 'second' END AS name,
        CAST(o_orderkey % 2 AS VARCHAR) AS half, CAST(count(*) AS DOUBLE) AS n, round(avg(o_totalprice), 6) AS mean_price
        FROM orders GROUP BY o_orderkey % 2""",
    "h_time_text": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS ts_text FROM events",
    "c_id_fallback": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey
        ELSE row_number() OVER (ORDER BY o_orderkey) - 1 END AS flight_id FROM orders""",
    "f_first_n": f"""SELECT l_suppkey AS flight_id, l_orderkey, l_linenumber FROM lineitem
        WHERE l_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1 LIMIT {FIRST_N})""",
    "d_event_phase_stats": f"""WITH {_EVENTS},
        st AS (SELECT flight_id, phase, count(*) AS n, sum(CASE WHEN abs((value - mean) / std) > {EVENT_Z} THEN 1 ELSE 0 END) AS nf,
                      max(abs((value - mean) / std)) AS mz FROM e JOIN base USING (phase) GROUP BY ALL HAVING count(*) >= {EVENT_MIN_ROWS})
        SELECT flight_id, 'value' AS channel, phase, n, CAST(nf AS BIGINT) AS n_flagged,
               round(CAST(nf AS DOUBLE) / n, 6) AS pct_flagged, round(mz, 6) AS max_z, CAST(nf AS DOUBLE) / n >= 0.05 AS persistent
        FROM st""",
}
