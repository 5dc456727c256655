"""Adapters from the given Parquet tables to the library's roles.

The library's operators work on a *header* table (one row per flight), a
wide *sensor* table (one row per flight and step) and a *scored* table.
These adapters give those roles to the TPC-H-like test tables, as
described in FIXTURES.md, so that every registered query reads real
tables and grows with them.  All are lazy projections; Catalyst prunes
columns and pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import sigmoid
from ..functions.joins import broadcast_if_small, lookup_with_fallback

# --------------------------------------------------------------------------
# Fixed values of the test mapping (FIXTURES.md).
# --------------------------------------------------------------------------
LINEITEM_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
LINEITEM_CHANNELS = ["qty", "price", "disc", "tax"]
LINEITEM_PHASES = dims.PhaseSpec(ias="qty", alt="price", cruise_ias=25.0, cruise_alt=40000.0,
                                 taxi_ias=12.0, taxi_alt=20000.0)
LINEITEM_CLIP = {"qty": (5.0, 45.0)}
LINEITEM_Z = 1.7
LINEITEM_N = 600
AT_RISK_ACCTBAL = 2500.0
GAP_MODULUS = 7
DUPLICATE_MODULUS = 5
INGEST_SHIFT = 1_000_000_000_000
#: Rows of a chunk in the registered ordered scan: small enough that every supplier spans several.
CHECK_CHUNK_ROWS = 200
EVENTS_ORDER = ["ts", "event_id"]
EVENTS_CHANNELS = ["value", "k"]
EVENTS_MIN_PHASE_ROWS = 10
# --------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_channels() -> dims.ChannelSet:
    """qty / price play airspeed / altitude (pilot channels); disc / tax are maintenance channels."""
    return dims.ChannelSet((
        dims.Channel("qty", pilot=True, display=False, clip=LINEITEM_CLIP["qty"]),
        dims.Channel("price", pilot=True),
        dims.Channel("disc", maintenance=True, display=True, group="fuel"),
        dims.Channel("tax", maintenance=True, display=True, group="engine"),
    ))


def lineitem_prepared_channels() -> dims.ChannelSet:
    """The four lineitem channels plus the eight derived channels (cylinder/exhaust groups map onto them)."""
    base = list(lineitem_channels().channels)
    derived = [
        dims.Channel("cht_spread", maintenance=True, display=True, group="cylinder"),
        dims.Channel("cht_mean", maintenance=True, group="cylinder"),
        dims.Channel("cht4_minus_cht1", maintenance=True, group="cylinder"),
        dims.Channel("egt_spread", maintenance=True, display=True, group="combustion"),
        dims.Channel("egt_mean", maintenance=True, group="combustion"),
        dims.Channel("egt_cht_divergence", maintenance=True, display=True, group="combustion"),
        dims.Channel("fqty_imbalance", maintenance=True, display=True, group="fuel"),
        dims.Channel("is_cruise", skip=True),
    ]
    return dims.ChannelSet(tuple(base + derived))


# Which lineitem channels stand in for the cylinder / exhaust / fuel-tank sensors
# of the derived-channel operator.
LINEITEM_DERIVE = dict(cht=("qty", "disc", "tax", "price"), egt=("price", "qty", "tax", "tax"),
                       fqty=("disc", "tax"), ias="qty", alt="price",
                       cruise_ias=LINEITEM_PHASES.cruise_ias, cruise_alt=LINEITEM_PHASES.cruise_alt)


def lineitem_sensor(spark: SparkSession, sf_dir: str, inject_gaps: bool = False) -> DataFrame:
    """Sensor role: one row per (flight = supplier, line), four channels."""
    li = _read(spark, sf_dir, "lineitem")
    gap = ((F.col("l_orderkey") + F.col("l_linenumber")) % GAP_MODULUS) == 0
    chans = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}
    cols = [F.col("l_suppkey").alias("flight_id"), *[F.col(c) for c in LINEITEM_ORDER]]
    for name, src in chans.items():
        v = F.col(src).cast("double")
        cols.append((F.when(~gap, v) if inject_gaps else v).alias(name))
    return li.select(*cols)


def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flight_id, label: supplier at risk when its account balance is below 2500."""
    s = _read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("flight_id"),
                    (F.col("s_acctbal") < F.lit(AT_RISK_ACCTBAL)).cast("int").alias("label"))


def orders_header(spark: SparkSession, sf_dir: str, with_duplicates: bool = True) -> DataFrame:
    """Header role from orders: master_index, before_after, date_diff, flight_length, label,
    hierarchy, plus ``ingest_order`` (the raw file order used by keep-first dedup)."""
    o = _read(spark, sf_dir, "orders")
    # Maintenance day per customer: date of the most expensive order, ties to the smallest key.
    # two hash aggregates (no struct-ordered buffer): the largest price per customer, then among
    # the orders at that price the date of the smallest key
    top = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("_mp"))
    at_top = o.join(broadcast_if_small(top), "o_custkey").where(F.col("o_totalprice") == F.col("_mp"))
    maint = at_top.groupBy("o_custkey").agg(F.min_by("o_orderdate", "o_orderkey").alias("maint_date"))
    j = o.join(broadcast_if_small(maint), "o_custkey")
    dd = F.datediff(F.to_date("o_orderdate"), F.to_date("maint_date"))
    hdr = j.select(
        F.col("o_orderkey").alias("master_index"),
        F.when(dd < 0, "before").when(dd == 0, "same").otherwise("after").alias("before_after"),
        dd.cast("int").alias("date_diff"),
        (F.col("o_totalprice") / F.lit(10.0)).cast("double").alias("flight_length"),
        F.col("o_orderpriority").alias("label"),
        F.expr("nullif(o_orderstatus, 'P')").alias("hierarchy"),
        F.col("o_orderkey").alias("ingest_order"),
    )
    if not with_duplicates:
        return hdr
    shifts = F.when((F.col("master_index") % DUPLICATE_MODULUS) == 0, F.array(F.lit(0), F.lit(INGEST_SHIFT))).otherwise(
        F.array(F.lit(0)))  # the second copy of a row comes from the row itself, not from a second pass
    return (hdr.withColumn("_shift", F.explode(shifts))
            .withColumn("ingest_order", F.col("ingest_order") + F.col("_shift")).drop("_shift"))


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-series role: flight = user, phase = event type, channels value and props.k."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("flight_id"), "ts", "event_id",
        F.col("event_type").alias("phase"),
        F.col("value").cast("double").alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored-flight role: flight_id, label (toxic), logit and prob from n_chars."""
    lab = _read(spark, sf_dir, "labels")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    logit = (F.col("n_chars").cast("double") - F.lit(1000.0)) / F.lit(1000.0)
    return j.select(F.col("doc_id").alias("flight_id"), F.col("toxic").cast("int").alias("label"),
                    logit.alias("logit"), sigmoid(logit).alias("prob"))


def lineitem_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension role: sensor rows with part, nation and region names, each with a fallback."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("flight_id"),
                                                 "l_partkey")
    sup = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    j = li.join(broadcast_if_small(sup), li["flight_id"] == sup["s_suppkey"], "left").drop("s_suppkey")
    j = lookup_with_fallback(j, _read(spark, sf_dir, "part"), "l_partkey", "p_partkey", "p_name", "part_name")
    j = lookup_with_fallback(j, nation, "s_nationkey", "n_nationkey", "n_name", "nation_name")
    nat_region = nation.select("n_nationkey", "n_regionkey")
    j = lookup_with_fallback(j, nat_region, "s_nationkey", "n_nationkey", "n_regionkey", "_region_key", F.lit(-1))
    j = lookup_with_fallback(j, region, "_region_key", "r_regionkey", "r_name", "region_name", "unknown")
    return j.select("l_orderkey", "l_linenumber", "flight_id", "part_name", "nation_name", "region_name")
