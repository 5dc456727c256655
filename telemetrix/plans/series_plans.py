"""Registered queries: sensor preparation (order, clip, fill, derive, cut/pad),
sensor/header joins, and long-series windows (moving average, dilated filter).

Sensor role = ``lineitem`` with injected gaps (FIXTURES.md); long series = ``events``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import chunked
from ..operators import header as hd
from ..operators import timeseries as ts
from ..session import materialize
from ..sources import tables as tb
from .common import rounded

# Chunk width used for the lineitem fill: small enough that every supplier
# spans several chunks, so the cross-chunk carry is exercised by the check.
FILL_CHUNK = 128
FILTER_WEIGHTS = (0.25, 0.5, 0.25)
FILTER_DILATIONS = (1, 2, 4, 8, 16, 32, 64, 128)
MA_WIDTH = 20
MIN_LINES = 3  # an order has one to seven lines; flights below the limit have no usable rows


def _ordered(spark, sf):
    s = tb.lineitem_sensor(spark, sf, inject_gaps=True)
    return ts.order_series(s, "flight_id", tb.LINEITEM_ORDER, max_rows=tb.CHECK_CHUNK_ROWS)


def _clipped(spark, sf):
    o = _ordered(spark, sf).where(F.col("n_rows") >= dims.MIN_FLIGHT_ROWS)
    return ts.clip_channels(o, tb.LINEITEM_CLIP)


def _filled(spark, sf):
    return ts.fill_gaps(_clipped(spark, sf), tb.LINEITEM_CHANNELS, chunk_steps=FILL_CHUNK)


def q_dense_order(spark, sf):
    return _ordered(spark, sf).select("flight_id", "t", "n_rows", "l_orderkey", "l_linenumber", "l_partkey")


def q_clip_channels(spark, sf):
    return rounded(_clipped(spark, sf).select("flight_id", "t", *tb.LINEITEM_CHANNELS))


def q_ffill_bfill(spark, sf):
    return rounded(_filled(spark, sf).select("flight_id", "t", *tb.LINEITEM_CHANNELS))


def q_derived_channels(spark, sf):
    d = ts.derive_channels(_filled(spark, sf), **tb.LINEITEM_DERIVE)
    return rounded(d.select("flight_id", "t", *dims.DERIVED_CHANNELS))


def prepared(spark, sf):
    s = tb.lineitem_sensor(spark, sf, inject_gaps=True)
    return ts.prepare_flights(s, tb.LINEITEM_CHANNELS, tb.LINEITEM_ORDER, None, tb.LINEITEM_CLIP,
                              tb.LINEITEM_DERIVE, n_steps=tb.LINEITEM_N)


def q_cut_pad(spark, sf):
    return rounded(prepared(spark, sf))


def _clean_header(spark, sf):
    return hd.clean_header(tb.orders_header(spark, sf))


def _order_lines(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("master_index"), "l_linenumber",
                     F.col("l_quantity").cast("double").alias("qty"))


def q_semi_join_sensor(spark, sf):
    kept = ts.semi_join_flights(_order_lines(spark, sf), _clean_header(spark, sf), key="master_index")
    return kept.groupBy("master_index").agg(F.count(F.lit(1)).alias("n_rows"))


def q_missing_flights(spark, sf):
    return ts.missing_flights(_clean_header(spark, sf), _order_lines(spark, sf), key="master_index",
                              min_rows=MIN_LINES).select("master_index")


def q_sensor_header_join(spark, sf):
    """Sensor rows inner-joined to the labelled header (one join, no batching)."""
    lab = hd.construct_labels(_clean_header(spark, sf)).select("master_index", "label_binary")
    return rounded(_order_lines(spark, sf).join(lab, "master_index"))


def _events_ordered(spark, sf):
    """Ordered event series, written once: every downstream helper reads it twice (row-level
    window + chunk summary), and stacked helpers would otherwise re-run the ordering each time."""
    e = tb.events_series(spark, sf)
    return materialize(ts.order_series(e, "flight_id", tb.EVENTS_ORDER), "events")


def q_moving_average(spark, sf):
    e = _events_ordered(spark, sf)
    out = ts.moving_average(e, ["value"], width=MA_WIDTH, chunk_steps=16)
    return rounded(out.select("flight_id", "t", "value", "value_ma"))


def q_causal_dilated_filter(spark, sf):
    e = _events_ordered(spark, sf)
    out = ts.causal_dilated_filter(e, "value", FILTER_WEIGHTS, FILTER_DILATIONS, chunk_steps=512)
    return rounded(out.select("flight_id", "t", *[f"value_d{d}" for d in FILTER_DILATIONS]))


def q_dimension_lookup(spark, sf):
    return tb.lineitem_dimensions(spark, sf)


QUERIES = {
    "c_dimension_lookup": q_dimension_lookup,
    "e_dense_order": q_dense_order,
    "b_clip_channels": q_clip_channels,
    "e_ffill_bfill": q_ffill_bfill,
    "b_derived_channels": q_derived_channels,
    "e_cut_pad": q_cut_pad,
    "c_semi_join_sensor": q_semi_join_sensor,
    "c_missing_flights": q_missing_flights,
    "c_sensor_header_join": q_sensor_header_join,
    "e_moving_average": q_moving_average,
    "e_causal_dilated_filter": q_causal_dilated_filter,
}

# ---------------------------------------------------------------- SQL twins
PREP_CTE = """
gs AS (
  SELECT l_suppkey AS flight_id, l_shipdate, l_orderkey, l_linenumber, l_partkey,
         CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS qty,
         CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) END AS price,
         CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE CAST(l_discount AS DOUBLE) END AS disc,
         CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE CAST(l_tax AS DOUBLE) END AS tax
  FROM lineitem),
o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY flight_id
                 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS INTEGER) AS t,
         CAST(count(*) OVER (PARTITION BY flight_id) AS INTEGER) AS n_rows
  FROM gs),
c AS (
  SELECT flight_id, t, n_rows,
         CASE WHEN qty IS NULL THEN NULL ELSE least(greatest(qty, 5.0), 45.0) END AS qty, price, disc, tax
  FROM o WHERE n_rows >= 10),
f AS (
  SELECT flight_id, t, n_rows,
    coalesce(last_value(qty IGNORE NULLS) OVER wf, first_value(qty IGNORE NULLS) OVER wb, 0.0) AS qty,
    coalesce(last_value(price IGNORE NULLS) OVER wf, first_value(price IGNORE NULLS) OVER wb, 0.0) AS price,
    coalesce(last_value(disc IGNORE NULLS) OVER wf, first_value(disc IGNORE NULLS) OVER wb, 0.0) AS disc,
    coalesce(last_value(tax IGNORE NULLS) OVER wf, first_value(tax IGNORE NULLS) OVER wb, 0.0) AS tax
  FROM c
  WINDOW wf AS (PARTITION BY flight_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wb AS (PARTITION BY flight_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
d0 AS (
  SELECT *, (qty + disc + tax + price) / 4.0 AS cht_mean, (price + qty + tax + tax) / 4.0 AS egt_mean FROM f),
d AS (
  SELECT flight_id, t, n_rows, qty, price, disc, tax,
         greatest(qty, disc, tax, price) - least(qty, disc, tax, price) AS cht_spread, cht_mean,
         price - qty AS cht4_minus_cht1,
         greatest(price, qty, tax) - least(price, qty, tax) AS egt_spread, egt_mean,
         egt_mean - cht_mean AS egt_cht_divergence, disc - tax AS fqty_imbalance,
         CASE WHEN qty > 25.0 AND price > 40000.0 THEN 1.0 ELSE 0.0 END AS is_cruise
  FROM d0)
"""

_CH = ["qty", "price", "disc", "tax"]
_DER = dims.DERIVED_CHANNELS
_R = lambda cols: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)

CUTPAD_CTE = PREP_CTE + f""",
kept AS (SELECT flight_id, CAST(t + {tb.LINEITEM_N} - n_rows AS INTEGER) AS t, {', '.join(_CH + _DER)},
                false AS is_pad FROM d WHERE t + {tb.LINEITEM_N} - n_rows >= 0),
lens AS (SELECT DISTINCT flight_id, n_rows FROM d WHERE n_rows < {tb.LINEITEM_N}),
padg AS (SELECT flight_id, unnest(range(0, {tb.LINEITEM_N} - n_rows)) AS g FROM lens),
prep AS (
  SELECT * FROM kept UNION ALL
  SELECT flight_id, CAST(g AS INTEGER) AS t, {', '.join(f'0.0 AS {c}' for c in _CH + _DER)}, true AS is_pad
  FROM padg)
"""

EVENTS_CTE = """
e AS (
  SELECT user_id AS flight_id, CAST(value AS DOUBLE) AS value,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t
  FROM events)
"""


def _filter_sql() -> str:
    outs = []
    for d in FILTER_DILATIONS:
        terms = []
        for i, w in enumerate(FILTER_WEIGHTS):
            lag = (len(FILTER_WEIGHTS) - 1 - i) * d
            x = "value" if lag == 0 else f"lag(value, {lag}, 0.0) OVER (PARTITION BY flight_id ORDER BY t)"
            terms.append(f"{w} * {x}")
        outs.append(f"round({' + '.join(terms)}, 6) AS value_d{d}")
    return f"WITH {EVENTS_CTE} SELECT flight_id, t, {', '.join(outs)} FROM e"




def _hdr():
    from .header_plans import HEADER_CTE
    return HEADER_CTE

ORACLE = {
    "c_dimension_lookup": """
        SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey AS flight_id,
               coalesce(p.p_name, CAST(l.l_partkey AS VARCHAR)) AS part_name,
               coalesce(n.n_name, CAST(s.s_nationkey AS VARCHAR)) AS nation_name,
               coalesce(r.r_name, 'unknown') AS region_name
        FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
        LEFT JOIN part p ON p.p_partkey = l.l_partkey
        LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
        LEFT JOIN region r ON r.r_regionkey = coalesce(n.n_regionkey, -1)""",
    "e_dense_order": f"WITH {PREP_CTE} SELECT flight_id, t, n_rows, l_orderkey, l_linenumber, l_partkey FROM o",
    "b_clip_channels": f"WITH {PREP_CTE} SELECT flight_id, t, {_R(_CH)} FROM c",
    "e_ffill_bfill": f"WITH {PREP_CTE} SELECT flight_id, t, {_R(_CH)} FROM f",
    "b_derived_channels": f"WITH {PREP_CTE} SELECT flight_id, t, {_R(_DER)} FROM d",
    "e_cut_pad": f"WITH {CUTPAD_CTE} SELECT flight_id, t, {_R(_CH + _DER)}, is_pad FROM prep",
    "c_semi_join_sensor": f"""WITH {_hdr()}
        SELECT l_orderkey AS master_index, count(*) AS n_rows FROM lineitem
        WHERE l_orderkey IN (SELECT master_index FROM hclean) GROUP BY l_orderkey""",
    "c_missing_flights": f"""WITH {_hdr()}
        SELECT master_index FROM hclean WHERE master_index NOT IN
            (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= {MIN_LINES})""",
    "c_sensor_header_join": f"""WITH {_hdr()}
        SELECT l_orderkey AS master_index, l_linenumber, round(CAST(l_quantity AS DOUBLE), 6) AS qty, label_binary
        FROM lineitem JOIN hlab ON l_orderkey = master_index""",
    "e_moving_average": f"""WITH {EVENTS_CTE}
        SELECT flight_id, t, round(value, 6) AS value,
               round(coalesce(sum(value) OVER (PARTITION BY flight_id ORDER BY t
                     ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), 0.0) / 20.0, 6) AS value_ma FROM e""",
    "e_causal_dilated_filter": _filter_sql(),
}
