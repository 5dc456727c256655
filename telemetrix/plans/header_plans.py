"""Registered queries: header cleaning, labels and header statistics.

Header role = ``orders`` + a per-customer maintenance day (FIXTURES.md),
with duplicated rows appended in a later ingest order.
"""

from __future__ import annotations

from ..functions import dims
from ..operators import header as hd
from ..sources import tables as tb
from .common import rounded


def _raw(spark, sf):
    return tb.orders_header(spark, sf)


def _clean(spark, sf):
    return hd.clean_header(_raw(spark, sf))


def _labelled(spark, sf):
    return hd.construct_labels(_clean(spark, sf))


def q_header_dedup(spark, sf):
    return rounded(hd.dedup_keep_first(_raw(spark, sf)))


def q_header_clean(spark, sf):
    return rounded(_clean(spark, sf))


def q_construct_labels(spark, sf):
    return rounded(_labelled(spark, sf))


def q_value_counts(spark, sf):
    return rounded(hd.value_counts(_clean(spark, sf), ["before_after", "hierarchy", "label"]))


def q_duplicate_groups(spark, sf):
    return hd.duplicate_groups(_raw(spark, sf))


def q_crosstab(spark, sf):
    return hd.crosstab(_labelled(spark, sf))


def q_null_counts(spark, sf):
    return hd.null_counts(_raw(spark, sf).drop("ingest_order"))


def q_step_audit(spark, sf):
    return rounded(hd.cleaning_audit(_raw(spark, sf)))


def q_label_sweep(spark, sf):
    return rounded(hd.label_sweep(_labelled(spark, sf)))


def q_dataset_profile(spark, sf):
    return rounded(hd.dataset_profile(_raw(spark, sf), tb.lineitem_sensor(spark, sf)))


QUERIES = {
    "b_header_dedup": q_header_dedup,
    "b_header_clean": q_header_clean,
    "b_construct_labels": q_construct_labels,
    "d_value_counts": q_value_counts,
    "d_duplicate_groups": q_duplicate_groups,
    "d_crosstab": q_crosstab,
    "d_null_counts": q_null_counts,
    "d_step_audit": q_step_audit,
    "d_label_sweep": q_label_sweep,
    "d_dataset_profile": q_dataset_profile,
}

# ---------------------------------------------------------------- SQL twins
_LABEL_CASE = "CASE label " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in dims.LABEL_HIERARCHY.items()) + " END"

HEADER_CTE = f"""
maint AS (
  SELECT o_custkey, o_orderdate AS maint_date FROM (
    SELECT o_custkey, o_orderdate,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
    FROM orders) WHERE rn = 1),
h0 AS (
  SELECT o.o_orderkey AS master_index,
         CAST(datediff('day', CAST(m.maint_date AS DATE), CAST(o.o_orderdate AS DATE)) AS INTEGER) AS date_diff,
         CAST(o.o_totalprice AS DOUBLE) / 10.0 AS flight_length, o.o_orderpriority AS label,
         nullif(o.o_orderstatus, 'P') AS hierarchy, o.o_orderkey AS ingest_order
  FROM orders o JOIN maint m USING (o_custkey)),
h1 AS (
  SELECT master_index,
         CASE WHEN date_diff < 0 THEN 'before' WHEN date_diff = 0 THEN 'same' ELSE 'after' END AS before_after,
         date_diff, flight_length, label, hierarchy, ingest_order FROM h0),
hraw AS (
  SELECT * FROM h1 UNION ALL
  SELECT master_index, before_after, date_diff, flight_length, label, hierarchy, ingest_order + 1000000000000
  FROM h1 WHERE master_index % 5 = 0),
hdd AS (
  SELECT master_index, before_after, date_diff, flight_length, label, hierarchy, ingest_order FROM (
    SELECT *, row_number() OVER (PARTITION BY before_after, date_diff, flight_length, label, hierarchy
                                 ORDER BY ingest_order) AS rn FROM hraw) WHERE rn = 1),
hclean AS (
  SELECT master_index, before_after, date_diff, CAST(flight_length AS FLOAT) AS flight_length, label,
         coalesce(hierarchy, {_LABEL_CASE}, 'other') AS hierarchy, ingest_order,
         coalesce(CAST(flight_length AS FLOAT) > 19800, false) AS beyond_endurance
  FROM hdd WHERE flight_length >= 1800),
hlab AS (
  SELECT *, CAST(coalesce(date_diff <= -2, false) AS TINYINT) AS label_binary,
         CASE WHEN before_after = 'before' THEN CAST(abs(date_diff) AS DOUBLE) END AS days_to_maintenance
  FROM hclean
  WHERE before_after IS DISTINCT FROM 'same' AND NOT coalesce(date_diff < -30 OR date_diff > 30, false))
"""

_FL = "round(CAST(flight_length AS DOUBLE), 6) AS flight_length"

ORACLE = {
    "b_header_dedup": f"""WITH {HEADER_CTE}
        SELECT master_index, before_after, date_diff, {_FL}, label, hierarchy, ingest_order FROM hdd""",
    "b_header_clean": f"""WITH {HEADER_CTE}
        SELECT master_index, before_after, date_diff, {_FL}, label, hierarchy, ingest_order, beyond_endurance
        FROM hclean""",
    "b_construct_labels": f"""WITH {HEADER_CTE}
        SELECT master_index, before_after, date_diff, {_FL}, label, hierarchy, ingest_order, beyond_endurance,
               label_binary, days_to_maintenance FROM hlab""",
    "d_value_counts": f"""WITH {HEADER_CTE},
        u AS (SELECT 'before_after' AS field, CAST(before_after AS VARCHAR) AS value, count(*) AS count
              FROM hclean WHERE before_after IS NOT NULL GROUP BY 2
              UNION ALL SELECT 'hierarchy', hierarchy, count(*) FROM hclean WHERE hierarchy IS NOT NULL GROUP BY 2
              UNION ALL SELECT 'label', label, count(*) FROM hclean WHERE label IS NOT NULL GROUP BY 2)
        SELECT field, value, count, round(count * 100.0 / sum(count) OVER (PARTITION BY field), 6) AS pct FROM u""",
    "d_duplicate_groups": f"""WITH {HEADER_CTE},
        g AS (SELECT before_after, count(*) AS n FROM hraw
              GROUP BY before_after, date_diff, flight_length, label, hierarchy HAVING count(*) > 1)
        SELECT before_after, CAST(sum(n) AS BIGINT) AS n_duplicate_rows FROM g GROUP BY before_after""",
    "d_crosstab": f"""WITH {HEADER_CTE}
        SELECT before_after, CAST(count(*) FILTER (WHERE label_binary = 0) AS BIGINT) AS label_binary_0,
               CAST(count(*) FILTER (WHERE label_binary = 1) AS BIGINT) AS label_binary_1
        FROM hlab GROUP BY before_after""",
    "d_null_counts": f"""WITH {HEADER_CTE},
        a AS (SELECT count(*) - count(master_index) AS c0, count(*) - count(before_after) AS c1,
                     count(*) - count(date_diff) AS c2, count(*) - count(flight_length) AS c3,
                     count(*) - count(label) AS c4, count(*) - count(hierarchy) AS c5 FROM hraw)
        SELECT 'master_index' AS "column", CAST(c0 AS BIGINT) AS n_null FROM a
        UNION ALL SELECT 'before_after', c1 FROM a UNION ALL SELECT 'date_diff', c2 FROM a
        UNION ALL SELECT 'flight_length', c3 FROM a UNION ALL SELECT 'label', c4 FROM a
        UNION ALL SELECT 'hierarchy', c5 FROM a
        UNION ALL SELECT '__total__', c0 + c1 + c2 + c3 + c4 + c5 FROM a""",
    "d_step_audit": f"""WITH {HEADER_CTE},
        c AS (SELECT 0 AS step_ord, 'raw' AS step, count(*) AS rows FROM hraw
              UNION ALL SELECT 1, 'dedup', count(*) FROM hdd
              UNION ALL SELECT 2, 'length_filter', count(*) FROM hdd WHERE flight_length >= 1800
              UNION ALL SELECT 3, 'drop_same', count(*) FROM hclean WHERE before_after IS DISTINCT FROM 'same'
              UNION ALL SELECT 4, 'date_range', count(*) FROM hlab)
        SELECT step_ord, step, lag(rows) OVER (ORDER BY step_ord) AS rows_in, rows AS rows_out,
               lag(rows) OVER (ORDER BY step_ord) - rows AS dropped,
               round(rows * 100.0 / lag(rows) OVER (ORDER BY step_ord), 6) AS retention_pct FROM c""",
    "d_label_sweep": f"""WITH {HEADER_CTE}
        SELECT t.threshold, round(avg(CASE WHEN date_diff <= t.threshold THEN 1.0 ELSE 0.0 END), 6) AS at_risk_share
        FROM hlab, (VALUES (-2), (-3), (-5)) AS t(threshold) GROUP BY t.threshold""",
    "d_dataset_profile": f"""WITH {HEADER_CTE}
        SELECT count(DISTINCT master_index) AS n_flights, round(sum(flight_length) / 3600.0, 6) AS flight_hours,
               count(DISTINCT label) AS issue_types, (SELECT count(*) FROM lineitem) AS sensor_rows FROM hraw""",
}
