"""Registered queries: sampling, exact stratified split, normalisation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import header as hd
from ..operators import split_norm as sn
from ..functions.joins import broadcast_if_small, settled
from ..session import materialize
from ..sources import tables as tb
from . import series_plans as sp
from .common import rounded
from .header_plans import HEADER_CTE

# A wide date range gives the split more flights (FIXTURES.md).
SPLIT_RANGE = 365
SAMPLE_N = 50
NORM_CHANNELS = tb.LINEITEM_CHANNELS + dims.DERIVED_CHANNELS


def _labelled_wide(spark, sf):
    return hd.construct_labels(hd.clean_header(tb.orders_header(spark, sf)), limit=SPLIT_RANGE)


def _split(spark, sf):
    return sn.stratified_split(_labelled_wide(spark, sf).select("master_index", "label_binary"),
                               "master_index", "label_binary")


def q_stratified_split(spark, sf):
    return _split(spark, sf)


def q_split_label_counts(spark, sf):
    return rounded(sn.label_counts(_split(spark, sf), label="label_binary"))


def q_seeded_sample(spark, sf):
    return sn.seeded_sample(_labelled_wide(spark, sf), "master_index", SAMPLE_N)


def q_head_n(spark, sf):
    lab = hd.construct_labels(hd.clean_header(tb.orders_header(spark, sf)))
    return rounded(sn.head_n(lab, "ingest_order", SAMPLE_N).select("master_index", "date_diff", "label_binary"))


def prepared_with_split(spark, sf):
    """Prepared flights with label and split, written once as a table (several branches read it).

    The split (one row per flight) is settled, so that its measured size, not the estimate of a plan of windows and joins,
    tells whether it is broadcast; else the prepared rows would be shuffled once more to meet it.
    """
    flights = settled(sn.stratified_split(tb.supplier_labels(spark, sf), "flight_id", "label"), "split")
    return materialize(sp.prepared(spark, sf).join(broadcast_if_small(flights), "flight_id"), "prepared")


def train_stats(spark, sf):
    p = prepared_with_split(spark, sf)
    return sn.norm_stats(p.where(F.col("split") == "train"), NORM_CHANNELS)


def normalised(spark, sf, p=None):
    """The prepared rows (``p``, or prepared here) by the train statistics; these (a row per channel) are computed once for all
    that read the rows."""
    p = prepared_with_split(spark, sf) if p is None else p
    stats = settled(sn.norm_stats(p.where(F.col("split") == "train"), NORM_CHANNELS), "stats")
    return sn.apply_zscore(p, stats, NORM_CHANNELS)


# Statistics summed over many rows differ between engines in the last bits (summation order),
# so these two outputs are compared at 4 decimals.
def q_norm_stats(spark, sf):
    return rounded(train_stats(spark, sf), 4)


def q_zscore_apply(spark, sf):
    return rounded(normalised(spark, sf).select("flight_id", "t", "split", *NORM_CHANNELS), 4)


def q_post_norm_check(spark, sf):
    return rounded(sn.post_norm_check(normalised(spark, sf), NORM_CHANNELS))


QUERIES = {
    "f_stratified_split": q_stratified_split,
    "d_split_label_counts": q_split_label_counts,
    "f_seeded_sample": q_seeded_sample,
    "f_head_n": q_head_n,
    "d_norm_stats": q_norm_stats,
    "b_zscore_apply": q_zscore_apply,
    "d_post_norm_check": q_post_norm_check,
}

# ---------------------------------------------------------------- SQL twins
WIDE_HEADER_CTE = HEADER_CTE.replace("date_diff < -30 OR date_diff > 30",
                                     f"date_diff < -{SPLIT_RANGE} OR date_diff > {SPLIT_RANGE}")


def split_sql(src: str, key: str, label: str) -> str:
    """CTE body: totals first, dealt to the labels by largest remainders; within a label by md5(seed:id), id."""
    def dealt(source: str, count: str, fraction: float, out: str) -> str:
        return f"""SELECT * EXCLUDE (fl, rest, seats), fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, k) <= seats - sum(fl) OVER ()
                     THEN 1 ELSE 0 END AS {out}
          FROM (SELECT *, ({count} * seats) // sum({count}) OVER () AS fl, ({count} * seats) % sum({count}) OVER () AS rest
                FROM (SELECT *, sum({count}) OVER () - CAST(ceil(CAST({fraction} AS DOUBLE) * sum({count}) OVER ()) AS HUGEINT) AS seats
                      FROM ({source})))"""

    counts = f"SELECT {label} AS l, coalesce('+' || CAST({label} AS VARCHAR), '-') AS k, CAST(count(*) AS HUGEINT) AS n FROM {src} GROUP BY {label}"
    train = dealt(counts, "n", sn.FIRST_FRACTION, "n_train")
    quotas = dealt(f"SELECT *, n - n_train AS temp FROM ({train})", "temp", sn.SECOND_FRACTION, "n_val")
    return f"""
  SELECT {key}, {label}, CASE WHEN r < temp - n_val THEN 'test' WHEN r < temp THEN 'val' ELSE 'train' END AS split
  FROM (SELECT {key}, {label},
               row_number() OVER (PARTITION BY {label}
                   ORDER BY md5('{sn.SPLIT_SEED}:' || CAST({key} AS VARCHAR)), {key}) - 1 AS r
        FROM {src}) JOIN ({quotas}) q ON q.l IS NOT DISTINCT FROM {label}"""


_CH = NORM_CHANNELS
SUPPLIER_SPLIT_CTE = f"""
sup AS (SELECT s_suppkey AS flight_id, CAST(s_acctbal < 2500 AS INTEGER) AS label FROM supplier),
ssplit AS ({split_sql('sup', 'flight_id', 'label')}),
ps AS (SELECT prep.*, ssplit.label, ssplit.split FROM prep JOIN ssplit USING (flight_id)),
ns AS (
  SELECT {', '.join(f"'{c}' AS c{i}" for i, c in enumerate(_CH))},
         {', '.join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s{i}"
                    for i, c in enumerate(_CH))}
  FROM ps WHERE split = 'train'),
zn AS (
  SELECT flight_id, t, split, {', '.join(f"({c} - m{i}) / s{i} AS {c}" for i, c in enumerate(_CH))}
  FROM ps, ns)
"""

ORACLE = {
    "f_stratified_split": f"WITH {WIDE_HEADER_CTE}, sp AS ({split_sql('hlab', 'master_index', 'label_binary')}) "
                          "SELECT * FROM sp",
    "d_split_label_counts": f"""WITH {WIDE_HEADER_CTE}, sp AS ({split_sql('hlab', 'master_index', 'label_binary')})
        SELECT split, label_binary, count(*) AS n,
               round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS pct
        FROM sp GROUP BY split, label_binary""",
    "f_seeded_sample": f"""WITH {WIDE_HEADER_CTE}
        SELECT master_index FROM (SELECT DISTINCT master_index FROM hlab)
        ORDER BY md5('{sn.SPLIT_SEED}:' || CAST(master_index AS VARCHAR)), master_index LIMIT {SAMPLE_N}""",
    "f_head_n": f"""WITH {HEADER_CTE}
        SELECT master_index, date_diff, label_binary FROM hlab ORDER BY ingest_order LIMIT {SAMPLE_N}""",
    "d_norm_stats": f"""WITH {sp.CUTPAD_CTE}, {SUPPLIER_SPLIT_CTE}
        {' UNION ALL '.join(f"SELECT c{i} AS channel, {i} AS idx, round(m{i}, 4) AS mean, round(s{i}, 4) AS std FROM ns"
                             for i in range(len(_CH)))}""",
    "b_zscore_apply": f"""WITH {sp.CUTPAD_CTE}, {SUPPLIER_SPLIT_CTE}
        SELECT flight_id, t, split, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in _CH)} FROM zn""",
    "d_post_norm_check": f"""WITH {sp.CUTPAD_CTE}, {SUPPLIER_SPLIT_CTE},
        lv AS ({' UNION ALL '.join(f'SELECT split, {c} AS v FROM zn' for c in _CH)})
        SELECT split, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std FROM lv GROUP BY split""",
}
