"""Flight-header cleaning and label construction.

Every step is a projection, a filter or a partial-aggregating group-by.
Keep-first dedup is a ``groupBy(all attributes)`` with ``min_by(key, order)``
rather than a window over the attributes, so a duplicate group holding a
large share of the rows is combined map-side instead of landing in one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import is_true

HEADER_ATTRS = ["before_after", "date_diff", "flight_length", "label", "hierarchy"]


def _attrs(df: DataFrame, key: str, order: str) -> list[str]:
    return [c for c in df.columns if c not in (key, order)]


def dedup_keep_first(df: DataFrame, key: str = "master_index", order: str = "ingest_order") -> DataFrame:
    """B1: drop rows whose non-key attributes equal an earlier row's (NULLs equal), keep the first."""
    attrs = _attrs(df, key, order)
    # min_by / min keep fixed-width buffers, so this stays a hash aggregate with map-side combine
    return (df.groupBy(*attrs).agg(F.min_by(key, order).alias(key), F.min(order).alias(order))
            .select(key, *attrs, order))


def impute_hierarchy(df: DataFrame, label: str = "label", hierarchy: str = "hierarchy") -> DataFrame:
    """Keep hierarchy if present, else map the label, else 'other' (36-entry broadcast dim)."""
    dim = dims.label_dim(df.sparkSession).withColumnRenamed("label", "_dim_label")
    j = df.join(F.broadcast(dim), df[label] == dim["_dim_label"], "left")
    return (j.withColumn(hierarchy, F.coalesce(F.col(hierarchy), F.col("dim_hierarchy"), F.lit("other")))
            .drop("_dim_label", "dim_hierarchy"))


def narrow_types(df: DataFrame) -> DataFrame:
    """int32 day/count columns, float32 length; categories stay strings."""
    out = df
    for c in ("date_diff", "number_flights_before"):
        if c in df.columns:
            out = out.withColumn(c, F.col(c).cast("int"))
    if "flight_length" in df.columns:
        out = out.withColumn("flight_length", F.col("flight_length").cast("float"))
    return out


def clean_header(df: DataFrame, key: str = "master_index", order: str = "ingest_order",
                 min_length: float = dims.MIN_FLIGHT_LENGTH,
                 endurance: float = dims.ENDURANCE_LIMIT) -> DataFrame:
    """B1 + B7 + B2 + B8, with the B25 endurance flag kept as a column."""
    d = impute_hierarchy(dedup_keep_first(df, key, order))
    d = d.where(is_true(F.col("flight_length") >= F.lit(float(min_length))))
    d = narrow_types(d)
    return d.withColumn("beyond_endurance", is_true(F.col("flight_length") > F.lit(float(endurance))))


def construct_labels(df: DataFrame, limit: int = dims.DATE_DIFF_LIMIT,
                     rul_threshold: int = dims.RUL_THRESHOLD) -> DataFrame:
    """B3 drop 'same' (missing kept), B4 drop |date_diff| > limit, B5 binary label
    date_diff <= threshold, B6 days to maintenance for 'before' rows."""
    dd = F.col("date_diff")
    out = (df.where(~F.col("before_after").eqNullSafe("same"))
           .where(~is_true((dd < F.lit(-limit)) | (dd > F.lit(limit)))))
    return (out.withColumn("label_binary", is_true(dd <= F.lit(rul_threshold)).cast("tinyint"))
            .withColumn("days_to_maintenance",
                        F.when(F.col("before_after") == "before", F.abs(dd).cast("double"))))


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field and value: count and percentage of non-missing rows (missing dropped)."""
    # one pass: every row gives one (field, value) pair per field, counted with map-side combine
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    u = (df.select(F.explode(pairs).alias("_x")).select("_x.*").where("value is not null")
         .groupBy("field", "value").agg(F.count(F.lit(1)).alias("count")))
    tot = F.sum("count").over(Window.partitionBy("field"))
    return u.select("field", "value", "count", (F.col("count") * 100.0 / tot).alias("pct"))


def duplicate_groups(df: DataFrame, by: str = "before_after", key: str = "master_index",
                     order: str = "ingest_order") -> DataFrame:
    """Number of rows that belong to duplicate groups, per ``by`` value."""
    attrs = _attrs(df, key, order)
    g = df.groupBy(*attrs).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return g.groupBy(by).agg(F.sum("_n").cast("long").alias("n_duplicate_rows"))


def crosstab(df: DataFrame, row: str = "before_after", col: str = "label_binary") -> DataFrame:
    """D3: counts of ``row`` x binary ``col`` as two columns (0-filled)."""
    p = df.groupBy(row).pivot(col, [0, 1]).count()
    return p.select(row, F.coalesce(F.col("0"), F.lit(0)).cast("long").alias(f"{col}_0"),
                    F.coalesce(F.col("1"), F.lit(0)).cast("long").alias(f"{col}_1"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, plus a '__total__' row."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"_n{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"_n{i}"), F.lit(0)).alias("n_null"))
             for i, c in enumerate(cols)]
    total = F.struct(F.lit("__total__").alias("column"),
                     sum((F.coalesce(F.col(f"_n{i}"), F.lit(0)) for i in range(len(cols))), F.lit(0))
                     .alias("n_null"))
    return agg.select(F.explode(F.array(*items, total)).alias("_x")).select(
        "_x.column", F.col("_x.n_null").cast("long").alias("n_null"))


def cleaning_audit(df: DataFrame, key: str = "master_index", order: str = "ingest_order",
                   min_length: float = dims.MIN_FLIGHT_LENGTH, limit: int = dims.DATE_DIFF_LIMIT) -> DataFrame:
    """Rows in and out of each cleaning step (dedup, length, 'same' rows, date range), dropped rows and retention.

    One pass: duplicate groups carry their number of rows, and the filters, which follow one another, are counted as nested
    conditions over the groups, so raw rows are read and shuffled once however many steps are audited.  (Observed metrics would
    also take one pass, but count rows again that a lost executor's tasks had already counted.)
    """
    groups = df.groupBy(*_attrs(df, key, order)).agg(F.count(F.lit(1)).alias("_copies"))
    dd = F.col("date_diff").cast("int")
    conditions = [("length_filter", is_true(F.col("flight_length") >= F.lit(float(min_length)))),
                  ("drop_same", ~F.col("before_after").eqNullSafe("same")),
                  ("date_range", ~is_true((dd < F.lit(-limit)) | (dd > F.lit(limit))))]
    counts, kept = [("raw", F.coalesce(F.sum("_copies"), F.lit(0))), ("dedup", F.count(F.lit(1)))], F.lit(True)
    for name, condition in conditions:
        kept = kept & condition
        counts.append((name, F.count(F.when(kept, 1))))
    return step_audit(groups.agg(*[c.alias(n) for n, c in counts]), [n for n, _ in counts])


def step_audit(counts: DataFrame, steps: Sequence[str]) -> DataFrame:
    """step_ord, step, rows_in, rows_out, dropped, retention_pct from one row with the rows after each step."""
    rows = [F.struct(F.lit(i).alias("step_ord"), F.lit(n).alias("step"),
                     (F.col(steps[i - 1]) if i else F.lit(None)).cast("long").alias("rows_in"), F.col(n).cast("long").alias("rows_out"))
            for i, n in enumerate(steps)]
    out = counts.select(F.explode(F.array(*rows)).alias("_x")).select("_x.*")
    return out.select("*", (F.col("rows_in") - F.col("rows_out")).alias("dropped"),
                      F.try_divide(F.col("rows_out") * 100.0, F.col("rows_in")).alias("retention_pct"))


def label_sweep(df: DataFrame, thresholds: Sequence[int] = (-2, -3, -5)) -> DataFrame:
    """At-risk share for several label thresholds (one aggregation, then unpivot)."""
    dd = F.col("date_diff")
    agg = df.agg(*[F.avg(is_true(dd <= F.lit(t)).cast("double")).alias(f"_s{i}") for i, t in enumerate(thresholds)])
    items = [F.struct(F.lit(int(t)).alias("threshold"), F.col(f"_s{i}").alias("at_risk_share"))
             for i, t in enumerate(thresholds)]
    return agg.select(F.explode(F.array(*items)).alias("_x")).select("_x.threshold", "_x.at_risk_share")


def dataset_profile(header: DataFrame, sensor: DataFrame, key: str = "master_index") -> DataFrame:
    """Flights, flight hours, sensor rows, issue types."""
    h = header.agg(F.countDistinct(key).alias("n_flights"),
                   (F.sum("flight_length") / 3600.0).alias("flight_hours"),
                   F.countDistinct("label").alias("issue_types"))
    s = sensor.agg(F.count(F.lit(1)).alias("sensor_rows"))
    return one_row_join(h, s)


def one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two single-row aggregates side by side (equi-join on a constant)."""
    return a.withColumn("_j", F.lit(1)).join(b.withColumn("_j", F.lit(1)), "_j").drop("_j")
