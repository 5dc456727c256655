"""Sources and sinks (A1-A10).

All readers use explicit schemas (no inference on the hot path) and
convert NaN to NULL at the scan, so every later comparison and aggregate
sees SQL NULL semantics.  Writers use Spark's Parquet / JSON sinks with
``partitionBy`` where readers filter (split), so the filter becomes
partition pruning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from ..functions.exprs import nan_to_null
from ..functions.joins import parts_for

# Source column names of the raw files (fixed values) -> library names.
HEADER_SOURCE_COLUMNS = {
    "Master Index": "master_index",
    "before_after": "before_after",
    "date_diff": "date_diff",
    "flight_length": "flight_length",
    "label": "label",
    "hierarchy": "hierarchy",
    "number_flights_before": "number_flights_before",
}

SENSOR_SOURCE_COLUMNS = {
    "Master Index": "flight_id", "timestep": "timestep", "cluster": "cluster",
    "volt1": "volt1", "volt2": "volt2", "amp1": "amp1", "amp2": "amp2",
    "FQtyL": "fqty_l", "FQtyR": "fqty_r", "E1 FFlow": "e1_fflow",
    "E1 OilT": "e1_oilt", "E1 OilP": "e1_oilp", "E1 RPM": "e1_rpm",
    "E1 CHT1": "e1_cht1", "E1 CHT2": "e1_cht2", "E1 CHT3": "e1_cht3", "E1 CHT4": "e1_cht4",
    "E1 EGT1": "e1_egt1", "E1 EGT2": "e1_egt2", "E1 EGT3": "e1_egt3", "E1 EGT4": "e1_egt4",
    "OAT": "oat", "IAS": "ias", "VSpd": "vspd", "NormAc": "normac", "AltMSL": "altmsl",
}

# Types of the header columns; integers may be written with a fraction of zero (-3.0).
HEADER_TYPES = {"master_index": "bigint", "date_diff": "int", "flight_length": "double", "number_flights_before": "int"}

BASELINE_JSON_SCHEMA = T.StructType([
    T.StructField("stats", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
        T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])))),
    T.StructField("z_threshold", T.DoubleType()),
    T.StructField("is_fitted", T.BooleanType()),
])


def read_header_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: header CSV by column name, whatever the order of the columns in the file.

    Values are read as text and cast; integers go through DOUBLE, so ``-3.0`` is -3; text that is no number
    fails.  Files whose header differs from the first one's fail as well.  ``ingest_order`` (file,
    place in the file) keeps the file order for keep-first dedup.
    """
    df = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)

    def value(src: str, dst: str):
        text, kind = F.col(f"`{src}`"), HEADER_TYPES.get(dst, "string")
        return (text.cast("double").cast(kind) if kind in ("int", "bigint") else text.cast(kind)).alias(dst)

    cols = [value(src, dst) for src, dst in HEADER_SOURCE_COLUMNS.items()]
    return df.select(*cols, F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")).alias("ingest_order"))


def read_sensor_parquet(spark: SparkSession, path: str, channels: Sequence[str] = dims.RAW_SENSORS) -> DataFrame:
    """A2 (+B9): sensor Parquet, snake_case names, NaN -> NULL on every channel, ``cluster`` dropped."""
    df = spark.read.parquet(path)
    present = {src: dst for src, dst in SENSOR_SOURCE_COLUMNS.items() if src in df.columns}
    out = []
    for src, dst in present.items():
        if dst in channels:
            out.append(nan_to_null(F.col(f"`{src}`")).alias(dst))
        elif dst != "cluster":
            out.append(F.col(f"`{src}`").alias(dst))
    return df.select(*out)


def load_data(spark: SparkSession, header_path: str, sensor_path: str) -> dict[str, DataFrame]:
    """A3: the two raw tables as one bundle (lazy)."""
    return {"header": read_header_csv(spark, header_path), "sensor": read_sensor_parquet(spark, sensor_path)}


def write_prepared(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: prepared long rows (flight, t, channels, label, split), partitioned by split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_prepared(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One split of the prepared dataset; the filter is a partition-pruning filter."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def dataset_manifest(prepared: DataFrame, stats: DataFrame, channels: Sequence[str],
                     key: str = "flight_id", label: str = "label") -> DataFrame:
    """A5: one-row manifest: flights per split, label counts per split, channel list, mean/std arrays."""
    per = prepared.groupBy("split").agg(F.countDistinct(key).alias("n_flights"),
                                        F.countDistinct(F.when(F.col(label) == 1, F.col(key))).alias("n_label_1"))
    per = per.withColumn("n_label_0", F.col("n_flights") - F.col("n_label_1"))
    splits = per.agg(F.sum("n_flights").alias("total_flights"),
                     F.map_from_entries(F.collect_list(F.struct("split", F.struct("n_flights", "n_label_0",
                                                                                   "n_label_1")))).alias("splits"))
    st = stats.agg(F.array_sort(F.collect_list(F.struct("idx", "channel", "mean", "std"))).alias("_s"))
    st = st.select(F.transform("_s", lambda x: x["channel"]).alias("channels"),
                   F.transform("_s", lambda x: x["mean"]).alias("norm_mean"),
                   F.transform("_s", lambda x: x["std"]).alias("norm_std"))
    return splits.withColumn("_j", F.lit(1)).join(st.withColumn("_j", F.lit(1)), "_j").drop("_j") \
        .withColumn("n_channels", F.lit(len(channels)))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def baseline_record(baseline: DataFrame, z_threshold: float) -> DataFrame:
    """A7 (write side): phase -> channel -> {mean, std} as nested maps, one row."""
    inner = baseline.groupBy("phase").agg(
        F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "std")))).alias("m"))
    return inner.agg(F.map_from_entries(F.collect_list(F.struct("phase", "m"))).alias("stats")) \
        .withColumn("z_threshold", F.lit(float(z_threshold))).withColumn("is_fitted", F.lit(True))


def save_baseline(baseline: DataFrame, path: str, z_threshold: float) -> None:
    baseline_record(baseline, z_threshold).coalesce(1).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A7 (read side): returns (rows phase, channel, mean, std; one-row settings z_threshold, is_fitted)."""
    raw = spark.read.schema(BASELINE_JSON_SCHEMA).json(path)
    rows = (raw.select(F.explode("stats").alias("phase", "m"))
            .select("phase", F.explode("m").alias("channel", "v"))
            .select("phase", "channel", F.col("v.mean").alias("mean"), F.col("v.std").alias("std")))
    return rows, raw.select("z_threshold", "is_fitted")


def validate_nested(df: DataFrame, col: str, n_steps: int, n_channels: int) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, rejects) by the shape check size == n_steps and every row size == n_channels."""
    a = F.col(col)
    ok = F.coalesce((F.size(a) == n_steps) & F.forall(a, lambda r: F.size(r) == n_channels), F.lit(False))
    return df.where(ok), df.where(~ok).withColumn(
        "reject_reason", F.format_string("expected shape (%d, %d)", F.lit(n_steps), F.lit(n_channels)))


def explode_nested(df: DataFrame, key: str, col: str, channels: Sequence[str]) -> DataFrame:
    """Valid nested flights to wide rows (key, t, one column per channel)."""
    rows = df.select(key, F.posexplode(col).alias("t", "_r"))
    return rows.select(key, F.col("t").cast("int").alias("t"),
                       *[F.col("_r").getItem(i).cast("double").alias(c) for i, c in enumerate(channels)])


def nest_flights(rows: DataFrame, key: str, channels: Sequence[str], t: str = "t") -> DataFrame:
    """Inverse of :func:`explode_nested`: one row per flight with ``flight_data`` (steps x channels).

    Only for prepared flights, whose length is fixed (bounded group size).  Flights are gathered by as many tasks as the
    table's size asks for, so that a task's share does not grow with the table.
    """
    g = rows.repartition(parts_for(rows), key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"),
                                                                    F.array(*[F.col(c) for c in channels]).alias("v"))))
                              .alias("_s"))
    return g.select(key, F.transform("_s", lambda x: x["v"]).alias("flight_data"))


def reshape_vector(col: str, n_steps: int, n_channels: int) -> F.Column:
    """A flat vector of n_steps * n_channels values as a (n_steps x n_channels) nested array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_steps - 1)),
                       lambda i: F.slice(F.col(col), i * n_channels + 1, n_channels))


def run_record(spark: SparkSession, name: str, params: Mapping[str, str], metrics: DataFrame) -> DataFrame:
    """A10: one run row: time-stamped unique run name, params map, metrics map (from a one-row metrics frame)."""
    mcols = [c for c, t in metrics.dtypes if t in ("double", "float", "int", "bigint")]
    pmap = F.create_map(*[x for k, v in params.items() for x in (F.lit(str(k)), F.lit(str(v)))]) if params \
        else F.create_map().cast("map<string,string>")
    mmap = F.create_map(*[x for c in mcols for x in (F.lit(c), F.col(c).cast("double"))])
    ts = F.current_timestamp()
    return metrics.select(
        F.expr("uuid()").alias("run_id"),
        F.concat_ws("_", F.lit(name), F.date_format(ts, "yyyyMMdd_HHmmss")).alias("run_name"),
        ts.alias("ts"), pmap.alias("params"), mmap.alias("metrics"))


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)
