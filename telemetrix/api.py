"""Stage-level API on the real flight schema.

Each function mirrors one stage of the original workflow and composes the
operators with the default channel set (23 sensors + 8 derived channels),
clip bounds, phase limits and parameters.  All return lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import dims
from .operators import anomaly as an
from .operators import chunked
from .operators import drift as dr
from .operators import explain as ex
from .operators import header as hd
from .operators import metrics as mt
from .operators import reports as rp
from .operators import score as sc
from .operators import split_norm as sn
from .operators import timeseries as ts

CHANNELS = dims.default_channels()
DERIVE = dict(cht=("e1_cht1", "e1_cht2", "e1_cht3", "e1_cht4"), egt=("e1_egt1", "e1_egt2", "e1_egt3", "e1_egt4"),
              fqty=("fqty_l", "fqty_r"), ias="ias", alt="altmsl")


def run_transformation(header: DataFrame, limit: int = dims.DATE_DIFF_LIMIT) -> dict[str, DataFrame]:
    """Header cleaning and labels: {'clean', 'labelled'} (the clean ids also select sensor rows)."""
    clean = hd.clean_header(header)
    return {"clean": clean, "labelled": hd.construct_labels(clean, limit)}


def run_feature_engineering(sensor: DataFrame, header_clean: DataFrame, labelled: DataFrame,
                            n_steps: int = dims.N_TIMESTEPS,
                            chunk_steps: int = chunked.DEFAULT_CHUNK_STEPS) -> DataFrame:
    """Semi-join to clean flights, prepare each flight (N steps x 31 channels), attach label and split."""
    rows = ts.semi_join_flights(sensor, header_clean, key="flight_id", flight_key="master_index")
    prepared = ts.prepare_flights(rows, dims.RAW_SENSORS, ["timestep"], chunked.step_chunk("timestep", chunk_steps),
                                  dims.CLIP_BOUNDS, DERIVE, n_steps=n_steps)
    flights = sn.stratified_split(labelled.select(F.col("master_index").alias("flight_id"),
                                                  F.col("label_binary").cast("int").alias("label")),
                                  "flight_id", "label")
    return prepared.join(flights, "flight_id")


def normalize(prepared: DataFrame, include_padding: bool = True) -> tuple[DataFrame, DataFrame]:
    """Train-split statistics (padding included by default) and the z-scored rows."""
    train = prepared.where(F.col("split") == "train")
    if not include_padding:
        train = train.where(~F.col("is_pad"))
    stats = sn.norm_stats(train, dims.ALL_CHANNELS)
    return stats, sn.apply_zscore(prepared, stats, dims.ALL_CHANNELS)


def fit_detector(normalised: DataFrame, spec: dims.PhaseSpec = dims.PhaseSpec()) -> DataFrame:
    """Per-phase baseline on healthy train flights."""
    healthy = an.assign_phase(normalised.where((F.col("split") == "train") & (F.col("label") == 0)), spec)
    return an.fit_baseline(healthy, CHANNELS.scored)


def detect(normalised: DataFrame, baseline: DataFrame, spec: dims.PhaseSpec = dims.PhaseSpec(),
           z_threshold: float = dims.Z_THRESHOLD) -> DataFrame:
    """Detection summary per flight (score, flagged sensors, phase counts, top anomalies)."""
    rows = an.assign_phase(normalised, spec)
    st = an.phase_channel_stats(rows, baseline, CHANNELS.scored, z_threshold=z_threshold)
    return an.detection_summary(st, rows, CHANNELS)


def fit_and_score(normalised: DataFrame, threshold: float = dims.DECISION_THRESHOLD):
    """Linear scorer on time-pooled channels fitted on train flights: (coefficients, scores)."""
    feats = sc.pooled_features(normalised, dims.ALL_CHANNELS)
    labels = normalised.where(F.col("split") == "train").select("flight_id", "label").distinct()
    coef = sc.fit_centroid_scorer(feats, labels, dims.ALL_CHANNELS)
    return coef, sc.score_flights(feats, coef, dims.ALL_CHANNELS, threshold=threshold)


def explain(normalised: DataFrame, scores: DataFrame, coef: DataFrame, detection: DataFrame | None = None
            ) -> DataFrame:
    """Attribution (top channels) and plain-language explanation per flight."""
    imp = sc.channel_importance(normalised, scores, coef, dims.ALL_CHANNELS)
    top = sc.top_channels(imp, CHANNELS)
    return ex.plain_explanation(scores, top, CHANNELS, detection)


def predict(normalised: DataFrame, baseline: DataFrame, coef: DataFrame, scores: DataFrame) -> DataFrame:
    """Full analysis per flight (score + detection + explanation), as nested alert records."""
    det = detect(normalised, baseline)
    return rp.alert_records(rp.flight_analysis(scores, det, explain(normalised, scores, coef, det)))


def run_retraining(normalised: DataFrame, scores: DataFrame, log_path: str | None = None,
                   run_name: str = "retrain") -> DataFrame:
    """Drift (train vs test) -> evaluate (test flights) -> promotion decision, as one run row.

    With ``log_path`` the run is also appended to the run log (A10): a time-stamped run name,
    the decision and drift figures as params, the metrics as metrics.
    """
    sides = dr.tag_split_sides(normalised, dims.ALL_CHANNELS)
    drift = dr.drift_report(dr.psi_by_channel(sides, dims.ALL_CHANNELS))
    flights = normalised.select("flight_id", "label", "split").distinct()
    test = scores.join(flights.where(F.col("split") == "test"), "flight_id").select(
        "flight_id", "label", "logit", F.col("probability").alias("prob"))
    n_train = flights.where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n"))
    n_test = flights.where(F.col("split") == "test").agg(F.count(F.lit(1)).alias("n"))
    run = mt.retraining_run(drift, mt.evaluate(test), n_train, n_test)
    if log_path is not None:
        from .session import materialize
        from .sources import io
        run = materialize(run, "run")  # computed once, read by the log record and the caller
        row = run.collect()[0]  # one row
        params = {k: str(row[k]) for k in ("drift_avg_psi", "drift_detected", "promotion_decision",
                                             "promotion_reason", "train_flights", "test_flights", "pipeline_type")}
        io.append_run(io.run_record(normalised.sparkSession, run_name, params,
                                    run.select("accuracy", "precision", "recall", "f1", "auc", "loss")), log_path)
    return run
