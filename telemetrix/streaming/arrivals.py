"""Analyse flights as they arrive (Structured Streaming).

Each input row holds one complete flight as a nested array (A8), so the
stream needs no state: every micro-batch is validated, exploded, checked
against a static baseline, scored and explained by a static model (tables of
one row per phase and per channel, written once when the stream starts) and
written to ``<sink>/batch_id=<id>`` with overwrite.  A replayed batch
rewrites the same folder, so the sink stays exactly-once; the checkpoint
folder records progress, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from ..operators import anomaly as an
from ..operators import explain as ex
from ..operators import score as sc
from ..operators import split_norm as sn
from ..session import materialize
from ..sources import io


def nested_schema(key: str = "flight_id") -> T.StructType:
    return T.StructType([T.StructField(key, T.LongType()),
                         T.StructField("flight_data", T.ArrayType(T.ArrayType(T.DoubleType())))])


@dataclass(frozen=True)
class Scorer:
    """Normalisation statistics and fitted coefficients for scoring and explaining arrivals."""

    stats: DataFrame
    coef: DataFrame
    threshold: float = dims.DECISION_THRESHOLD


def score_batch(batch: DataFrame, baseline: DataFrame, chanset: dims.ChannelSet, channels: Sequence[str],
                spec: dims.PhaseSpec, n_steps: int, z_threshold: float, key: str = "flight_id",
                scorer: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """One micro-batch: (analysis per flight, rejected rows).

    With a ``scorer`` the analysis is I7's: detection, probability, decision, severity and explanation.
    """
    valid, rejects = io.validate_nested(batch, "flight_data", n_steps, len(channels))
    rows = an.assign_phase(io.explode_nested(valid, key, "flight_data", channels), spec)
    st = an.phase_channel_stats(rows, baseline, channels, key=key, z_threshold=z_threshold)
    det = an.detection_summary(st, rows, chanset, key)
    out = det.select(key, "anomaly_score", F.concat_ws(",", "flagged_sensors").alias("flagged_sensors"))
    if scorer is not None:
        z = sn.apply_zscore(rows, scorer.stats, channels)
        scores = sc.score_flights(sc.pooled_features(z, channels, key), scorer.coef, channels, key, scorer.threshold)
        top = sc.top_channels(sc.channel_importance(z, scores, scorer.coef, channels, key), chanset, key)
        texts = ex.flat_explanation(ex.plain_explanation(scores, top, chanset, det, key)).select(key, "summary", "recommended_action")
        out = out.join(scores.select(key, "probability", "prediction", "severity", "message"), key).join(texts, key, "left")
    return out, rejects.select(key, "reject_reason")


def analyse_arrivals(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                     baseline: DataFrame, chanset: dims.ChannelSet, channels: Sequence[str],
                     spec: dims.PhaseSpec, n_steps: int, z_threshold: float = dims.Z_THRESHOLD,
                     files_per_trigger: int = 100, key: str = "flight_id", processing_time: str | None = None,
                     scorer: Scorer | None = None):
    """Run the arrival stream.

    Default: process everything available now, then stop (returns None).  With
    ``processing_time`` (for instance ``'1 minute'``) the query keeps running and is returned.
    """
    stream = (spark.readStream.schema(nested_schema(key)).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_dir))
    # written once to the shared folder, so that micro-batches read it instead of fitting it again
    baseline = materialize(baseline.select("phase", "channel", "mean", "std"), "baseline")

    if scorer is not None:
        scorer = replace(scorer, stats=materialize(scorer.stats, "stats"), coef=materialize(scorer.coef, "coef"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # not persisted: unpacked flights take several times their files, which each pass reads in pieces of bounded size
        scores, rejects = score_batch(batch, baseline, chanset, channels, spec, n_steps, z_threshold, key, scorer)
        scores.write.mode("overwrite").parquet(f"{sink_dir}/scores/batch_id={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{sink_dir}/rejects/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    if processing_time:
        return writer.trigger(processingTime=processing_time).start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return None


def replay_as_files(nested: DataFrame, target_dir: str, flights_per_file: int = 1000) -> None:
    """Write nested flights as Parquet files of bounded size, standing in for flights that land over time."""
    nested.write.mode("overwrite").option("maxRecordsPerFile", flights_per_file).parquet(target_dir)
