"""Per-flight time-series preparation.

Wide rows (one per flight and step, one column per channel) are kept for
the whole preparation, so every channel shares one window sort.  All
ordered operations go through :mod:`chunked`, which bounds the rows per
task by (flight, time-chunk) instead of by flight.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.exprs import clip, is_true
from ..functions.joins import broadcast_if_small
from . import chunked


def semi_join_flights(sensor: DataFrame, flights: DataFrame, key: str = "flight_id",
                      flight_key: str | None = None) -> DataFrame:
    """Keep sensor rows of the given flights.

    The id set grows with the data, so it is broadcast only behind a size
    check; above the bound it stays a shuffle join (AQE may still broadcast
    it at runtime).
    """
    ids = flights.select(F.col(flight_key or key).alias(key)).distinct()
    return sensor.join(broadcast_if_small(ids), key, "left_semi")


def missing_flights(header: DataFrame, sensor: DataFrame, key: str = "flight_id",
                    sensor_key: str | None = None, min_rows: int = 1) -> DataFrame:
    """Header flights without usable sensor rows (anti-join); a flight below ``min_rows`` rows counts as missing."""
    ids = (sensor.groupBy(F.col(sensor_key or key).alias(key)).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") >= F.lit(int(min_rows))).select(key))
    return header.join(ids, key, "left_anti")


def project_channels(df: DataFrame, keep: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Fixed channel order; absent channels become 0.0 (dropped columns such as 'cluster' vanish)."""
    present = set(df.columns)
    return df.select(*keep, *[(F.col(c).cast("double") if c in present else F.lit(0.0)).alias(c) for c in channels])


def clip_channels(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Physical clipping per channel, NULL stays NULL."""
    out = df
    for c, (lo, hi) in bounds.items():
        if c in df.columns:
            out = out.withColumn(c, clip(c, lo, hi))
    return out


def derive_channels(df: DataFrame, cht: Sequence[str], egt: Sequence[str], fqty: Sequence[str],
                    ias: str, alt: str, cruise_ias: float = dims.CRUISE_IAS_MIN,
                    cruise_alt: float = dims.CRUISE_ALT_MIN) -> DataFrame:
    """The eight derived channels, row-wise expressions."""
    c = [F.col(x) for x in cht]
    e = [F.col(x) for x in egt]
    cht_mean = sum(c[1:], c[0]) / F.lit(float(len(c)))
    egt_mean = sum(e[1:], e[0]) / F.lit(float(len(e)))
    return df.select(
        "*",
        (F.greatest(*c) - F.least(*c)).alias("cht_spread"),
        cht_mean.alias("cht_mean"),
        (c[-1] - c[0]).alias("cht4_minus_cht1"),
        (F.greatest(*e) - F.least(*e)).alias("egt_spread"),
        egt_mean.alias("egt_mean"),
        (egt_mean - cht_mean).alias("egt_cht_divergence"),
        (F.col(fqty[0]) - F.col(fqty[1])).alias("fqty_imbalance"),
        is_true((F.col(ias) > F.lit(float(cruise_ias))) & (F.col(alt) > F.lit(float(cruise_alt))))
        .cast("double").alias("is_cruise"),
    )


def order_series(df: DataFrame, key: str, order: Sequence, chunk: Column | None = None, length_col: str | None = "n_rows",
                 keep_chunk: bool = False, max_rows: int = chunked.MAX_ROWS) -> DataFrame:
    """Dense 0-based step ``t`` per flight along ``order`` (skew-safe, see chunked.dense_index)."""
    return chunked.dense_index(df, key, order, chunk, "t", length_col, keep_chunk, max_rows)


def fill_gaps(df: DataFrame, channels: Sequence[str], key: str = "flight_id", t: str = "t",
              chunk_steps: int | None = chunked.DEFAULT_CHUNK_STEPS) -> DataFrame:
    """Forward fill, backward fill, then 0.

    ``chunk_steps``: chunk by floor(t / steps) (needs a dense ``t``); None reuses the
    ``_chunk`` column left by :func:`order_series` (no new shuffle).
    """
    chunk = None if chunk_steps is None else chunked.step_chunk(t, chunk_steps)
    return chunked.fill_forward_backward(df, key, t, chunk, channels, 0.0)


def cut_pad(df: DataFrame, channels: Sequence[str], n_steps: int, key: str = "flight_id", t: str = "t",
            length: str = "n_rows", lengths: DataFrame | None = None) -> DataFrame:
    """Keep the last ``n_steps`` steps; left-pad shorter flights with zero rows.

    Needs a dense ``t`` and the flight length.  Output ``t`` is 0..n_steps-1
    for every flight, ``is_pad`` marks padding rows.  ``lengths`` (one row
    per flight) avoids another pass over the rows to find short flights.
    """
    shift = F.lit(int(n_steps)) - F.col(length)
    kept = (df.withColumn(t, (F.col(t) + shift).cast("int")).where(F.col(t) >= 0)
            .select(key, t, *channels, F.lit(False).alias("is_pad")))
    if lengths is None:
        lengths = df.groupBy(key).agg(F.max(length).alias(length))
    short = lengths.select(key, F.col(length).alias("_len")).where(F.col("_len") < F.lit(int(n_steps)))
    pad = (short.select(key, F.explode(F.sequence(F.lit(0), F.lit(int(n_steps)) - F.col("_len") - 1)).alias(t))
           .select(key, F.col(t).cast("int").alias(t), *[F.lit(0.0).alias(c) for c in channels],
                   F.lit(True).alias("is_pad")))
    return kept.unionByName(pad)


def prepare_flights(sensor: DataFrame, raw_channels: Sequence[str], order: Sequence[str], chunk: Column | None,
                    clip_bounds: Mapping[str, tuple], derive: Mapping | None, n_steps: int = dims.N_TIMESTEPS,
                    key: str = "flight_id", min_rows: int = dims.MIN_FLIGHT_ROWS,
                    max_rows: int = chunked.MAX_ROWS) -> DataFrame:
    """K3 as one plan: project -> order -> drop short flights -> clip -> fill -> derive -> cut/pad.

    Ordering, clipping and filling share one shuffle of the rows by
    (flight, chunk) (:func:`chunked.ordered_fill`; ``chunk`` None cuts long
    flights into chunks of about ``max_rows`` rows); the flight lengths and the
    padding come from the small chunk summary.
    """
    p = project_channels(sensor, [key, *order], raw_channels)
    clips = {c: clip(c, lo, hi) for c, (lo, hi) in clip_bounds.items() if c in raw_channels}
    rows, lengths = chunked.ordered_fill(p, key, order, chunk, raw_channels, clips, 0.0, "t", "n_rows", max_rows)
    rows = rows.where(F.col("n_rows") >= F.lit(int(min_rows)))
    lengths = lengths.where(F.col("n_rows") >= F.lit(int(min_rows)))
    chans = list(raw_channels)
    if derive:
        rows = derive_channels(rows, **derive)
        chans += dims.DERIVED_CHANNELS
    return cut_pad(rows.select(key, "t", "n_rows", *chans), chans, n_steps, key, "t", "n_rows", lengths)


def moving_average(df: DataFrame, cols: Sequence[str], key: str = "flight_id", t: str = "t",
                   width: int = 20, chunk_steps: int = chunked.DEFAULT_CHUNK_STEPS) -> DataFrame:
    """Centred moving average with zero padding: position i averages i-w/2 .. i+w/2-1, always / w."""
    before, after = width // 2, width - width // 2 - 1
    h = chunked.with_halo(df, t, chunk_steps, before, after)
    w = Window.partitionBy(key, chunked.CHUNK).orderBy(t).rowsBetween(-before, after)
    out = h.select("*", *[(F.coalesce(F.sum(c).over(w), F.lit(0.0)) / F.lit(float(width))).alias(f"{c}_ma")
                          for c in cols])
    return out.where("_home").drop("_home", chunked.CHUNK)


def causal_dilated_filter(df: DataFrame, col: str, weights: Sequence[float], dilations: Sequence[int],
                          key: str = "flight_id", t: str = "t",
                          chunk_steps: int = chunked.DEFAULT_CHUNK_STEPS) -> DataFrame:
    """y_d[t] = sum_k w_k * x[t - (K-1-k)*d], zero before the start, one column per dilation."""
    k = len(weights)
    reach = (k - 1) * max(dilations)
    h = chunked.with_halo(df, t, chunk_steps, reach, 0)
    w = Window.partitionBy(key, chunked.CHUNK).orderBy(t)
    outs = []
    for d in dilations:
        terms = [F.lit(float(wk)) * F.lag(F.col(col), (k - 1 - i) * d, 0.0).over(w) if (k - 1 - i) * d
                 else F.lit(float(wk)) * F.col(col) for i, wk in enumerate(weights)]
        outs.append(sum(terms[1:], terms[0]).alias(f"{col}_d{d}"))
    return h.select("*", *outs).where("_home").drop("_home", chunked.CHUNK)
