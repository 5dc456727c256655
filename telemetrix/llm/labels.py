"""Labelled documents for fitting the classifiers, bounded, documented samples of them, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetrix.llm.common import pick

RANGE = 1 << 30


def labelled(labels: DataFrame, doc_id: str, label: str, learn: Column) -> DataFrame:
    """id and y (0 or 1) of the rows to learn from (``learn`` is a condition on ``id``).

    Null ids and labels other than 0 and 1 are left out, as are ids with both labels.
    """
    return (pick(labels, id=doc_id, y=label).where("id is not null and y in (0, 1)").where(learn)
            .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z"))


def class_counts(known: DataFrame) -> tuple[int, int]:
    found = {int(r.y): r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return found.get(0, 0), found.get(1, 0)


def split_number(id_: Column) -> Column:
    """A number of an id, independent of the choice of ``sample``, for splitting what a classifier learns from."""
    return F.pmod(F.xxhash64(id_.cast("string"), F.lit("split")), F.lit(RANGE))


def sample(known: DataFrame, counts: tuple[int, int], rows: tuple[int, int]) -> DataFrame:
    """About ``rows`` labelled ids of the classes 0 and 1 (at most four times that), chosen by a hash of the id.

    Adds u, the ``split_number``.
    """
    h = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fit")), F.lit(RANGE))
    most = [int(RANGE * min(1.0, r / max(n, 1))) for r, n in zip(rows, counts)]
    return (known.where(h < F.when(F.col("y") == 1, F.lit(most[1])).otherwise(F.lit(most[0])))
            .withColumn("u", split_number(F.col("id"))).limit(4 * sum(rows)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic fit by Newton steps, on a standardised variable (``n`` rows at each place)."""
    mean, spread = float(np.average(x, weights=weight)), float(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n))) or 1.0
    design = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    beta, penalty = np.zeros(2), np.diag([ridge * weight.sum(), 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(2), gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * mean / spread)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators; places and values to interpolate between."""
    places, group = np.unique(x, return_inverse=True)  # equal places are one point
    weights, sums = np.bincount(group, weight), np.bincount(group, weight * y)
    blocks: list[list[float]] = []  # weight, weighted x, weighted y
    for a, b, w in zip(places, sums, weights):
        blocks.append([w, w * a, b])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([b[1] / b[0] for b in blocks]), np.array([b[2] / b[0] for b in blocks])


class Calibration:
    """Raw scores to probabilities: the isotonic fit, with a little of the logistic one to keep the order strict."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float = 0.05, n: np.ndarray | None = None):
        self.share, self.places, self.values = share, *isotonic(x, y, weight)
        self.slope, self.intercept = logistic(x, y, weight, n=n)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        smooth = 1 / (1 + np.exp(-np.clip(self.slope * raw + self.intercept, -500, 500)))
        return (1 - self.share) * np.interp(raw, self.places, self.values) + self.share * smooth


class Constant:
    """The same probability for every text, where one class has no labels."""

    def __init__(self, counts: tuple[int, int]):
        self.value = (counts[1] + 1) / (sum(counts) + 2)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.full(len(raw), self.value)


def calibrate(x: np.ndarray, y: np.ndarray, counts: tuple[int, int], n: np.ndarray | None = None):
    """Calibration on rows weighted back to the class frequencies ``counts``; ``n`` rows of each place and class."""
    n = np.ones(len(y), np.int64) if n is None else n
    if not len(y) or len(set(y.tolist())) < 2:
        return Constant(counts)
    share = {c: counts[c] / n[y == c].sum() for c in (0, 1)}
    return Calibration(x, y, n * np.where(y == 1, share[1], share[0]) / sum(counts) * n.sum(), n=n)
