"""Models of covariance matrices in their curved space: tangent vectors and minimum distance to mean, each fitted on training folds.

An epoch has a matrix for each band and one for all. A fold's means are those of the other folds' epochs: geometric means by fixed-point
rounds, one distributed aggregation a round for all folds, classes and bands together. The driver sees the means alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tidemark.operators.evaluate  # noqa: F401
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import oas
from tidemark.functions.riemann import distance2, log_at, move, tangent
from tidemark.functions.signal import BANDS, band_filter
from tidemark.plans.portable import frame
from tidemark.sources.tables import signals

CHANNELS, RATE, FOLDS, CLASSES = 4, 64, 5, 3
N_BANDS = len(BANDS) + 1
_SHAPE = (-1, N_BANDS, CHANNELS, CHANNELS)


def band_covariances(x: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Shrunk covariances (bands and broadband, channel, channel) of channels x samples; upper edges stay 1 Hz below half the rate."""
    return np.stack([*(oas(band_filter(x, rate, low, min(high, rate / 2 - 1))) for low, high in BANDS.values()), oas(x)])


def covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, cov (flat) of every epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, CHANNELS, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), _rows(np.stack([band_covariances(v) for v in x]))], names=["epoch", "cov"])

    return signals(spark, sf_dir).mapInArrow(run, "epoch long, cov array<double>")


def _rows(x: np.ndarray) -> pa.Array:
    """A list of numbers for each first index of x."""
    flat = x.reshape(len(x), int(np.prod(x.shape[1:])))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, subject, label, fold, cov: the first repeat's folds of the three-class task."""
    folds = frame(spark, sf_dir, "folds").where("repeat = 0").select("subject", "fold")
    return covariances(spark, sf_dir).join(frame(spark, sf_dir, "epochs3"), "epoch").join(folds, "subject").selectExpr("epoch", "subject", "cast(label as long) as label", "cast(fold as long) as fold", "cov")


def by_fold(fold: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Training rows (row, fold)."""
    return fold[:, None] != np.arange(FOLDS)


def by_fold_and_class(fold: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Training rows of a class (row, fold x class)."""
    return ((fold[:, None] != np.arange(FOLDS))[:, :, None] & (label[:, None] == np.arange(CLASSES))[:, None, :]).reshape(len(fold), -1)


def training_means(rows: DataFrame, member: Callable[[np.ndarray, np.ndarray], np.ndarray], groups: int, rounds: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """Geometric mean (group, band, channel, channel) of each group's matrices; the identity where a group is empty."""
    size = N_BANDS * CHANNELS * CHANNELS

    def average(at: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((groups, N_BANDS, CHANNELS, CHANNELS)), np.zeros(groups)
            for batch in batches:
                if not batch.num_rows:
                    continue
                covs = batch.column(2).flatten().to_numpy().reshape(_SHAPE)
                own = member(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                for g in np.flatnonzero(own.any(axis=0)):
                    some = covs[own[:, g]]
                    total[g] += (some if at is None else log_at(some, at[g])).sum(axis=0)
                n += own.sum(axis=0)
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), _rows(total[full])], names=["g", "n", "s"])

        sums = rows.select("fold", "label", "cov").mapInArrow(run, "g long, n double, s array<double>")
        out = np.zeros((groups, size)) if at is not None else np.tile(np.tile(np.eye(CHANNELS).ravel(), N_BANDS), (groups, 1))
        # groups x bands x channels x channels rows, whatever the data
        for r in sums.select("g", "n", F.posexplode("s").alias("i", "v")).groupBy("g", "i").agg((F.sum("v") / F.sum("n")).alias("m")).collect():
            out[r.g, r.i] = r.m
        return out.reshape(groups, *_SHAPE[1:])

    at = average(None)
    for _ in range(rounds):
        step = average(at)
        at = move(at, step)
        if np.abs(step).max() < tolerance:
            break
    return at


def _fitted(rows: DataFrame, member: Callable[[np.ndarray, np.ndarray], np.ndarray], groups: int) -> np.ndarray:
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)  # read once a round; released before the result is asked for
    try:
        return training_means(kept, member, groups)
    finally:
        kept.unpersist()


def riemann_tangent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, epoch, role, tangent: for each fold all epochs, training and test, at the mean of its training epochs; bands one after another."""
    rows = labelled(spark, sf_dir)
    means = _fitted(rows, by_fold, FOLDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            covs, own = batch.column(2).flatten().to_numpy().reshape(_SHAPE), batch.column(1).to_numpy()
            for fold in range(FOLDS):
                role = pa.array(np.where(own == fold, "test", "train"))
                t = np.concatenate([tangent(covs[:, b], means[fold, b]) for b in range(N_BANDS)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), fold)), batch.column(0), role, _rows(t)], names=["fold", "epoch", "role", "tangent"])

    return rows.select("epoch", "fold", "cov").mapInArrow(run, "fold long, epoch long, role string, tangent array<double>")


def riemann_mdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, subject, label, epoch, prediction, proba of every epoch, by the class means of the other folds: squared distances summed over bands."""
    rows = labelled(spark, sf_dir)
    means = _fitted(rows, by_fold_and_class, FOLDS * CLASSES).reshape(FOLDS, CLASSES, *_SHAPE[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            covs, own = batch.column(4).flatten().to_numpy().reshape(_SHAPE), batch.column(0).to_numpy()
            d = np.zeros((len(own), CLASSES))
            for fold in np.unique(own):
                for k in range(CLASSES):
                    d[own == fold, k] = sum(distance2(covs[own == fold, b], means[fold, k, b]) for b in range(N_BANDS))
            z = -d / d.mean(axis=1, keepdims=True)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(p.argmax(axis=1)), _rows(p)], names=["fold", "subject", "label", "epoch", "prediction", "proba"])

    return rows.select("fold", "subject", "label", "epoch", "cov").mapInArrow(run, "fold long, subject long, label long, epoch long, prediction long, proba array<double>")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"covariance_oas": covariances, "riemann_tangent": riemann_tangent, "riemann_mdm": riemann_mdm}
