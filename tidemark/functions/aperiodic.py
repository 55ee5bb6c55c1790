"""Power spectra as a falling line and peaks, many spectra at once: a robust line, Gaussian peaks one after another, their joint least
squares fit, and the line again without them.

In log10 power over log10 frequency the aperiodic part is offset - exponent * log10(f). A first line is fitted again on the lowest
SHARE of what stands above it. On the flattened spectrum the highest point starts a peak, as wide as the nearer half-height crossing
says, until a point is under both NOISE deviations and LEAST; peaks too near an edge go, and the lower of two that overlap. Heights,
centres and widths are then fitted together within bounds by damped Gauss-Newton steps, all spectra in the same array operations.

Defined cases: a spectrum with a non-finite or non-positive power in the range, or fewer than LEAST_BINS bins there, has NaN throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.numeric import welch
from tidemark.sources.tables import signals

#: Fixed values of the fit: range and widths (full, of two deviations) in Hz, most peaks, least height, noise factor, lowest share, edge and
#: overlap factors, bound of a centre in widths.
RANGE, WIDTHS, MOST, LEAST, NOISE, SHARE, EDGE, OVERLAP, CENTRE = (1.0, 40.0), (1.0, 8.0), 4, 0.1, 2.0, 2.5, 1.0, 0.75, 1.5
LEAST_BINS = 8


@dataclass(frozen=True)
class Fit:
    """offset, exponent, r2 (spectrum); peaks (spectrum, peak, 3): centre, height, full width, NaN where there is none, by centre."""

    offset: np.ndarray
    exponent: np.ndarray
    r2: np.ndarray
    peaks: np.ndarray


def line(x: np.ndarray, y: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Intercept and slope of each row of y over x by least squares, on the points in use."""
    w = np.ones(y.shape) if use is None else use.astype(float)
    n = w.sum(axis=1, keepdims=True)
    mx, my = (w * x).sum(axis=1, keepdims=True) / n, (w * y).sum(axis=1, keepdims=True) / n
    dx = w * (x - mx)
    slope = (dx * (y - my)).sum(axis=1) / np.maximum((dx * (x - mx)).sum(axis=1), 1e-300)
    return my[:, 0] - slope * mx[:, 0], slope


def gaussians(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(row, peak, bin) of parameters p (row, peak, 3): centre, height, deviation."""
    c, h, s = (p[..., i, None] for i in range(3))
    return h * np.exp(-((f - c) ** 2) / (2 * s * s))


def _guess(f: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starting peaks (row, peak, 3) and which are there."""
    rest, rows, step = flat.copy(), np.arange(len(flat)), f[1] - f[0]
    peaks, there, going = np.zeros((len(flat), MOST, 3)), np.zeros((len(flat), MOST), bool), np.ones(len(flat), bool)
    bins, deviations = np.arange(flat.shape[1]), (WIDTHS[0] / 2, WIDTHS[1] / 2)
    for k in range(MOST):
        top = rest.argmax(axis=1)
        height = rest[rows, top]
        going &= (height > NOISE * rest.std(axis=1)) & (height >= LEAST)
        if not going.any():
            break
        under = rest <= height[:, None] / 2
        away = np.where(under, np.abs(bins - top[:, None]), flat.shape[1])
        near = away.min(axis=1)
        width = np.where(near < flat.shape[1], 2 * near * step / (2 * np.sqrt(2 * np.log(2))), sum(WIDTHS) / 2)
        peaks[:, k] = np.stack([f[top], height, np.clip(width, *deviations)], axis=1)
        there[:, k] = going
        rest = rest - going[:, None] * gaussians(f, peaks[:, k : k + 1])[:, 0]
    centre, deviation = peaks[..., 0], peaks[..., 2]
    there &= (centre - f[0] > EDGE * deviation) & (f[-1] - centre > EDGE * deviation)
    # neighbours by centre that overlap lose the lower one
    order = np.argsort(np.where(there, centre, np.inf), axis=1, kind="stable")
    peaks, there = np.take_along_axis(peaks, order[..., None], axis=1), np.take_along_axis(there, order, axis=1)
    lost = np.zeros_like(there)
    for k in range(MOST - 1):
        a, b = peaks[:, k], peaks[:, k + 1]
        touch = there[:, k] & there[:, k + 1] & (a[:, 0] + OVERLAP * a[:, 2] > b[:, 0] - OVERLAP * b[:, 2])
        lost[:, k] |= touch & (a[:, 1] < b[:, 1])
        lost[:, k + 1] |= touch & (a[:, 1] >= b[:, 1])
    return peaks, there & ~lost


def _joint(f: np.ndarray, flat: np.ndarray, start: np.ndarray, there: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Peaks of least squares within bounds; damped steps, each spectrum with a damping of its own."""
    low = np.stack([start[..., 0] - 2 * CENTRE * start[..., 2], np.zeros(there.shape), np.full(there.shape, WIDTHS[0] / 2)], axis=-1)
    high = np.stack([start[..., 0] + 2 * CENTRE * start[..., 2], np.full(there.shape, np.inf), np.full(there.shape, WIDTHS[1] / 2)], axis=-1)
    low[..., 0], high[..., 0] = np.maximum(low[..., 0], f[0]), np.minimum(high[..., 0], f[-1])
    p, n = np.clip(start, low, high), len(flat)
    damp = np.full(n, 1e-2)

    def residual(p: np.ndarray) -> np.ndarray:
        return (there[..., None] * gaussians(f, p)).sum(axis=1) - flat

    r = residual(p)
    cost = (r * r).sum(axis=1)
    for _ in range(rounds):
        c, h, s = (p[..., i, None] for i in range(3))
        shape = there[..., None] * np.exp(-((f - c) ** 2) / (2 * s * s))
        j = np.stack([h * shape * (f - c) / (s * s), shape, h * shape * (f - c) ** 2 / s**3], axis=2).reshape(n, 3 * MOST, -1)
        g = np.einsum("npf,nf->np", j, r)
        # a parameter at a bound that the slope would push outside stays
        flat_p, flat_low, flat_high = (v.reshape(n, -1) for v in (p, low, high))
        free = ~(((flat_p <= flat_low) & (g > 0)) | ((flat_p >= flat_high) & (g < 0))) & np.repeat(there, 3, axis=1)
        j = j * free[..., None]
        a = np.einsum("npf,nqf->npq", j, j)
        diagonal = np.einsum("npp->np", a)
        a = a + np.eye(3 * MOST) * (damp[:, None] * diagonal + np.where(free & (diagonal > 0), 1e-12, 1.0))[:, :, None]
        step = np.linalg.solve(a, (g * free)[..., None])[..., 0].reshape(p.shape)
        q = np.clip(p - step, low, high)
        r1 = residual(q)
        cost1 = (r1 * r1).sum(axis=1)
        ok = cost1 <= cost
        gain = np.where(ok, cost - cost1, 0)
        p[ok], r[ok], damp = q[ok], r1[ok], np.where(ok, np.maximum(damp / 5, 1e-9), np.minimum(damp * 5, 1e9))
        if not (ok & (gain > 1e-14 * (1 + cost))).any() and (damp >= 1e6).sum() + ok.sum() == n:
            break
        cost = np.where(ok, cost1, cost)
    return p


def fit(f: np.ndarray, power: np.ndarray) -> Fit:
    """Fits of spectra (spectrum, bin) at the frequencies f."""
    n = len(power)
    inside = (f >= RANGE[0]) & (f <= RANGE[1]) & (f > 0)
    lost = Fit(*(np.full(n, np.nan) for _ in range(3)), np.full((n, MOST, 3), np.nan))
    good = np.isfinite(power[:, inside]).all(axis=1) & (power[:, inside] > 0).all(axis=1)
    if inside.sum() < LEAST_BINS or not good.any():
        return lost
    own, x, y = f[inside], np.log10(f[inside]), np.log10(power[good][:, inside])
    a, b = line(x, y)
    above = np.maximum(y - (a[:, None] + b[:, None] * x), 0)
    a, b = line(x, y, above <= np.percentile(above, SHARE, axis=1, keepdims=True))
    flat = y - (a[:, None] + b[:, None] * x)
    start, there = _guess(own, flat)
    peaks = _joint(own, flat, start, there)
    peaks[..., 1] *= there
    bumps = (there[..., None] * gaussians(own, peaks)).sum(axis=1)
    a, b = line(x, y - bumps)
    model = a[:, None] + b[:, None] * x + bumps
    dm, dy = model - model.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = (dm * dy).sum(axis=1) ** 2 / ((dm * dm).sum(axis=1) * (dy * dy).sum(axis=1))
    peaks[..., 2] *= 2
    peaks[~there] = np.nan
    order = np.argsort(np.where(there, peaks[..., 0], np.inf), axis=1, kind="stable")
    for into, v in ((lost.offset, a), (lost.exponent, -b), (lost.r2, r2), (lost.peaks, np.take_along_axis(peaks, order[..., None], axis=1))):
        into[good] = v
    return lost


def fits(epochs: DataFrame, channels: int, rate: float, size: int) -> DataFrame:
    """epoch, channel, offset, exponent, r2, peaks (array of centre, height, width) of epochs (epoch, x: channels one after another).

    A batch's spectra are one array. NaN comes out as null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows * channels, -1)
            got = fit(*welch(x, rate, size))
            there = ~np.isnan(got.peaks[..., 0])
            items = pa.StructArray.from_arrays([pa.array(v) for v in got.peaks[there].T], names=["centre", "height", "width"])
            peaks = pa.ListArray.from_arrays(pa.array(np.r_[0, there.sum(axis=1).cumsum()].astype(np.int32)), items)
            line_ = [pa.array(v, mask=np.isnan(v)) for v in (got.offset, got.exponent, got.r2)]
            epoch = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), channels)))
            yield pa.RecordBatch.from_arrays([epoch, pa.array(np.tile(np.arange(channels, dtype=np.int32), batch.num_rows)), *line_, peaks], names=["epoch", "channel", "offset", "exponent", "r2", "peaks"])

    kept = epochs.select("epoch", "x")
    kind = kept.schema["epoch"].dataType.simpleString()
    return kept.mapInArrow(run, f"epoch {kind}, channel int, offset double, exponent double, r2 double, peaks array<struct<centre double, height double, width double>>")


def aperiodic_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as one channel of 64 samples at 64 Hz: 1-Hz bins up to 32 Hz."""
    return fits(signals(spark, sf_dir).where("size(x) = 64"), 1, 64, 64)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"aperiodic_peaks": aperiodic_peaks}
