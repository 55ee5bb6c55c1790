"""All features of an epoch by name: family__measure__band__place, with means over regions (family + R) and over the head (family + G)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.numeric import coherence_bins, envelope_correlation, higuchi, permutation_entropy, sample_entropy, welch
from tidemark.functions.signal import BANDS, band_filter
from tidemark.sources.tables import signals

LEAST, MOST, PEAK, CENTRE, LINE = 0.5, 45.0, (5.0, 14.0), (7.0, 13.0), (1.0, 40.0)
#: Stand-in montage of the embeddings: four channels, two regions.
REGIONS = {"front": [0, 1], "back": [2, 3]}


def band_mask(f: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bins of a band: its upper edge belongs to the next band, if there is one."""
    return (f >= low) & ((f <= high) if high >= MOST else (f < high))


def _within(f: np.ndarray, span: tuple[float, float]) -> np.ndarray:
    return (f >= span[0]) & (f <= span[1])


def spectral_block(f: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """Measures (channel) of densities p (channel, bin); a band without bins gives NaN, as do logarithms and shares of no power."""
    df, whole = f[1] - f[0], _within(f, (LEAST, MOST))
    power = {b: np.where(band_mask(f, *e).any(), p[:, band_mask(f, *e)].sum(axis=1) * df, np.nan) for b, e in BANDS.items()}
    total = p[:, whole].sum(axis=1) * df
    out = {f"abspow__{b}": np.log10(v) for b, v in power.items()} | {f"relpow__{b}": v / total for b, v in power.items()}
    out["abspow__total"] = np.log10(total)
    out["ratio__theta_alpha"] = np.log10(power["theta"] / power["alpha"])
    out["ratio__slow_fast"] = np.log10((power["delta"] + power["theta"]) / (power["alpha"] + power["beta"]))
    share, at = p[:, whole] / p[:, whole].sum(axis=1, keepdims=True), f[whole]
    out["spec_entropy__all"] = -(share * np.log(share + 1e-20)).sum(axis=1) / np.log(len(at))
    upto = np.cumsum(share, axis=1)
    out |= {name: at[(upto >= q).argmax(axis=1)] for name, q in (("median_freq__all", 0.5), ("sef95__all", 0.95))}
    peak, centre = _within(f, PEAK), _within(f, CENTRE)
    out["peak_freq__all"] = f[peak][p[:, peak].argmax(axis=1)] if peak.any() else np.full(len(p), np.nan)
    out["alpha_cog__all"] = (p[:, centre] * f[centre]).sum(axis=1) / p[:, centre].sum(axis=1)
    return out


def line_block(f: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """A straight line through log10 power over log10 frequency: offset, exponent, R squared. Peaks are not fitted."""
    m = _within(f, LINE)
    x, y = np.log10(f[m]), np.log10(p[:, m] + 1e-20)
    dx, dy = x - x.mean(), y - y.mean(axis=1, keepdims=True)
    slope = dy @ dx / (dx @ dx)
    return {"offset__all": y.mean(axis=1) - slope * x.mean(), "exponent__all": -slope, "r2__all": slope**2 * (dx @ dx) / (dy**2).sum(axis=1)}


def shape_block(x: np.ndarray) -> dict[str, np.ndarray]:
    v = [np.diff(x, k, axis=1).var(axis=1) for k in range(3)]
    out = {"hjorth_activity__all": np.log(v[0]), "hjorth_mobility__all": np.sqrt(v[1] / v[0]), "hjorth_complexity__all": np.sqrt(v[2] / v[1]) / np.sqrt(v[1] / v[0])}
    return out | {f"{f.__name__}__all": np.array([f(c) for c in x]) for f in (permutation_entropy, sample_entropy, higuchi)}


def connectivity_block(x: np.ndarray, rate: float, size: int) -> dict[str, np.ndarray]:
    """Matrices (channel, channel) of each measure and band, zero on the diagonal."""
    measures, off = coherence_bins(x, size), 1 - np.eye(len(x))
    f = np.fft.rfftfreq(size, 1 / rate)[1:]
    out = {}
    for name, m in zip(("coh", "icoh", "wpli"), measures, strict=True):
        for b, edges in BANDS.items():
            some = band_mask(f, *edges)
            out[f"{name}__{b}"] = m[..., some].mean(axis=-1) * off if some.any() else np.full(off.shape, np.nan)
    return out | {f"aec__{b}": envelope_correlation(band_filter(x, rate, low, min(high, rate / 2 - 1))) * off for b, (low, high) in BANDS.items()}


def epoch_features(x: np.ndarray, rate: float, size: int, regions: dict[str, list[int]] = REGIONS) -> dict[str, float]:
    """Every named feature of one epoch (channel, sample); size: samples of a segment of the spectra."""
    f, p = welch(x, rate, size)
    out: dict[str, float] = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        blocks = {"spec": spectral_block(f, p), "aper": line_block(f, p), "cplx": shape_block(x)}
    for family, block in blocks.items():
        for key, v in block.items():
            out |= {f"{family}__{key}__ch{i}": float(y) for i, y in enumerate(v)}
            for region, own in regions.items():
                known = v[own][~np.isnan(v[own])]
                out[f"{family}R__{key}__{region}"] = float(known.mean()) if len(known) else float("nan")
    names, n = list(regions), len(x)
    for key, m in connectivity_block(x, rate, size).items():
        out |= {f"conn__{key}__ch{i}": float(y) for i, y in enumerate(m.sum(axis=1) / (n - 1))}
        for i, a in enumerate(names):
            for b in names[i:]:
                part = m[np.ix_(regions[a], regions[b])]
                pairs = part.size - (len(regions[a]) if a == b else 0)
                out[f"connR__{key}__{a}-{b}"] = float(part.sum() / pairs) if pairs else 0.0
        out[f"connG__{key}__global"] = float(m.sum() / (n * (n - 1)))
    return out


def extract(epochs: DataFrame, channels: int, rate: float, size: int, regions: dict[str, list[int]] = REGIONS) -> DataFrame:
    """epoch, name, value of every feature of epochs (epoch, x: channels one after another); null where a feature has no value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for epoch, x in zip(batch.column(0), batch.column(1), strict=True):
                own = epoch_features(x.values.to_numpy().reshape(channels, -1), rate, size, regions)
                v = np.fromiter(own.values(), dtype=float, count=len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), epoch.as_py())), pa.array(list(own)), pa.array(v, mask=~np.isfinite(v))], names=["epoch", "name", "value"])

    return epochs.select("epoch", "x").mapInArrow(run, "epoch long, name string, value double")


def epoch_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(signals(spark, sf_dir), 4, 64, 8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"epoch_features": epoch_feature_rows}
