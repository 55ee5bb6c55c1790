"""Features that are no relational algebra: NumPy over Arrow batches of epochs, one row in, one row out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.signal import BANDS, band_filter, cwt_power, resample, wavelet_row


def welch(x: np.ndarray, rate: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of segments of that size with half overlap, periodic Hann window and mean removed, averaged."""
    size = min(size, x.shape[-1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., :: max(1, size // 2), :]
    f = np.fft.rfft((parts - parts.mean(axis=-1, keepdims=True)) * window)
    p = np.abs(f) ** 2 / (rate * (window**2).sum())
    p[..., 1 : None if size % 2 else -1] *= 2
    return np.fft.rfftfreq(size, 1 / rate), p.mean(axis=-2)


def permutation_entropy(x: np.ndarray, order: int = 5, delay: int = 2) -> float:
    """Entropy of ordinal patterns over the logarithm of their number."""
    v = np.lib.stride_tricks.sliding_window_view(x, (order - 1) * delay + 1)[:, ::delay]
    code = np.argsort(v, axis=1, kind="stable") @ (order ** np.arange(order))
    p = np.unique(code, return_counts=True)[1] / len(code)
    return float(-(p * np.log2(p)).sum() / np.log2(np.prod(np.arange(1.0, order + 1))))


def sample_entropy(x: np.ndarray, order: int = 2, share: float = 0.2) -> float:
    """-ln of the chance that runs alike over order points stay alike for one more; NaN where none are."""
    tolerance = share * x.std()

    def alike(m: int) -> int:
        v = np.lib.stride_tricks.sliding_window_view(x, m)[: len(x) - order]
        return int((np.abs(v[:, None] - v[None]).max(axis=2) <= tolerance).sum()) - len(v)

    a, b = alike(order + 1), alike(order)
    return float(-np.log(a / b)) if a and b else float("nan")


def higuchi(x: np.ndarray, most: int = 10) -> float:
    """Fractal dimension: slope of log curve length against log 1/k."""
    n, lengths = len(x), []
    for k in range(1, most + 1):
        own = []
        for m in range(k):
            steps = np.abs(np.diff(x[m::k]))
            if len(steps):
                own.append(steps.sum() * (n - 1) / (len(steps) * k * k))
        lengths.append(np.mean(own))
    k = np.arange(1, most + 1)
    return float(np.polyfit(np.log(1 / k), np.log(np.maximum(lengths, 1e-300)), 1)[0])


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by the FFT."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def envelope_correlation(x: np.ndarray) -> np.ndarray:
    e = np.abs(analytic(x))
    e -= e.mean(axis=-1, keepdims=True)
    e /= np.linalg.norm(e, axis=-1, keepdims=True) + 1e-12
    return e @ e.T


def phase_locking(x: np.ndarray) -> np.ndarray:
    u = np.exp(1j * np.angle(analytic(x)))
    return np.abs(u @ u.conj().T) / x.shape[-1]


def coherence_bins(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coherence, absolute imaginary coherency and weighted phase lag index (channel, channel, bin) of the bins above 0 Hz; symmetric Hann segments."""
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[:, :: size // 2]
    f = np.fft.rfft((parts - parts.mean(axis=-1, keepdims=True)) * np.hanning(size))[..., 1:]
    cross = np.einsum("isf,jsf->ijsf", f, f.conj())
    s = cross.mean(axis=2)
    power = np.real(np.einsum("iif->if", s))
    c = s / np.sqrt(power[:, None] * power[None] + 1e-30)
    im = np.imag(cross)
    return np.abs(c) ** 2, np.abs(np.imag(c)), np.abs(im.sum(axis=2)) / (np.abs(im).sum(axis=2) + 1e-30)


def coherence(x: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The same, mean over bins."""
    return tuple(m.mean(axis=-1) for m in coherence_bins(x, size))


def oas(x: np.ndarray) -> np.ndarray:
    """Covariance shrunk to a scaled identity by the oracle approximating estimate."""
    p, n = x.shape
    s = np.cov(x, bias=True)
    mu, alpha = np.trace(s) / p, (s**2).mean()
    d = (n + 1) * (alpha - mu**2 / p)
    r = 1.0 if d == 0 else min(1.0, (alpha + mu**2) / d)
    return (1 - r) * s + r * mu * np.eye(p)


def spectral_embedding(w: np.ndarray, k: int) -> np.ndarray:
    """The k smallest non-first eigenvectors of the normalised Laplacian, signs fixed by the largest entry."""
    a = w - np.diag(np.diag(w))
    d = 1 / np.sqrt(a.sum(axis=1) + 1e-8)
    v = np.linalg.eigh(np.eye(len(a)) - d[:, None] * a * d[None])[1][:, 1 : k + 1]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def _per_epoch(spark: SparkSession, sf_dir: str, make: Callable[[np.ndarray], dict[str, float | list[float]]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"epoch": e, **make(np.array(x, dtype=float))} for e, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows) if rows else batch.slice(0, 0).select([])

    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id as epoch", "embedding").mapInArrow(run, schema)


def complexity_row(x: np.ndarray) -> dict[str, float]:
    return {"perm_entropy": permutation_entropy(x), "sample_entropy": sample_entropy(x[::2]), "higuchi": higuchi(x)}


def connectivity_row(x: np.ndarray) -> dict[str, float]:
    c = x.reshape(4, -1)
    upper = np.triu_indices(4, 1)
    coh, imag, wpli = coherence(c, 8)
    return {"coherence": float(coh[upper].mean()), "imaginary": float(imag[upper].mean()), "wpli": float(wpli[upper].mean()), "aec": float(envelope_correlation(c)[upper].mean()), "plv": float(phase_locking(c)[upper].mean())}


def signal_row(x: np.ndarray) -> dict[str, float | list[float]]:
    energy, entropy = wavelet_row(x)
    alpha = band_filter(x, 64, *BANDS["alpha"])
    return {"alpha_power": float((alpha**2).mean()), "half_rate": resample(x, 1, 2).tolist(), "dwt_energy": energy, "dwt_entropy": entropy, "cwt_power": cwt_power(x, np.geomspace(1, 8, 8)).tolist()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "welch_psd": lambda s, d: _per_epoch(s, d, lambda x: {"psd": welch(x, 64, 32)[1].tolist()}, "epoch long, psd array<double>"),
        "complexity": lambda s, d: _per_epoch(s, d, complexity_row, "epoch long, perm_entropy double, sample_entropy double, higuchi double"),
        "connectivity": lambda s, d: _per_epoch(s, d, connectivity_row, "epoch long, coherence double, imaginary double, wpli double, aec double, plv double"),
        "signal_features": lambda s, d: _per_epoch(s, d, signal_row, "epoch long, alpha_power double, half_rate array<double>, dwt_energy array<double>, dwt_entropy array<double>, cwt_power array<double>"),
        "laplacian_embedding": lambda s, d: _per_epoch(s, d, lambda x: {"vectors": spectral_embedding(np.abs(np.corrcoef(x.reshape(4, -1))), 2).ravel().tolist()}, "epoch long, vectors array<double>"),
    }
