"""The line and peaks of made spectra are found again; each spectrum's fit does not depend on its neighbours."""

import numpy as np
import pytest
from tidemark.functions import aperiodic as a

F = np.arange(0, 100.25, 0.5)


def spectra(offset, exponent, peaks, noise=0.0, seed=0):
    """Powers of a line and peaks of centre, height and full width."""
    f = np.where(F > 0, F, 1)
    y = np.asarray(offset)[:, None] - np.asarray(exponent)[:, None] * np.log10(f)
    for i, own in enumerate(peaks):
        for c, h, w in own:
            y[i] += h * np.exp(-((F - c) ** 2) / (2 * (w / 2) ** 2))
    return 10 ** (y + noise * np.random.default_rng(seed).normal(size=y.shape))


def test_lines_without_peaks_are_exact():
    off, exp = np.array([1.0, -3.0, 0.0]), np.array([1.0, 2.2, 0.0])
    got = a.fit(F, spectra(off, exp, [[], [], []]))
    assert np.allclose(got.offset, off) and np.allclose(got.exponent, exp) and np.isnan(got.peaks).all()
    assert got.r2[:2] == pytest.approx(1)


def test_known_peaks_are_found_without_noise():
    want = [[(10, 0.8, 2.0)], [(6, 0.5, 2.0), (20, 1.0, 4.0)], [(10, 1.2, 3.0), (22, 0.6, 3.0), (32, 0.4, 3.0)]]
    off, exp = np.array([1.0, 0.5, 2.0]), np.array([1.0, 1.5, 0.8])
    got = a.fit(F, spectra(off, exp, want))
    assert np.abs(got.offset - off).max() < 0.03 and np.abs(got.exponent - exp).max() < 0.03 and got.r2.min() > 0.99
    for own, p in zip(want, got.peaks, strict=True):
        p = p[~np.isnan(p[:, 0])]
        assert len(p) == len(own) and np.abs(p - own)[:, 0].max() < 0.15 and np.abs(p - own)[:, 1].max() < 0.1 and np.abs(p - own)[:, 2].max() < 0.5


def test_known_peaks_are_found_in_noise_on_many_spectra():
    g = np.random.default_rng(1)
    n = 300
    off, exp = g.uniform(-1, 2, n), g.uniform(0.5, 2.5, n)
    own = [[(c, h, w)] for c, h, w in zip(g.uniform(7, 14, n), g.uniform(0.5, 1.2, n), g.uniform(2, 4, n), strict=True)]
    got = a.fit(F, spectra(off, exp, own, 0.04))
    assert np.median(np.abs(got.exponent - exp)) < 0.05 and np.median(np.abs(got.offset - off)) < 0.06
    nearest = np.nanargmin(np.abs(got.peaks[..., 0] - np.array(own)[:, 0, :1]), axis=1)
    found = got.peaks[np.arange(n), nearest]
    error = np.abs(found - np.array(own)[:, 0])
    # noise now and then makes a peak start too narrow, and what is left of it becomes a second one beside it
    assert (np.median(error, axis=0) < (0.1, 0.05, 0.15)).all() and np.mean(error[:, 0] < 0.3) > 0.9 and np.mean(error[:, 1] < 0.15) > 0.9
    # a straight line alone takes the peak for a change of slope
    m = (F >= 1) & (F <= 40)
    _, slope = a.line(np.log10(F[m]), np.log10(spectra(off, exp, own, 0.04)[:, m]))
    assert np.abs(got.exponent - exp).mean() < 0.5 * np.abs(-slope - exp).mean()


def test_the_joint_fit_never_worsens_the_start_and_keeps_bounds():
    g = np.random.default_rng(2)
    f = F[(F >= 1) & (F <= 40)]
    flat = np.abs(g.normal(size=(50, len(f)))) * 0.1 + a.gaussians(f, np.tile([[12.0, 1.0, 1.5]], (50, 1))[:, None])[:, 0]
    start, there = a._guess(f, flat)
    cost = lambda p: (((there[..., None] * a.gaussians(f, p)).sum(axis=1) - flat) ** 2).sum(axis=1)
    p = a._joint(f, flat, start, there)
    assert (cost(p) <= cost(start) + 1e-12).all() and cost(p).mean() < cost(start).mean()
    assert (p[there][:, 1] >= 0).all() and (p[there][:, 2] >= 0.5).all() and (p[there][:, 2] <= 4).all()


def test_a_spectrum_alone_and_among_others():
    p = spectra(np.array([1.0, 0.0]), np.array([1.0, 2.0]), [[(10, 1, 2)], [(20, 0.7, 3)]], 0.03)
    both, one = a.fit(F, p), a.fit(F, p[1:])
    assert both.offset[1] == pytest.approx(one.offset[0], abs=1e-9) and np.allclose(both.peaks[1], one.peaks[0], equal_nan=True, atol=1e-6)


def test_cases_without_a_fit():
    p = spectra(np.ones(3), np.ones(3), [[], [], []])
    p[0, 20], p[1, 20] = 0, np.nan
    got = a.fit(F, p)
    assert np.isnan(got.offset[:2]).all() and got.offset[2] == pytest.approx(1)
    assert np.isnan(a.fit(np.arange(5.0), np.ones((2, 5))).exponent).all() and len(a.fit(F, p[:0]).r2) == 0


def test_epochs_in_spark(spark):
    t = np.arange(512) / 128
    g = np.random.default_rng(3)
    x = [(i, [*(g.normal(size=512).cumsum() * 0.3 + 3 * np.sin(2 * np.pi * 10 * t)).tolist(), *([0.0] * 512)]) for i in range(6)]
    df = spark.createDataFrame(x, "epoch long, x array<double>").repartition(3)
    got = sorted(a.fits(df, 2, 128, 256).collect(), key=lambda r: (r.epoch, r.channel))
    assert [(r.epoch, r.channel) for r in got] == [(i, c) for i in range(6) for c in (0, 1)]
    assert all(r.offset is None and r.peaks == [] for r in got if r.channel == 1)
    assert all(min(abs(p.centre - 10) for p in r.peaks) < 0.5 and r.exponent > 0.5 for r in got if r.channel == 0)
    assert a.fits(df.limit(0), 2, 128, 256).collect() == []
