import numpy as np
import pytest
from tidemark.functions import riemann, signal
from tidemark.operators import models
from tidemark.plans import catalog

DIR = "/root/testdata/sf0.001"


def test_band_filter_keeps_its_band():
    t = np.arange(1000) / 100
    x = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 2 * t)
    assert np.abs(signal.band_filter(x, 100, 8, 13) - np.sin(2 * np.pi * 10 * t))[100:-100].max() < 0.05


def test_resample_sine():
    x = np.sin(2 * np.pi * 10 * np.arange(2500) / 250)[None]
    y = signal.resample(x, 200, 250)
    assert y.shape == (1, 2000) and np.abs(y[0] - np.sin(2 * np.pi * 10 * np.arange(2000) / 200))[100:-100].max() < 1e-2
    assert signal.resample(x, 5, 5) is x


def test_wavelets():
    low = np.array(signal.DB4)
    assert low.sum() == pytest.approx(np.sqrt(2)) and (low**2).sum() == pytest.approx(1)
    d = signal.dwt(np.ones(64), 3)
    assert all(np.allclose(x, 0, atol=1e-9) for x in d[:-1]) and np.allclose(d[-1], 8**0.5)
    p = signal.cwt_power(np.sin(2 * np.pi * np.arange(512) / 16), np.array([2.0, 16 * 5 / (2 * np.pi), 60.0]))
    assert p.argmax() == 1


def test_riemann():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(20, 4, 30))
    covs = a @ np.swapaxes(a, 1, 2) / 30
    m = riemann.mean(covs)
    assert np.allclose(riemann.tangent(covs, m).mean(axis=0), 0, atol=1e-6)
    assert np.allclose(riemann.mean(np.stack([np.eye(3), 4 * np.eye(3)])), 2 * np.eye(3))
    p = riemann.mdm_proba(covs, np.stack([covs[0], m]))
    assert np.allclose(p.sum(axis=1), 1) and p[0, 0] > 0.5


@pytest.mark.parametrize("recipe", ["lr", "rf", "linsvm"])
def test_models_learn_and_hold_subjects_apart(spark, recipe):
    rng = np.random.default_rng(1)
    rows = [(s, s % 3, s * 10 + i, (rng.normal(size=3) + 4 * np.eye(3)[s % 3]).tolist()) for s in range(18) for i in range(4)]
    epochs = spark.createDataFrame(rows, "subject long, label int, epoch long, x array<double>")
    folds = spark.createDataFrame([(s, s // 9) for s in range(18)], "subject long, fold long")
    got = models.cross_validate(epochs, folds, recipe).collect()
    assert len(got) == len(rows) and np.mean([r.label == r.prediction for r in got]) > 0.9 and all(r.fold == r.subject // 9 for r in got)


def test_registered_numeric_rows(spark):
    for name in ("signal_features", "riemann_tangent", "complexity", "lr_cv"):
        assert catalog.queries()[name](spark, DIR).count() > 0
