"""The named features on synthetic signals, and as rows."""

import numpy as np
import pytest
from tidemark.functions import extract
from tidemark.functions.signal import BANDS

DIR = "/root/testdata/sf0.001"
REGIONS = {"left": [0, 1, 2], "right": [3, 4]}


@pytest.fixture(scope="module")
def features():
    rng = np.random.default_rng(3)
    t = np.arange(1000) / 250
    x = rng.normal(size=(5, 1000)) + 3 * np.sin(2 * np.pi * 10 * t)
    return extract.epoch_features(x, 250, 500, REGIONS)


def test_names_and_values(features):
    # (18 spectral + 3 of the line + 6 of shape) of 5 channels and 2 regions; 4 measures x 5 bands of 5 nodes, 3 pairs of regions, 1 global
    assert len([n for n in features if not n.startswith("conn")]) == (18 + 3 + 6) * 7 and len([n for n in features if n.startswith("conn")]) == 20 * 9
    assert all(np.isfinite(v) for v in features.values())


def test_shares_sum_to_one(features):
    for i in range(5):
        assert sum(features[f"spec__relpow__{b}__ch{i}"] for b in BANDS) == pytest.approx(1)


def test_alpha_peak(features):
    assert all(abs(features[f"spec__peak_freq__all__ch{i}"] - 10) <= 0.5 for i in range(5))
    assert features["connG__coh__alpha__global"] > features["connG__coh__gamma__global"]


def test_regions_are_means_of_channels(features):
    assert features["specR__abspow__alpha__left"] == pytest.approx(np.mean([features[f"spec__abspow__alpha__ch{i}"] for i in range(3)]))
    for key in ("coh__alpha", "wpli__beta", "aec__theta"):
        nodes = np.mean([features[f"conn__{key}__ch{i}"] for i in range(5)])
        assert features[f"connG__{key}__global"] == pytest.approx(nodes)
        parts = [features[f"connR__{key}__{p}"] * n for p, n in (("left-left", 3), ("left-right", 6), ("right-right", 1))]
        assert sum(parts) / 10 == pytest.approx(nodes)


def test_rows(spark):
    got = extract.epoch_feature_rows(spark, DIR)
    names = {r.name for r in got.select("name").distinct().collect()}
    n = spark.read.parquet(f"{DIR}/embeddings.parquet").count()
    assert got.count() == n * len(names) and got.groupBy("epoch", "name").count().where("count > 1").isEmpty()
    assert got.where("name = 'specR__relpow__alpha__front' and (value < 0 or value > 1)").isEmpty()


def test_silence_and_no_rows(spark):
    quiet = spark.createDataFrame([(1, [0.0] * 64)], "epoch long, x array<double>")
    got = {r.name: r.value for r in extract.extract(quiet, 4, 64, 8).collect()}
    assert got["spec__abspow__total__ch0"] is None and got["connG__aec__alpha__global"] == pytest.approx(0)
    assert extract.extract(quiet.limit(0), 4, 64, 8).isEmpty()
