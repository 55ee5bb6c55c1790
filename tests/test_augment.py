"""Augmented epochs: shares and ranges of the kinds, the same rows on any partitioning, and DuckDB's other way."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from tidemark.functions import augment as a

CHANNELS, SAMPLES = 5, 8


@pytest.fixture(scope="module")
def epochs(spark):
    g = np.random.default_rng(0)
    return spark.createDataFrame([(i, (g.normal(size=CHANNELS * SAMPLES) + 10).tolist()) for i in range(4000)], "epoch long, x array<double>")


def rows(df):
    return {(r.epoch, r.draw): (r.kind, None if r.x is None else tuple(r.x)) for r in df.collect()}


def test_the_same_rows_on_one_and_on_eight_partitions(epochs):
    some = epochs.where("epoch < 300")
    one = rows(a.augmented(some.coalesce(1), CHANNELS, 3, 5))
    assert one == rows(a.augmented(some.repartition(8), CHANNELS, 3, 5)) and len(one) == 900
    other = rows(a.augmented(some, CHANNELS, 3, 6))
    assert sum(one[k] == other[k] for k in one) < 300


def test_shares_and_ranges_of_the_kinds(epochs):
    was = {r.epoch: np.array(r.x) for r in epochs.collect()}
    got = [(k, np.array(x), was[e]) for (e, _), (k, x) in rows(a.augmented(epochs, CHANNELS)).items()]
    n = Counter(k for k, *_ in got)
    assert all(abs(n[k] / 4000 - p) < 0.03 for k, p in (("noise", 0.3), ("scaling", 0.2), ("dropout", 0.1), ("none", 0.4)))
    assert all((x == y).all() for k, x, y in got if k == "none")
    factor = np.array([x / y for k, x, y in got if k == "scaling"])
    assert np.ptp(factor, axis=1).max() < 1e-12 and factor.min() >= 0.9 and factor.max() <= 1.1 and abs(factor.mean() - 1) < 0.01
    level = np.array([(x - y).std() for k, x, y in got if k == "noise"])
    added = np.concatenate([x - y for k, x, y in got if k == "noise"])
    assert level.max() < 0.08 and level.min() > 0.004 and abs(added.mean()) < 5e-4 and abs(level.mean() - 0.03) < 0.002
    unit = np.concatenate([(x - y) / (x - y).std() for k, x, y in got if k == "noise"])
    assert abs((np.abs(unit) < 1).mean() - 0.683) < 0.02
    lost = [(x.reshape(CHANNELS, -1) == 0).all(axis=1) for k, x, y in got if k == "dropout"]
    assert all((x.reshape(CHANNELS, -1)[~z] == y.reshape(CHANNELS, -1)[~z]).all() for z, (x, y) in zip(lost, [(x, y) for k, x, y in got if k == "dropout"], strict=True))
    share = Counter(int(z.sum()) for z in lost)
    assert set(share) == {1, 2, 3} and min(share.values()) > 0.25 * len(lost)
    assert np.ptp(np.sum(lost, axis=0)) < 0.3 * np.mean(np.sum(lost, axis=0))


def test_nulls_few_channels_and_empty_tables(spark, epochs):
    df = spark.createDataFrame([(1, None), (None, [1.0, 2.0]), (None, [1.0, 2.0])], "epoch long, x array<double>")
    got = a.augmented(df, 2, 20).collect()
    assert len(got) == 60 and all(r.x is None for r in got if r.epoch == 1)
    assert all(len(r.x) == 2 for r in got if r.epoch is None)
    assert a.augmented(epochs.limit(0), CHANNELS).collect() == []


def test_no_shuffle_and_no_python(epochs):
    plan = a.augmented(epochs, CHANNELS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_equals_duckdb(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    want = {(e, d, i): (k, v) for e, d, k, i, v in con.sql(a.SQL).fetchall()}
    got = {(r.epoch, r.draw, r.i): (r.kind, r.v) for r in a.augmented_samples(spark, path).collect()}
    assert set(got) == set(want) and len(got) == 64000 and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in got)
