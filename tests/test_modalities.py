"""Modalities stored in buckets: joined without a shuffle, scaled by sample, whole or an error."""

import numpy as np
import pytest
from tidemark.sources import modalities as m


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path, g = tmp_path_factory.mktemp("mods"), np.random.default_rng(0)
    data = {f"s{i}": (g.normal(size=(3, 20)) * 5 + 2, g.normal(size=7), g.normal(size=4) * 0 + 3, "ACF"[i % 3]) for i in range(40)}
    sig = spark.createDataFrame([(k, y, e.tolist()) for k, (e, _, _, y) in data.items()], "sample string, label string, x array<array<double>>")
    m.store(sig.repartition(5), "mod_signal", f"{path}/signal", 4)
    for name, i in (("mod_one", 1), ("mod_two", 2)):
        m.store(spark.createDataFrame([(k, v[i].tolist()) for k, v in data.items()], "sample string, x array<double>"), name, f"{path}/{name}", 4)
    yield data, path
    for t in ("mod_signal", "mod_one", "mod_two"):
        spark.sql(f"drop table if exists {t}")


def test_joined_without_an_exchange(spark, stored):
    df = m.load(spark, "mod_signal", ["mod_one", "mod_two"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and "Python" not in plan
    assert df.count() == 40


def test_scaled_within_each_sample(spark, stored):
    data, _ = stored
    got = m.load(spark, "mod_signal", ["mod_one", "mod_two"]).collect()
    assert len(got) == 40
    for r in got:
        e, one, _, y = data[r.sample]
        assert r.label == {"A": 0, "C": 1, "F": 2}[y]
        assert np.allclose(r.time, (e - e.mean(axis=1, keepdims=True)) / e.std(axis=1, keepdims=True))
        assert np.allclose(r.mod_one, (one - one.mean()) / one.std()) and list(r.mod_two) == [0.0] * 4
    raw = {r.sample: r for r in m.load(spark, "mod_signal", ["mod_one"], normalize=False).collect()}
    assert all(np.array_equal(raw[k].time, v[0]) and np.array_equal(raw[k].mod_one, v[1]) for k, v in data.items())


def test_a_sample_that_a_table_lacks_is_an_error(spark, stored, tmp_path):
    data, _ = stored
    m.store(spark.createDataFrame([(k, [1.0]) for k in data if k != "s7"], "sample string, x array<double>"), "mod_less", f"{tmp_path}/less", 4)
    try:
        with pytest.raises(Exception, match="sample s7 lacks mod_less"):
            m.load(spark, "mod_signal", ["mod_one", "mod_less"]).collect()
    finally:
        spark.sql("drop table mod_less")


def test_null_names_repeated_modalities_and_odd_lists(spark, tmp_path):
    with pytest.raises(Exception, match="without a name"):
        m.store(spark.createDataFrame([(None, [1.0])], "sample string, x array<double>"), "mod_null", f"{tmp_path}/null", 2)
    spark.sql("drop table if exists mod_null")
    with pytest.raises(ValueError):
        m.load(spark, "a", ["b", "b"])
    df = spark.createDataFrame([([],), (None,), ([1e9, 1e9 + 1],), ([5.0],)], "x array<double>")
    got = [r.y for r in df.select(m.scaled(df.x).alias("y")).collect()]
    assert got == [[], None, [-1.0, 1.0], [0.0]]
