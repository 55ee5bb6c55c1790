"""The registered steps against DuckDB, and their meaning against NumPy."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tidemark.functions import numeric as nu
from tidemark.plans import catalog
from tidemark.plans.portable import frame
from tidemark.sources import cache
from tidemark.streaming.windows import hopping

DIR = "/root/testdata/sf0.001"
SAMPLE = ["windows_yield", "mad_reject", "yield_rollup", "average_reference", "bipolar_scale", "relative_power", "median_freq", "hjorth", "corr_edges", "folds_stratified", "leakage_check", "balanced_weights", "subject_geomean", "class_report", "auc_ovr", "per_repeat", "bootstrap_ci", "bootstrap_ci_epochs", "paired_diff", "permutation_p", "soft_vote", "perm_importance", "kruskal", "bh_fdr", "systematic_sample", "hedges_g", "top_trials", "feature_groups"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def say(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, con, name):
    got = catalog.queries()[name](spark, DIR)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted([say(v) for v in r] for r in got.collect()) == sorted([say(r[i]) for i in order] for r in want.fetchall())


def embeddings(con):
    return {e: np.array(x, dtype=float) for e, x in con.sql("select vec_id, embedding from embeddings").fetchall()}


def test_spectrum_by_fft(spark, con):
    got = {(r.epoch, r.k): r.p for r in frame(spark, DIR, "psd").collect()}
    for e, x in list(embeddings(con).items())[:50]:
        p = np.abs(np.fft.rfft(x)) ** 2 / 64**2
        p[1:-1] *= 2
        assert np.allclose([got[e, k] for k in range(33)], p)


def test_hjorth_by_numpy(spark, con):
    got = {r.epoch: r for r in catalog.queries()["hjorth"](spark, DIR).collect()}
    for e, x in list(embeddings(con).items())[:50]:
        v0, v1, v2 = x.var(), np.diff(x).var(), np.diff(x, 2).var()
        assert np.allclose([got[e].activity, got[e].mobility, got[e].complexity], [np.log(v0), np.sqrt(v1 / v0), np.sqrt(v2 / v1) / np.sqrt(v1 / v0)], atol=2e-6)


def test_windows_are_full_and_hop(spark):
    n = {r.user_id: r.n for r in frame(spark, DIR, "samples").groupBy("user_id").count().withColumnRenamed("count", "n").collect()}
    got: dict[int, list[int]] = {}
    for r in catalog.queries()["windows_sliding"](spark, DIR).collect():
        assert r.n == 16
        got.setdefault(r.user_id, []).append(r.start)
    assert {u: sorted(s) for u, s in got.items()} == {u: [*range(0, k - 15, 8)] for u, k in n.items() if k >= 16}


def test_yield_identity(spark):
    for r in catalog.queries()["windows_yield"](spark, DIR).collect():
        assert r.n_epochs == r.n_candidates - r.n_boundary - r.n_loud


def test_no_leak_and_every_subject_once(spark):
    rows = catalog.queries()["folds_stratified"](spark, DIR).collect()
    assert len({(r.repeat, r.subject) for r in rows}) == len(rows) and {r.fold for r in rows} == {0, 1, 2, 3, 4}
    assert catalog.queries()["leakage_check"](spark, DIR).first().leaks == 0


def test_probabilities_sum_to_one(spark):
    for r in frame(spark, DIR, "subject_proba").groupBy("repeat", "subject").agg({"p": "sum"}).collect():
        assert r[2] == pytest.approx(1)


def test_numeric_features():
    t = np.arange(640) / 64
    f, p = nu.welch(np.sin(2 * np.pi * 10 * t), 64, 128)
    assert f[p.argmax()] == 10 and p.sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.01)
    rng = np.random.default_rng(0)
    noise = rng.normal(size=2000)
    assert nu.permutation_entropy(np.arange(100.0)) == pytest.approx(0) and nu.permutation_entropy(noise) > 0.97
    assert nu.higuchi(np.arange(500.0)) == pytest.approx(1, abs=0.02) and nu.higuchi(noise) == pytest.approx(2, abs=0.05)
    assert nu.sample_entropy(np.sin(t)) < nu.sample_entropy(noise[:640])
    x = rng.normal(size=(4, 256))
    assert np.allclose(np.diag(nu.phase_locking(x)), 1) and np.all(np.linalg.eigvalsh(nu.oas(x)) > 0)
    c = nu.coherence(np.stack([x[0], x[0]]), 32)
    assert c[0][0, 1] == pytest.approx(1) and c[1][0, 1] == pytest.approx(0, abs=1e-9)
    assert np.allclose(np.linalg.norm(nu.spectral_embedding(np.abs(np.corrcoef(x)), 2), axis=0), 1)


def test_cache_and_sources(spark, tmp_path):
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    for config in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2}):
        assert cache.cached(spark, str(tmp_path), "t", config, make).count() == 3
    assert len(made) == 2
    (tmp_path / "p.tsv").write_text("participant_id\tGender\tAge\tGroup\tMMSE\nsub-1\tM\t70\tF\t20\n")
    assert cache.participants(spark, str(tmp_path / "p.tsv")).first().asDict() == {"subject": "sub-1", "group": "F", "diagnosis": "FTD", "age": 70.0, "sex": "M", "label": 2}
    with pytest.raises(FileNotFoundError, match="sub-2"):
        cache.require_subjects(spark.createDataFrame([("sub-1",)], "subject string"), spark.createDataFrame([("sub-1",), ("sub-2",)], "subject string"))
    cache.write_csv(spark.createDataFrame([(1, 0.1234567)], "a int, b double"), str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [("1", "0.12346")]
    assert cache.markdown(spark.createDataFrame([(1, None)], "a int, b string")).first().line == "| 1 |  |"


def test_streaming_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = hopping(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hops").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.start, r.user_id, r.n)
    assert sorted(map(key, spark.table("hops").collect())) == sorted(map(key, hopping(events).collect()))
