"""Metric bundles, ROC bands and paired models: against DuckDB by another way, and against NumPy."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from tidemark.operators import reports as r
from tidemark.plans import catalog
from tidemark.plans.portable import frame

DIR = "/root/testdata/sf0.001"
SCHEMA = "repeat long, fold long, subject long, y long, k long, p double"


@pytest.mark.parametrize("name", ["class_bundle", "metric_bundle", "roc_bands", "roc_mean_auc", "paired_diff", "paired_wins", "feature_inputs"])
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = catalog.queries()[name](spark, DIR), con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    key = lambda row: [str(v) for v in row if not isinstance(v, float)]
    a, b = sorted(map(tuple, got.collect()), key=key), sorted((tuple(row[i] for i in order) for row in want.fetchall()), key=key)
    assert len(a) == len(b) > 0 and all(x == y or x == pytest.approx(y, abs=2e-6) for m, n in zip(a, b, strict=True) for x, y in zip(m, n, strict=True))


def made(seed, classes, subjects=23, repeats=3, missing=None):
    g = np.random.default_rng(seed)
    out = []
    for rep in range(repeats):
        for s in range(subjects):
            y = s % classes
            y = 0 if y == missing else y
            p = np.round(g.dirichlet(np.ones(classes)) * 0.6 + 0.4 * (np.arange(classes) == y) * (g.random() < 0.7), 1)  # many ties
            out += [(rep, s % 4, s, y, k, float(p[k])) for k in range(classes)]
    return out


def auc(y, p):
    return np.mean([(a > b) + 0.5 * (a == b) for a in p[y] for b in p[~y]]) if 0 < y.sum() < len(y) else None


@pytest.mark.parametrize(("classes", "missing"), [(2, None), (3, None), (4, 2)])
def test_bundle_equals_numpy(spark, classes, missing):
    rows = made(classes, classes, missing=missing)
    got = {(x.repeat, x.scope): x for x in r.metric_bundle(r.class_bundle(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got) == 3 * 5
    for (rep, scope), x in got.items():
        own = [v for v in rows if v[0] == rep and scope in ("all", f"fold {v[1]}")]
        y, p = np.array([v[3] for v in own[::classes]]), np.array([v[5] for v in own]).reshape(-1, classes)
        pred = p.argmax(axis=1)
        f1 = [2 * ((y == k) & (pred == k)).sum() / max(((y == k).sum() + (pred == k).sum()), 1) for k in range(classes)]
        aucs = [auc(y == k, p[:, k]) for k in range(classes)]
        assert x.n == len(y) and x.accuracy == pytest.approx((y == pred).mean()) and x.macro_f1 == pytest.approx(np.mean(f1))
        assert x.balanced_accuracy == pytest.approx(np.mean([(pred[y == k] == k).mean() for k in set(y)]))
        assert x.log_loss == pytest.approx(-np.log(np.clip(p[np.arange(len(y)), y], 1e-7, 1)).mean())
        known = [a for a in aucs if a is not None]
        assert x.macro_auc == (pytest.approx(np.mean(known)) if classes > 2 and known else aucs[1] and pytest.approx(aucs[1]))


@pytest.mark.parametrize("points", [2, 11, 201])
def test_curves_equal_interpolation(spark, points):
    rows = made(9, 3, subjects=31)
    curves = r.roc_curves(spark.createDataFrame(rows, SCHEMA), points)
    got = {(x.repeat, x.k, x.g): x.tpr for x in curves.collect()}
    assert len(got) == curves.count() == 3 * 3 * points
    grid, mean = np.linspace(0, 1, points), {}
    for rep in range(3):
        for k in range(3):
            own = [v for v in rows if v[0] == rep and v[4] == k]
            y, p = np.array([v[3] == k for v in own]), np.array([v[5] for v in own])
            cut = sorted(set(p), reverse=True)
            fpr, tpr = [0, *(np.mean(p[~y] >= c) for c in cut)], [0, *(np.mean(p[y] >= c) for c in cut)]
            want = np.array([got[rep, k, g] for g in range(points)])
            near = np.interp(grid + 1e-12, fpr, tpr)  # a place on an upright stretch takes its top
            assert np.allclose(want, near, atol=1e-9)
            mean.setdefault(k, []).append(near)
    bands = {(x.k, x.g): x for x in r.roc_bands(curves).collect()}
    for k, v in mean.items():
        assert np.allclose([bands[k, g].lo for g in range(points)], np.percentile(v, 2.5, axis=0)) and np.allclose([bands[k, g].hi for g in range(points)], np.percentile(v, 97.5, axis=0))
    areas = {x.k: x.auc for x in r.roc_mean_auc(r.roc_bands(curves)).collect()}
    assert all(areas[k] == pytest.approx(np.trapezoid(np.mean(v, axis=0), grid)) for k, v in mean.items())


def test_absent_class_and_empty(spark):
    one = spark.createDataFrame([(0, 0, s, 0, k, 0.5) for s in range(3) for k in (0, 1)], SCHEMA)
    assert r.roc_curves(one).count() == 0
    x = r.metric_bundle(r.class_bundle(one)).where("scope = 'all'").first()
    assert (x.n, x.balanced_accuracy, x.accuracy, x.macro_auc) == (3, 1.0, 1.0, None) and x.macro_f1 == 0.5
    none = one.limit(0)
    assert r.metric_bundle(r.class_bundle(none)).count() == r.roc_mean_auc(r.roc_bands(r.roc_curves(none))).count() == 0


def test_paired_models_that_differ_raise(spark):
    a = spark.createDataFrame([(0, s, s % 2, s % 2) for s in range(4)], "repeat long, subject long, y long, pred long")
    for other in (a.where("subject < 3"), a.selectExpr("repeat", "subject", "1 - y as y", "pred"), a.union(a.selectExpr("repeat", "subject + 9 as subject", "y", "pred"))):
        with pytest.raises(Exception, match="differ in their subjects or labels"):
            frame(spark, "", "paired_verdicts", {"verdicts": a, "prior_verdicts": other}).collect()
    assert frame(spark, "", "paired_verdicts", {"verdicts": a, "prior_verdicts": a}).count() == 4
