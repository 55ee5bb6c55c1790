"""Models of covariances against NumPy means of the training epochs alone."""

import numpy as np
from tidemark.functions import riemann
from tidemark.operators import curved

DIR = "/root/testdata/sf0.001"


def local(spark):
    rows = curved.labelled(spark, DIR).collect()
    return rows, np.array([r.cov for r in rows]).reshape(-1, curved.N_BANDS, 4, 4), np.array([r.fold for r in rows]), np.array([r.label for r in rows])


def test_tangent_vectors_are_at_the_training_mean(spark):
    rows, covs, fold, _ = local(spark)
    place = {r.epoch: i for i, r in enumerate(rows)}
    got = curved.riemann_tangent(spark, DIR).collect()
    assert len(got) == len(rows) * curved.FOLDS and all((r.role == "test") == (fold[place[r.epoch]] == r.fold) for r in got)
    for f in (0, 3):
        some = [r for r in got if r.fold == f]
        want = np.concatenate([riemann.tangent(covs[:, b], riemann.mean(covs[fold != f, b])) for b in range(curved.N_BANDS)], axis=1)
        assert np.allclose([r.tangent for r in some], want[[place[r.epoch] for r in some]], atol=1e-6)
        assert np.allclose(np.mean([r.tangent for r in some if r.role == "train"], axis=0), 0, atol=1e-6)


def test_nearest_class_mean(spark):
    rows, covs, fold, label = local(spark)
    got = {r.epoch: r for r in curved.riemann_mdm(spark, DIR).collect()}
    assert len(got) == len(rows)
    f = fold[0]
    means = [[riemann.mean(covs[(fold != f) & (label == k), b]) if ((fold != f) & (label == k)).any() else np.eye(4) for b in range(curved.N_BANDS)] for k in range(3)]
    for i in np.flatnonzero(fold == f):
        d = np.array([sum(riemann.distance2(covs[i, b][None], m[b])[0] for b in range(curved.N_BANDS)) for m in means])
        p = np.exp(-d / d.mean())
        assert np.allclose(got[rows[i].epoch].proba, p / p.sum(), atol=1e-6) and got[rows[i].epoch].prediction == d.argmin()


def test_no_rows_give_the_identity(spark):
    none = spark.createDataFrame([], "epoch long, subject long, label long, fold long, cov array<double>")
    assert np.allclose(curved.training_means(none, curved.by_fold, curved.FOLDS), np.eye(4))
