"""The permutation test against NumPy: labels, folds and centroids anew in every draw, subject-level balanced accuracy."""

import hashlib

import numpy as np
import pytest
from tidemark.plans import catalog
from tidemark.plans.portable import frame

DIR = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def balanced_accuracy(x, subject, label, key):
    """label: subject -> label; key: order of subjects that deals the folds of a class."""
    fold = {s: i % 5 for k in set(label.values()) for i, s in enumerate(sorted((s for s in label if label[s] == k), key=lambda s: (key(s), s)))}
    y, f = np.array([label[s] for s in subject]), np.array([fold[s] for s in subject])
    hit = {k: [] for k in set(label.values())}
    for s in label:
        train = f != fold[s]
        m = np.stack([x[train & (y == k)].mean(axis=0) for k in (0, 1, 2)])
        d = ((x[subject == s][:, None] - m) ** 2).sum(axis=2)
        p = np.exp(d.min(axis=1, keepdims=True) - d)
        p = np.clip(p / p.sum(axis=1, keepdims=True), 1e-7, 1)
        hit[label[s]].append(np.log(p).mean(axis=0).argmax() == label[s])
    return np.mean([np.mean(h) for h in hit.values()])


def test_permutation_refits_every_draw(spark):
    rows = [r for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect() if r.label < 3]
    x, subject = np.array([r.embedding for r in rows], dtype=float), np.array([r.label * 8 + r.vec_id % 8 for r in rows])
    label = {int(s): int(s) // 8 for s in sorted(set(subject))}
    observed = np.mean([balanced_accuracy(x, subject, label, lambda s, r=r: md5(f"{s}#{42 + 1000 * r}")) for r in range(10)])
    null = []
    for b in range(100):
        dealt = [label[s] for s in sorted(label, key=lambda s: md5(f"{s}#{b}"))]
        null.append(balanced_accuracy(x, subject, dict(zip(sorted(label), dealt, strict=True)), lambda s, b=b: md5(f"{s}#f{b}")))
    null = np.array(null)
    assert [r.bal for r in frame(spark, DIR, "null_scores").orderBy("b").collect()] == pytest.approx(null.tolist())
    got = catalog.queries()["permutation_p"](spark, DIR).first()
    want = [(1 + (null >= observed - 1e-9).sum()) / 101, null.mean(), null.std(ddof=1), np.percentile(null, 95)]
    assert [got.p, got.null_mean, got.null_sd, got.null_95] == pytest.approx(want, abs=2e-6)
