"""Grouped permutation importance against NumPy: 5 draws, all repeats and folds, subject-level scores, mean and SD over splits."""

import hashlib

import numpy as np
import pytest
from tidemark.plans import catalog

DIR = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def scores(x, m, subject, label):
    """Balanced accuracy, macro AUC and the AUC of each class over the subjects."""
    d = ((x[:, None] - m) ** 2).sum(axis=2)
    p = np.exp(d.min(axis=1, keepdims=True) - d)
    p = np.log(np.clip(p / p.sum(axis=1, keepdims=True), 1e-7, 1))
    names = sorted(set(subject.tolist()))
    g = np.stack([p[subject == s].mean(axis=0) for s in names])
    q = np.exp(g - g.max(axis=1, keepdims=True))
    q = np.round(q / q.sum(axis=1, keepdims=True), 12)
    y = np.array([label[s] for s in names])
    recall = [np.mean(q[y == k].argmax(axis=1) == k) for k in (0, 1, 2)]
    auc = [np.mean([(a > b) + 0.5 * (a == b) for a in q[y == k, k] for b in q[y != k, k]]) for k in (0, 1, 2)]
    return np.array([np.mean(recall), np.mean(auc), *auc])


def test_importance_over_all_splits_and_draws(spark):
    rows = sorted((r for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect() if r.label < 3), key=lambda r: r.vec_id)
    x, epoch, subject = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows]), np.array([r.label * 8 + r.vec_id % 8 for r in rows])
    label = {int(s): int(s) // 8 for s in set(subject.tolist())}
    y = subject // 8
    drops = {g: [] for g in range(4)}
    for r in range(10):
        fold = {s: i % 5 for k in (0, 1, 2) for i, s in enumerate(sorted((s for s in label if label[s] == k), key=lambda s: (md5(f"{s}#{42 + 1000 * r}"), s)))}
        f = np.array([fold[s] for s in subject])
        for k in range(5):
            m = np.stack([x[(f != k) & (y == c)].mean(axis=0) for c in (0, 1, 2)])
            xt, st, et = x[f == k], subject[f == k], epoch[f == k]
            base = scores(xt, m, st, label)
            for g in range(4):
                found = []
                for draw in range(5):
                    other = sorted(range(len(et)), key=lambda i: md5(f"{et[i]}#{r}#{g}#{draw}#s"))
                    xp = xt.copy()
                    xp[:, 16 * g : 16 * g + 16] = xt[other][:, 16 * g : 16 * g + 16]
                    found.append(base - scores(xp, m, st, label))
                drops[g].append(np.mean(found, axis=0))
    got = {w.grp: w for w in catalog.queries()["perm_importance"](spark, DIR).collect()}
    for g, d in drops.items():
        assert [got[g][f"drop_{n}"] for n in ("bal_acc", "macro_auc", "auc_ad", "auc_cn", "auc_ftd")] == pytest.approx(np.mean(d, axis=0).tolist(), abs=2e-6)
        assert [got[g][f"drop_{n}_sd"] for n in ("bal_acc", "macro_auc", "auc_ad", "auc_cn", "auc_ftd")] == pytest.approx(np.std(d, axis=0, ddof=1).tolist(), abs=2e-6)
