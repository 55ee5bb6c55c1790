"""Boosted trees of many splits at once, against a plain machine that cuts one leaf at a time on one split's rows."""

import numpy as np
import pytest
from tidemark.operators import boosted as b
from tidemark.operators import nested as n
from tidemark.operators import training as t

FOLDS = 3
GROWTH = b.Growth(least=4)
GRID = [(3, 6, 0.2), (7, 12, 0.1)]
SCHEMA = ("subject long, label int, epoch long, x array<double>", "repeat long, fold long, subject long", "repeat long, fold long, subject long, part long")


def made(seed=0, per=16, lacking=0.1, width=6):
    """Three classes that no straight cut parts: the second feature counts only by its distance from the first."""
    g = np.random.default_rng(seed)
    epochs, folds, inner = [], [], []
    for s in range(3 * per):
        y = s % 3
        for _ in range(g.integers(3, 7)):
            x = g.normal(size=width)
            x[1] = x[0] + (y - 1) * 1.5 + 0.4 * x[1]
            x[2] = np.round(x[2])
            x[g.random(width) < lacking] = np.nan
            epochs.append((s, y, len(epochs), x.tolist()))
        fold = s // 3 % FOLDS
        folds.append((0, fold, s))
        inner += [(0, f, s, s // 9 % 2) for f in range(FOLDS) if f != fold]
    return epochs, folds, inner


def frames(spark, data):
    return [spark.createDataFrame(d, s) for d, s in zip(data, SCHEMA, strict=True)]


def fitted(spark, data, splits, grid=GRID, parts=3, growth=GROWTH, candidates=None):
    e, f, i = frames(spark, data)
    with t.Rows(t.packed(e.repartition(parts), f, i, 1, FOLDS), 1) as rows:
        blocks = [t.unpacked(r, 1) for r in rows.frame.collect()]
        return b.fit(rows, grid, splits, candidates or [range(len(grid))] * len(splits), len(data[0][0][3]), 3, 0, growth), blocks


def plain_tree(codes, g, h, features, leaves, rate, growth):
    """Value of every row of codes under a tree grown on rows where h > 0 (others only pass down)."""
    worth = lambda i: g[i].sum() ** 2 / (h[i].sum() + growth.penalty)

    def best(node):
        found = (0.0, None)
        own = node[h[node] > 0]
        for f in features:
            for cut in range(b.BINS - 1):
                for side in (False, True):
                    left = lambda i, f=f, cut=cut, side=side: np.where(codes[i, f] == b.BINS, side, codes[i, f] <= cut)
                    lo, hi = own[left(own)], own[~left(own)]
                    if min(len(lo), len(hi)) < growth.least or min(h[lo].sum(), h[hi].sum()) < growth.curvature:
                        continue
                    gain = worth(lo) + worth(hi) - worth(own)
                    if gain > found[0] + 1e-9:
                        found = (gain, left)
        return found

    tips = [(np.arange(len(g)), *best(np.arange(len(g))))]
    while len(tips) < leaves and max(x[1] for x in tips) > 0:
        at = max(range(len(tips)), key=lambda i: tips[i][1])
        node, _, left = tips.pop(at)
        tips += [(c, *best(c)) for c in (node[left(node)], node[~left(node)])]
    out = np.zeros(len(g))
    if len(tips) > 1:
        for node, *_ in tips:
            own = node[h[node] > 0]
            out[node] = -rate * g[own].sum() / (h[own].sum() + growth.penalty)
    return out


def test_equals_a_plain_machine(spark):
    data = made(1, per=9)
    split, (leaves, trees, rate) = (0, 1, -1), (5, 4, 0.3)
    forest, blocks = fitted(spark, data, [split, (0, 0, 1)], [(leaves, trees, rate)])
    x, y, hash_, train = (np.concatenate([f(k) for k in blocks]) for f in (lambda k: k.x, lambda k: k.y, lambda k: k.hash, lambda k: k.training(split)))
    share = np.concatenate([k.share() for k in blocks])
    w = np.where(train, forest.moments.weights(0, y, share), 0)
    codes = b.coded(x, b.edges_of(x[train]))
    score = np.full((3, len(y)), np.log(1 / 3))
    for number in range(trees):
        p = np.exp(score) / np.exp(score).sum(axis=0)
        on = w * b.bagged(hash_, number, GROWTH.rows)
        step = [plain_tree(codes, (p[k] - (y == k)) * on, 1.5 * p[k] * (1 - p[k]) * on, b.drawn(6, number, k, GROWTH.features), leaves, rate, GROWTH) for k in range(3)]
        score = score + np.array(step)
    p = np.exp(score) / np.exp(score).sum(axis=0)
    assert np.ptp(p) > 0.2 and np.allclose(forest.probabilities(0, 0, x), p.T, atol=1e-5)


def test_the_same_trees_on_every_partitioning(spark, monkeypatch):
    data, splits = made(2), [(0, f, p) for f in range(FOLDS) for p in (-1, 0)]
    one, _ = fitted(spark, data, splits, parts=1)
    monkeypatch.setattr(t, "ROWS", 17)
    monkeypatch.setattr(b, "ROUND_BYTES", 1)  # one split after another
    many, _ = fitted(spark, data, splits, parts=7)
    assert np.array_equal(one.base, many.base) and one.splits == many.splits
    x = np.array([r[3] for r in data[0]])
    for s in range(len(splits)):
        for c in range(2):
            p = one.probabilities(s, c, x)
            assert np.array_equal(p, many.probabilities(s, c, x)) and np.allclose(p.sum(axis=1), 1)
    assert all((k.feature >= 0).sum(axis=1).max() == leaves - 1 for k, (leaves, _, _) in zip(one.trees, GRID * len(splits), strict=True))


def test_accuracy_on_subjects_left_out(spark):
    data = made(3, per=24)
    forest, _ = fitted(spark, data, [(0, 0, -1)], [(7, 60, 0.2)], growth=b.Growth(least=4, features=0.6))
    fold = {s: f for _, f, s in data[1]}
    test = [r for r in data[0] if fold[r[0]] == 0]
    p = forest.probabilities(0, 0, np.array([r[3] for r in test]))
    assert (p.argmax(axis=1) == [r[1] for r in test]).mean() > 0.7


def test_lacking_classes_rows_and_values(spark):
    epochs, folds, inner = made(4)
    epochs = [(*r[:3], [*r[3][:4], float("nan"), 7.0]) for r in epochs]  # one feature unknown, one constant
    epochs[0][3][0], epochs[1][3][0] = float("inf"), float("-inf")
    folds = [(0, 0 if s % 3 == 2 else f or 1, s) for _, f, s in folds]  # all of class 2 is tested in fold 0
    forest, _ = fitted(spark, (epochs, folds, inner), [(0, 0, -1)])
    x = np.array([r[3] for r in epochs])
    p = forest.probabilities(0, 1, x)
    assert np.isfinite(p).all() and np.allclose(p[:, 2], 1e-7, rtol=1e-3) and np.ptp(p[:, 0]) > 0.1
    assert not np.isin(forest.trees[1].feature, (4, 5)).any()
    assert forest.probabilities(0, 0, x[:0]).shape == (0, 3)
    small, _ = fitted(spark, (epochs, folds, inner), [(0, 0, -1)], growth=b.Growth(least=1000))
    assert np.allclose(small.probabilities(0, 0, x)[:, :2], 0.5)  # no leaf may be cut: the equal shares of the classes


def test_as_a_family_of_the_nested_runner(spark):
    data = frames(spark, made(5, per=24, lacking=0.0))
    family = n.Family("gbt", "trees", (3, 7), shapes=((5, 0.2), (25, 0.2)), growth=b.Growth(least=4, features=0.6))
    chosen, got = n.evaluate(spark, *data, [n.FAMILIES["prior"], family])
    assert {r.fold: r.family for r in chosen.collect()} == dict.fromkeys(range(FOLDS), "gbt")
    rows = n.subject_rows(got).collect()
    assert {r.subject for r in rows} == set(range(72)) and sum(r.p for r in rows) == pytest.approx(72)
    right = sum(max((r for r in rows if r.subject == s), key=lambda r: r.p).k == s % 3 for s in range(72))
    assert right > 48
