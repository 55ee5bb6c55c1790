"""Models of many splits at once and the nested runner, against NumPy refits of each split by itself."""

import hashlib

import numpy as np
import pytest
from tidemark.operators import nested as n
from tidemark.operators import training as t

FOLDS, PARTS = 3, 2
SCHEMA = ("subject long, label int, epoch long, x array<double>", "repeat long, fold long, subject long", "repeat long, fold long, subject long, part long")
LR, SVM = n.Family("lr", "softmax", (0.01, 1.0)), n.Family("linsvm", "hinge2", (0.001, 0.1), free_intercept=False)


def made(seed=0, classes=3, per=5, lacking=0.0):
    """Subjects of classes * per, 2 to 5 epochs each, four features; the folds deal the subjects of a class in turn."""
    g = np.random.default_rng(seed)
    epochs, folds, inner = [], [], []
    for s in range(classes * per):
        y = s % classes
        base = g.normal(size=4) * 0.7
        for _ in range(g.integers(2, 6)):
            x = base + np.array([y, -y, 0.5 * (y == 1), 0]) + g.normal(size=4)
            x[g.random(4) < lacking] = np.nan
            epochs.append((s, y, len(epochs), [*x.tolist(), 3.0]))
        fold = s // classes % FOLDS
        folds.append((0, fold, s))
        inner += [(0, f, s, s // classes % PARTS) for f in range(FOLDS) if f != fold]
    return epochs, folds, inner


def frames(spark, data):
    return [spark.createDataFrame(d, s) for d, s in zip(data, SCHEMA, strict=True)]


class Plain:
    """One split by itself."""

    def __init__(self, data, cap=0):
        self.epochs, self.folds, self.inner = data
        self.s, self.y, self.e = (np.array([r[i] for r in self.epochs]) for i in range(3))
        self.x = np.array([r[3] for r in self.epochs])
        self.fold, self.part = {s: f for _, f, s in self.folds}, {(f, s): p for _, f, s, p in self.inner}
        order = {}
        for s in set(self.s):
            own = sorted(np.flatnonzero(self.s == s), key=lambda i: hashlib.md5(str(self.e[i]).encode()).hexdigest())
            order |= {i: k for k, i in enumerate(own)}
        self.first = np.array([not cap or order[i] < cap for i in range(len(self.s))])

    def rows(self, f, p):
        train = np.array([self.fold[s] != f and (p < 0 or self.part[f, s] != p) for s in self.s]) & self.first
        test = np.array([self.fold[s] == f if p < 0 else self.fold[s] != f and self.part[f, s] == p for s in self.s])
        return train, test

    def weights(self, train):
        w = np.array([1 / (self.s[train] == s).sum() / len(set(self.s[train][self.y[train] == y])) for s, y in zip(self.s[train], self.y[train], strict=True)])
        return w / w.mean()

    def scaled(self, train):
        x = np.where(np.isnan(self.x), np.nanmedian(self.x[train], axis=0), self.x)
        sd = x[train].std(axis=0)
        return (x - x[train].mean(axis=0)) / np.where(sd > 0, sd, 1)


def newton_softmax(z, y, w, c, k=3):
    """Multinomial logistic regression with a free intercept, by full Newton steps with halving."""
    a = np.c_[z, np.ones(len(z))]
    d = a.shape[1]
    hold = np.kron(np.r_[np.ones(d - 1), 0], np.ones(k))

    def value(v):
        s = a @ v.reshape(d, k)
        m = s.max(axis=1)
        return 0.5 * (hold * v * v).sum() + c * (w * (np.log(np.exp(s - m[:, None]).sum(axis=1)) + m - s[np.arange(len(y)), y])).sum()

    v = np.zeros(d * k)
    for _ in range(60):
        s = a @ v.reshape(d, k)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = hold * v + c * (a.T @ (w[:, None] * (p - np.eye(k)[y]))).ravel()
        h = np.diag(hold + 1e-9) + c * sum(wi * np.kron(np.outer(ai, ai), np.diag(pi) - np.outer(pi, pi)) for wi, ai, pi in zip(w, a, p, strict=True))
        step, size = np.linalg.solve(h, g), 1.0
        while value(v - size * step) > value(v) and size > 1e-9:
            size /= 2
        v = v - size * step
    return v.reshape(d, k), value(v)


def newton_hinge2(z, sign, w, c, penalised=True):
    a = np.c_[z, np.ones(len(z))]
    hold = np.r_[np.ones(z.shape[1]), float(penalised)]
    v = np.zeros(a.shape[1])
    value = lambda v: 0.5 * (hold * v * v).sum() + c * (w * np.maximum(1 - sign * (a @ v), 0) ** 2).sum()
    for _ in range(100):
        on = sign * (a @ v) < 1
        g = hold * v - 2 * c * a[on].T @ (w[on] * sign[on] * (1 - sign[on] * (a[on] @ v)))
        h = np.diag(hold + 1e-12) + 2 * c * (a[on] * w[on, None]).T @ a[on]
        step, size = np.linalg.solve(h, g), 1.0
        while value(v - size * step) > value(v) and size > 1e-9:
            size /= 2
        v = v - size * step
    return v, value(v)


def softmax(s):
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(plain, family, c, f, p):
    train, test = plain.rows(f, p)
    z, y, w = plain.scaled(train), plain.y, plain.weights(train)
    if family.loss == "softmax":
        v, _ = newton_softmax(z[train], y[train], w, c)
        return test, softmax(z[test] @ v[:-1] + v[-1])
    vs = [newton_hinge2(z[train], np.where(y[train] == k, 1.0, -1.0), w, c)[0] for k in range(3)]
    return test, softmax(np.stack([z[test] @ v[:-1] + v[-1] for v in vs], axis=1))


def pooled(subject, logs):
    return {s: softmax(logs[subject == s].mean(axis=0)[None])[0] for s in sorted(set(subject))}


def auc(y, p):
    return np.mean((p[y][:, None] > p[~y]) + 0.5 * (p[y][:, None] == p[~y]))


def score(truth, got):
    s = sorted(got)
    y, p = np.array([truth[i] for i in s]), np.round([got[i] for i in s], 9)
    return round(np.mean([(p[y == k].argmax(axis=1) == k).mean() for k in range(3)]), 6), round(np.mean([auc(y == k, p[:, k]) for k in range(3)]), 6)


def rows_of(spark, data, cap=0, parts=3):
    e, f, i = frames(spark, data)
    return t.Rows(t.packed(e.repartition(parts), f, i, 1, FOLDS, cap), 1)


@pytest.mark.parametrize("families", [[LR], [LR, SVM]])
def test_nested_selection_equals_numpy_refits(spark, families):
    data = made(3)
    plain, truth = Plain(data), {s: y for s, y, *_ in data[0]}
    chosen, got = n.evaluate(spark, *frames(spark, data), families, tolerance=1e-8)
    chosen, got = {r.fold: r for r in chosen.collect()}, {(r.fold, r.epoch): (r.subject, r.logs) for r in got.collect()}
    candidates = [(f, c) for f in families for c in f.grid]
    for fold in range(FOLDS):
        scores = []
        for family, c in candidates:
            own = {}
            for p in range(PARTS):
                test, prob = probabilities(plain, family, c, fold, p)
                own |= pooled(plain.s[test], np.log(np.clip(prob, 1e-7, 1)))
            scores.append(score(truth, own))
        best = max(range(len(candidates)), key=lambda i: (*scores[i], -i))
        assert (chosen[fold].candidate, chosen[fold].family, chosen[fold].c) == (best, candidates[best][0].name, candidates[best][1])
        assert (chosen[fold].balanced_accuracy, chosen[fold].macro_auc) == pytest.approx(scores[best], abs=2e-6)
        test, prob = probabilities(plain, *candidates[best], fold, -1)
        assert {e for f, e in got if f == fold} == set(plain.e[test])
        assert np.allclose([got[fold, e][1] for e in plain.e[test]], np.log(np.clip(prob, 1e-7, 1)), atol=1e-4)


def test_objectives_equal_numpy_with_lacking_values_and_a_cap(spark):
    data = made(4, lacking=0.15)
    plain = Plain(data, cap=3)
    splits = [(0, f, p) for f in range(FOLDS) for p in (-1, 0)]
    with rows_of(spark, data, cap=3) as rows:
        for family in (n.Family("lr", "softmax", (0.3,), cap=3), n.Family("svm", "hinge2", (0.3,), free_intercept=False, cap=3)):
            fitted = n.fit(rows, family, splits, [[0]] * len(splits), 5, 3, 1e-9)
            assert fitted.converged.all()
            for s, (_, f, p) in enumerate(splits):
                train, _ = plain.rows(f, p)
                z, y, w = plain.scaled(train)[train], plain.y[train], plain.weights(train)
                assert np.allclose(fitted.inputs(s, plain.x[train]), z)
                assert np.allclose(fitted.moments.weights(s, y, 1 / np.minimum([(plain.s == v).sum() for v in plain.s[train]], 3)), w)
                v = fitted.weights[s, 0]
                if family.loss == "softmax":
                    _, least = newton_softmax(z, y, w, 0.3)
                    a = z @ v[:-1] + v[-1]
                    mine = 0.5 * (v[:-1] ** 2).sum() + 0.3 * (w * (np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(y)), y])).sum()
                else:
                    least = sum(newton_hinge2(z, np.where(y == k, 1.0, -1.0), w, 0.3)[1] for k in range(3))
                    sign = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
                    mine = 0.5 * (v**2).sum() + 0.3 * (w[:, None] * np.maximum(1 - sign * (z @ v[:-1] + v[-1]), 0) ** 2).sum()
                assert mine == pytest.approx(least, rel=1e-8)


def test_rbf_machine_with_all_rows_as_landmarks_is_the_exact_one(spark):
    data = made(5)
    plain = Plain(data)
    family = n.Family("rbf", "hinge2", (2.0,), landmarks=500)
    with rows_of(spark, data) as rows:
        fitted = n.fit(rows, family, [(0, 0, -1)], [[0]], 5, 3, 1e-10)
    train, test = plain.rows(0, -1)
    z, w = plain.scaled(train), plain.weights(train)
    k = n.kernel(z[train], z[train], 1 / 4)  # four features vary
    for y in range(3):
        sign = np.where(plain.y[train] == y, 1.0, -1.0)
        # the dual's conditions on the rows with a margin under 1, until these stay the same
        on = np.ones(len(sign), bool)
        for _ in range(100):
            i = np.flatnonzero(on)
            m = np.block([[k[np.ix_(i, i)] + np.diag(1 / (2 * 2.0 * w[i])), np.ones((len(i), 1))], [np.ones((1, len(i))), np.zeros((1, 1))]])
            solved = np.linalg.solve(m, np.r_[sign[i], 0])
            f = k[:, i] @ solved[:-1] + solved[-1]
            if (on == (sign * f < 1)).all():
                break
            on = sign * f < 1
        assert (on == (sign * f < 1)).all() and (solved[:-1] * sign[i] >= -1e-9).all()
        exact = n.kernel(z[test], z[train][i], 1 / 4) @ solved[:-1] + solved[-1]
        v = fitted.weights[0, 0, :, y]
        assert np.allclose(fitted.inputs(0, plain.x[test]) @ v[:-1] + v[-1], exact, atol=2e-3)


def test_landmarks_and_models_do_not_depend_on_the_partitions(spark):
    data, family = made(6), n.Family("rbf", "hinge2", (1.0,), landmarks=7, cap=2)
    found = []
    for parts in (1, 5):
        with rows_of(spark, data, 2, parts) as rows:
            found.append((n.landmarks(rows, [(0, 1, -1)], 5, 7, 2)[0], n.fit(rows, family, [(0, 1, -1)], [[0]], 5, 3, 1e-9).weights))
    assert len(found[0][0]) == 7 and np.array_equal(found[0][0], found[1][0]) and np.allclose(found[0][1], found[1][1], atol=1e-6)


def test_exact_medians_of_training_rows(spark):
    epochs, folds, inner = made(7, lacking=0.3)
    for i, v in enumerate((float("inf"), float("-inf"), -0.0, 5e-324, -1e300)):
        epochs[i][3][1] = v
    for r in epochs:
        r[3][2] = float(np.round(r[3][2]))  # ties
        r[3][3] = float("nan") if r[0] not in (0, 1) else r[3][3]
    plain, splits = Plain((epochs, folds, inner)), [(0, f, p) for f in range(FOLDS) for p in (-1, 0, 1)]
    with rows_of(spark, (epochs, folds, inner)) as rows:
        got = t.medians(rows, splits, 5)
    for s, (_, f, p) in enumerate(splits):
        for j in range(5):
            v = plain.x[plain.rows(f, p)[0], j]
            v = v[~np.isnan(v)]
            assert np.isnan(got[s, j]) if not len(v) else got[s, j] == np.median(v) or got[s, j] == pytest.approx(np.median(v), rel=1e-15)


def test_solver_finds_minima_of_many_quadratics():
    g = np.random.default_rng(8)
    a = g.normal(size=(20, 6, 6))
    h, b = a @ a.transpose(0, 2, 1) + 0.01 * np.eye(6), g.normal(size=(20, 6))
    b[3] = 0
    value = lambda keys, x: (0.5 * np.einsum("ki,kij,kj->k", x, h[keys], x) - (b[keys] * x).sum(axis=1), np.einsum("kij,kj->ki", h[keys], x) - b[keys])
    x, ok = t.minimise(value, np.zeros((20, 6)), 1e-8)
    assert ok.all() and np.allclose(x, np.linalg.solve(h, b[..., None])[..., 0], atol=1e-5)


def test_a_class_absent_from_training_and_two_class_margins(spark):
    epochs, folds, inner = made(9)
    folds = [(0, 0 if s % 3 == 2 else f if f else 1, s) for _, f, s in folds]  # all of class 2 is tested in fold 0
    inner = [(0, f, s, s // 3 % 2) for _, own, s in folds for f in range(FOLDS) if f != own]
    for family in (LR, SVM, n.FAMILIES["prior"]):
        with rows_of(spark, (epochs, folds, inner)) as rows:
            fitted = n.fit(rows, family, [(0, 0, -1)], [[0]], 5, 3)
        p = fitted.probabilities(0, 0, np.array([r[3] for r in epochs]))
        assert np.allclose(p.sum(axis=1), 1) and np.allclose(p[:, 2], 1e-7, rtol=1e-3)
        if family is SVM:
            v = fitted.weights[0, 0]
            margin = fitted.inputs(0, np.array(epochs[0][3])[None]) @ v[:-1] + v[-1]
            assert np.log(p[0, 0] / p[0, 1]) == pytest.approx((margin[0, 0] - margin[0, 1]) / 2, abs=1e-6)


def test_vote_averages_the_tuned_members(spark):
    data = frames(spark, made(10))
    members = [{(r.fold, r.epoch): r.logs for r in n.evaluate(spark, *data, [f])[1].collect()} for f in (LR, SVM)]
    chosen, got = n.evaluate(spark, *data, [LR, SVM], "vote")
    got = {(r.fold, r.epoch): r.logs for r in got.collect()}
    assert sorted((r.fold, r.member, r.family) for r in chosen.collect()) == [(f, m, x) for f in range(FOLDS) for m, x in ((0, "lr"), (1, "linsvm"))]
    assert set(got) == set(members[0]) and all(np.allclose(np.exp(v), softmax(np.mean([m[k] for m in members], axis=0)[None])[0]) for k, v in got.items())
    with pytest.raises(ValueError):
        n.evaluate(spark, *data, [LR], "best")


def test_a_killed_run_goes_on_and_gives_equal_rows(spark, tmp_path):
    epochs, folds, inner = data = frames(spark, made(11))
    say = lambda df: sorted((r.fold, r.candidate, r.epoch, tuple(np.round(r.logs, 9))) for r in df.collect())
    seen = []

    def killed(group):
        seen.append(group)
        if len(seen) == 3:
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        n.checkpointed(spark, str(tmp_path), *data, [LR], at_once=1, before=killed)
    assert seen == [[(0, 0)], [(0, 1)], [(0, 2)]]
    again = []
    got = say(n.checkpointed(spark, str(tmp_path), *data, [LR], at_once=1, before=again.append))
    assert again == [[(0, 2)]] and got == say(n.evaluate(spark, *data, [LR])[1])
    assert say(n.checkpointed(spark, str(tmp_path), *data, [LR], before=lambda group: pytest.fail("all is done"))) == got
    # a half-written group counts as absent
    half = next(p for p in tmp_path.rglob("_SUCCESS"))
    half.unlink()
    assert say(n.checkpointed(spark, str(tmp_path), *data, [LR], at_once=1)) == got
    moved = folds.selectExpr("repeat", "(fold + 1) % 3 as fold", "subject")
    with pytest.raises(ValueError, match="stale checkpoint"):
        n.checkpointed(spark, str(tmp_path), epochs, moved, inner, [LR])
