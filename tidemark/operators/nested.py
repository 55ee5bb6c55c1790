"""Nested evaluation over model families and their grids: candidates are chosen on inner folds of the training subjects, the winner is
fitted on all of them and predicts the outer fold's subjects.

All (split, candidate) models of a family are fitted together (training.minimise): rounds do not multiply with splits, and no task holds a
split's rows. Families: L2 logistic regression (free intercept), linear SVM (squared hinge, one against the rest, penalised intercept,
softmax of margins), leaf-wise boosted trees (boosted.py), RBF SVM (the same loss over a Nystroem map of landmarks drawn from the split's training rows, free intercept; with
all training rows as landmarks it is the kernel machine itself) and the class prior. Features are filled with training medians and scaled
by training mean and population deviation; weights let the subjects of a class and the classes count alike.

combine "select": one choice among all candidates of all families. "vote": each family is tuned by itself and the winners' epoch
probabilities are averaged as logarithms. Scores pool the inner folds by subject: balanced accuracy to six places, then macro AUC to six,
then the candidates' order.

With a checkpoint folder the outer splits run in groups, each written when done under the key of its settings, with a fingerprint of its
test subjects; a later run of the same settings takes up what is left, and a fingerprint that no longer fits raises.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import tidemark.operators.evaluate
import tidemark.operators.protocol
import tidemark.sources.tables  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import boosted
from tidemark.operators.training import Block, Moments, Rows, Split, landmarks, medians, minimise, moments, packed, unpacked
from tidemark.plans.portable import duckdb_sql, frame
from tidemark.sources.cache import exists, key_of, remaining

EPS = 1e-7


@dataclass(frozen=True)
class Family:
    """loss: softmax, hinge2, trees or prior. landmarks: 0 for a linear model. cap: training rows a subject, 0 for all.

    Of trees the grid is the number of leaves, and shapes are (trees, rate) at each place of it; growth holds for all.
    """

    name: str
    loss: str
    grid: tuple[float, ...] = (1.0,)
    free_intercept: bool = True
    landmarks: int = 0
    cap: int = 0
    shapes: tuple[tuple[int, float], ...] = ()
    growth: boosted.Growth = boosted.Growth()


#: Fixed grids of the penalty parameter C; of trees: leaves, trees and rate.
FAMILIES = {
    "prior": Family("prior", "prior"),
    "lr": Family("lr", "softmax", (1e-4, 1e-3, 1e-2, 1e-1, 1.0)),
    "linsvm": Family("linsvm", "hinge2", (1e-5, 1e-4, 1e-3, 1e-2), free_intercept=False),
    "rbfsvm": Family("rbfsvm", "hinge2", (0.1, 1.0, 10.0), landmarks=64, cap=40),
    "gbt": Family("gbt", "trees", (7, 15), shapes=((200, 0.05), (400, 0.03))),
}
#: For the given tables, which hold some hundred epochs: fewer trees at a higher rate, smaller leaves.
SHORT_GBT = replace(FAMILIES["gbt"], shapes=((10, 0.2), (20, 0.1)), growth=boosted.Growth(least=8))


@dataclass(frozen=True)
class Fitted:
    """Models of a family on some splits: weights (split, candidate, coordinate, class), the last coordinate the intercept."""

    family: Family
    splits: list[Split]
    candidates: list[int]
    weights: np.ndarray
    moments: Moments
    marks: np.ndarray | None
    roots: np.ndarray | None
    gamma: np.ndarray | None
    converged: np.ndarray

    def inputs(self, s: int, x: np.ndarray) -> np.ndarray:
        return inputs(self.moments, self.marks, self.roots, self.gamma, s, x)

    def probabilities(self, s: int, c: int, x: np.ndarray) -> np.ndarray:
        """(row, class) of rows of raw features; a class without training rows gets EPS before the rows are normalised."""
        present = self.moments.rows_of[s] > 0
        if self.family.loss == "prior":
            p = np.tile(self.moments.rows_of[s] / max(self.moments.n[s], 1), (len(x), 1))
        else:
            w = self.weights[s, c]
            score = self.inputs(s, x) @ w[:-1] + w[-1]
            if self.family.loss == "hinge2" and present.sum() == 2:
                score = score / 2  # one margin d of two classes counts as -d/2 and d/2
            score = np.where(present, score, -np.inf)
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
        p = np.where(present, p, EPS)
        return p / p.sum(axis=1, keepdims=True)


def inputs(m: Moments, marks: np.ndarray | None, roots: np.ndarray | None, gamma: np.ndarray | None, s: int, x: np.ndarray) -> np.ndarray:
    """Scaled features of a split, or their kernel values at the landmarks times the inverse root of the landmarks' own."""
    z = m.scaled(s, x)
    return z if marks is None else kernel(z, marks[s], gamma[s]) @ roots[s]


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


def fit(rows: Rows, family: Family, splits: Sequence[Split], candidates: Sequence[Sequence[int]], width: int, classes: int, tolerance: float = 1e-5) -> Fitted | boosted.Forest:
    """The family's models on each split, of the grid places named for that split (the same number for each)."""
    if family.loss == "trees":
        grid = [(int(leaves), *shape) for leaves, shape in zip(family.grid, family.shapes, strict=True)]
        return boosted.fit(rows, grid, splits, candidates, width, classes, family.cap, family.growth)
    splits = list(splits)
    m = moments(rows, splits, width, classes, family.cap)
    marks = roots = gamma = None
    size = width
    if family.landmarks:
        raw = landmarks(rows, splits, width, family.landmarks, family.cap)
        size = max((len(x) for x in raw), default=0)
        constant = np.stack([m.scaled(s, x).std(axis=0) == 0 if len(x) else np.ones(width, bool) for s, x in enumerate(raw)])
        gamma = 1 / np.maximum((~constant).sum(axis=1), 1)  # one over features times the variance of the scaled ones
        marks, roots = np.zeros((len(splits), size, width)), np.zeros((len(splits), size, size))
        for s, x in enumerate(raw):
            marks[s, : len(x)] = m.scaled(s, x)
            value, vector = np.linalg.eigh(kernel(marks[s, : len(x)], marks[s, : len(x)], gamma[s]))
            good = value > 1e-10 * max(value.max(initial=0), 1e-300)
            roots[s, : len(x), : len(x)] = (vector[:, good] / np.sqrt(value[good])) @ vector[:, good].T
    many = len(candidates[0])
    strength = np.array([[family.grid[c] for c in own] for own in candidates]).ravel()
    shape = (len(splits) * many, size + 1, classes)
    if family.loss == "prior":
        return Fitted(family, splits, [list(c) for c in candidates], np.zeros((len(splits), many, size + 1, classes)), m, marks, roots, gamma, np.ones(len(strength), bool))
    n = np.maximum(m.n, 1)[np.arange(len(strength)) // many]

    def value(keys: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = points.reshape(len(keys), *shape[1:])
        of = [np.flatnonzero(keys // many == s) for s in range(len(splits))]

        def add(into: tuple, b: Block) -> tuple:
            share = b.share(family.cap)
            for s, own in enumerate(of):
                if not len(own):
                    continue
                on = b.training(splits[s], family.cap)
                if not on.any():
                    continue
                z, y, weight = inputs(m, marks, roots, gamma, s, b.x[on]), b.y[on], m.weights(s, b.y[on], share[on])
                score = np.einsum("nd,kdc->knc", z, w[own, :-1], optimize=True) + w[own, None, -1]
                loss, slope = LOSSES[family.loss](score, y, m.rows_of[s] > 0)
                slope *= weight[:, None]
                into[0][own] += (loss * weight).sum(axis=1)
                into[1][own, :-1] += np.einsum("nd,knc->kdc", z, slope, optimize=True)
                into[1][own, -1] += slope.sum(axis=1)
            return into

        loss, grad = rows.total((np.zeros(len(keys)), np.zeros(w.shape)), add)
        held = w.copy()
        if family.free_intercept:
            held[:, -1] = 0
        c, rows_n = strength[keys], n[keys]
        return (0.5 * (held * held).sum(axis=(1, 2)) / c + loss) / rows_n, ((held / c[:, None, None] + grad) / rows_n[:, None, None]).reshape(len(keys), -1)

    points, converged = minimise(value, np.zeros((shape[0], shape[1] * shape[2])), tolerance)
    return Fitted(family, splits, [list(c) for c in candidates], points.reshape(len(splits), many, size + 1, classes), m, marks, roots, gamma, converged)


def _softmax(score: np.ndarray, y: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss (candidate, row) and its slope (candidate, row, class)."""
    score = np.where(present, score, -np.inf)
    top = score.max(axis=-1, keepdims=True)
    e = np.exp(score - top)
    total = e.sum(axis=-1, keepdims=True)
    slope = e / total
    row = np.arange(len(y))
    loss = (np.log(total) + top)[..., 0] - score[:, row, y]
    slope[:, row, y] -= 1
    return loss, slope


def _hinge2(score: np.ndarray, y: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sign = np.where(y[:, None] == np.arange(score.shape[-1]), 1.0, -1.0)
    lack = np.maximum(1 - sign * score, 0) * present
    return (lack * lack).sum(axis=-1), -2 * sign * lack


LOSSES = {"softmax": _softmax, "hinge2": _hinge2}


def predicted(blocks: DataFrame, repeats: int, fitted: Fitted | boosted.Forest, number: int) -> DataFrame:
    """repeat, fold, candidate, subject, y, epoch, logs (ln of the clipped probability, a class each) of the rows that each split tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = unpacked(list(row.values()), repeats)
                for s, split in enumerate(fitted.splits):
                    on = b.testing(split)
                    if not on.any():
                        continue
                    x, n = b.x[on], int(on.sum())
                    for c, grid in enumerate(fitted.candidates[s]):
                        p = np.log(np.clip(fitted.probabilities(s, c, x), EPS, 1))
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v)) for v in (split[0], split[1], number + grid)] + [pa.array(v[on]) for v in (b.subject, b.y, b.epoch)] + [flat], names=["repeat", "fold", "candidate", "subject", "y", "epoch", "logs"])

    return blocks.mapInArrow(run, "repeat long, fold long, candidate long, subject long, y long, epoch long, logs array<double>")


def subject_rows(epochs: DataFrame) -> DataFrame:
    """repeat, fold, candidate, subject, y, k, p, n: the geometric mean of a subject's epochs, normalised."""
    long = epochs.select("repeat", "fold", "candidate", "subject", "y", F.posexplode("logs").alias("k", "g"))
    mean = long.groupBy("repeat", "fold", "candidate", "subject", "y", "k").agg(F.avg("g").alias("g"), F.count(F.lit(1)).alias("n"))
    over = "over (partition by repeat, fold, candidate, subject)"
    return mean.withColumn("hi", F.expr(f"max(g) {over}")).withColumn("p", F.expr(f"exp(g - hi) / sum(exp(g - hi)) {over}")).select("repeat", "fold", "candidate", "subject", "y", F.col("k").cast("long").alias("k"), "p", "n")


def voted(parts: Sequence[DataFrame]) -> DataFrame:
    """Epoch probabilities of the members' mean logarithms, normalised; an epoch that a member lacks is an error."""
    both = reduce(DataFrame.unionByName, parts).select("repeat", "fold", "subject", "y", "epoch", F.posexplode("logs").alias("k", "g"))
    mean = both.groupBy("repeat", "fold", "subject", "y", "epoch", "k").agg(F.when(F.count(F.lit(1)) == len(parts), F.avg("g")).otherwise(F.raise_error(F.lit("the members of a vote differ in their epochs"))).alias("g"))
    at = mean.groupBy("repeat", "fold", "subject", "y", "epoch").agg(F.sort_array(F.collect_list(F.struct("k", "g"))).alias("l"))
    total = F.log(F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x["g"])))
    return at.select("repeat", "fold", F.lit(0).cast("long").alias("candidate"), "subject", "y", "epoch", F.transform("l", lambda x: F.greatest(x["g"] - total, F.lit(float(np.log(EPS))))).alias("logs"))


def evaluate(spark: SparkSession, epochs: DataFrame, folds: DataFrame, inner: DataFrame, families: Sequence[Family], combine: str = "select", only: Sequence[tuple[int, int]] | None = None, tolerance: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(chosen, predictions). chosen: repeat, fold, member, candidate, family, c, balanced_accuracy, macro_auc.

    predictions: repeat, fold, candidate, subject, y, epoch, logs of the outer test rows. only: the outer splits to run. Candidates are
    numbered over all families' grids in order; under a vote the prediction's number is 0.
    """
    if combine not in ("select", "vote"):
        raise ValueError(combine)
    shape = folds.agg(F.max("repeat").alias("r"), F.max("fold").alias("f")).first()
    parts = (inner.agg(F.max("part").alias("p")).first().p or 0) + 1
    sizes = epochs.agg(F.max("label").alias("k"), F.max(F.size("x")).alias("d")).first()
    outer = sorted((r, f) for r in range(shape.r + 1) for f in range(shape.f + 1)) if only is None else sorted(map(tuple, only))
    classes, width, repeats = sizes.k + 1, sizes.d, shape.r + 1
    cap = max(f.cap for f in families)
    first = np.cumsum([0, *(len(f.grid) for f in families)]).tolist()
    blocks = packed(epochs, folds, inner, repeats, shape.f + 1, cap)
    with Rows(blocks, repeats) as rows:
        scores = []
        for number, family in zip(first, families, strict=False):
            splits = [(r, f, p) for r, f in outer for p in range(parts)]
            fitted = fit(rows, family, splits, [range(len(family.grid))] * len(splits), width, classes, tolerance)
            pooled = subject_rows(predicted(blocks, repeats, fitted, number))
            scores.append(frame(spark, "", "inner_scores", {"inner_proba": pooled.withColumn("p", F.round("p", 9))}))
        # outer splits x candidates rows
        told = reduce(DataFrame.unionByName, scores).collect()
        chosen, groups = [], [range(first[-1])] if combine == "select" else [range(a, b) for a, b in zip(first, first[1:], strict=False)]
        for r, f in outer:
            for member, group in enumerate(groups):
                own = [x for x in told if (x.repeat, x.fold) == (r, f) and x.candidate in group]
                best = max(own, key=lambda x: (x.balanced_accuracy, x.macro_auc if x.macro_auc is not None else -1.0, -x.candidate))
                kind = max(i for i in range(len(families)) if first[i] <= best.candidate)
                chosen.append((r, f, member, best.candidate, families[kind].name, float(families[kind].grid[best.candidate - first[kind]]), best.balanced_accuracy, best.macro_auc))
        out = []
        for member in range(len(groups)):
            for i, family in enumerate(families):
                won = [(c[:2], c[3] - first[i]) for c in chosen if c[2] == member and c[4] == family.name]
                if won:
                    fitted = fit(rows, family, [(*s, -1) for s, _ in won], [[c] for _, c in won], width, classes, tolerance)
                    out.append((member, predicted(blocks, repeats, fitted, first[i])))
    by_member = [reduce(DataFrame.unionByName, [p for k, p in out if k == member]) for member in range(len(groups))]
    done = by_member[0] if combine == "select" else voted(by_member)
    return spark.createDataFrame(chosen, "repeat long, fold long, member int, candidate long, family string, c double, balanced_accuracy double, macro_auc double"), done


def fingerprints(folds: DataFrame) -> DataFrame:
    """repeat, fold, test: count, sum and xor of the hashes of the test subjects, in no order."""
    h = F.xxhash64("subject")
    return folds.groupBy("repeat", "fold").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")).alias("test"))


def checkpointed(spark: SparkSession, root: str, epochs: DataFrame, folds: DataFrame, inner: DataFrame, families: Sequence[Family], combine: str = "select", at_once: int = 5, tolerance: float = 1e-5, before: Callable[[list[tuple[int, int]]], None] | None = None) -> DataFrame:
    """The predictions of all outer splits, from finished ones below root and from what is run now, some splits at a time.

    A group of splits is one table, whole or absent (its commit makes it so); writing a group again gives the same rows. before: called with
    each group that is about to run. Settings (families, grids, tolerance) make the folder's key; data that change in place do not.
    """
    base = f"{root.rstrip('/')}/nested_{key_of({'families': json.dumps([asdict(f) for f in families]), 'combine': combine, 'tolerance': tolerance})}"
    splits = fingerprints(folds)
    done = _finished(spark, base)
    if done is not None:
        stale = done.select("repeat", "fold", "test").distinct().join(splits.withColumnRenamed("test", "now"), ["repeat", "fold"], "left").where("now is null or now <> test").orderBy("repeat", "fold").first()
        if stale:
            raise ValueError(f"stale checkpoint of repeat {stale.repeat}, fold {stale.fold} below {base}: its test subjects are others")
    # repeats x folds rows
    left = sorted((int(r.repeat), int(r.fold)) for r in (splits if done is None else remaining(splits, done)).collect())
    for a in range(0, len(left), at_once):
        group = left[a : a + at_once]
        if before:
            before(group)
        _, got = evaluate(spark, epochs, folds, inner, families, combine, group, tolerance)
        got.join(splits, ["repeat", "fold"]).write.mode("overwrite").parquet(f"{base}/group={key_of(group)}")
    return _finished(spark, base).drop("test")


def _finished(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows of the groups that are whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/group=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    whole = sorted(p for p in (str(f.getPath()) for f in found or []) if exists(spark, p))
    return spark.read.parquet(*whole) if whole else None


def task(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Epochs of the three-class task with their vectors, outer folds and inner folds."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label < 3 and embedding is not null")
    epochs = e.select((F.col("label") * 8 + F.col("vec_id") % 8).alias("subject"), "label", F.col("vec_id").alias("epoch"), F.col("embedding").cast("array<double>").alias("x"))
    return epochs, frame(spark, sf_dir, "folds").select("repeat", "fold", "subject"), frame(spark, sf_dir, "inner_folds").select("repeat", "fold", "subject", "part")


def _query(families: Sequence[Family], combine: str = "select", repeats: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        epochs, folds, inner = task(spark, sf_dir)
        # repeats x folds rows
        only = [(r.repeat, r.fold) for r in folds.where(F.col("repeat") < repeats).select("repeat", "fold").distinct().collect()] if repeats else None
        _, got = evaluate(spark, epochs, folds, inner, families, combine, only)
        return subject_rows(got)

    return run


def fold_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeat, fold, j, median of each feature over the outer training rows: what the imputer fills in."""
    epochs, folds, inner = task(spark, sf_dir)
    shape = folds.agg(F.max("repeat").alias("r"), F.max("fold").alias("f")).first()
    width = epochs.agg(F.max(F.size("x")).alias("d")).first().d
    splits = [(r, f, -1) for r in range(shape.r + 1) for f in range(shape.f + 1)]
    with Rows(packed(epochs, folds, inner, shape.r + 1, shape.f + 1), shape.r + 1) as rows:
        found = medians(rows, splits, width)
    told = [(r, f, j, float(v)) for (r, f, _), own in zip(splits, found, strict=True) for j, v in enumerate(own)]
    return spark.createDataFrame(told, "repeat long, fold long, j long, median double").withColumn("median", F.round("median", 9))


def oracle_sql() -> dict[str, str]:
    return {"fold_medians": duckdb_sql("train_medians")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """repeat, fold, candidate, subject, y, k, p, n of the outer test subjects."""
    return {"fold_medians": fold_medians, "nested_lr": _query([FAMILIES["lr"]]), "nested_linsvm": _query([FAMILIES["linsvm"]]), "nested_rbfsvm": _query([FAMILIES["rbfsvm"]]), "nested_gbt": _query([SHORT_GBT], repeats=1), "nested_select_families": _query([FAMILIES[f] for f in ("prior", "lr", "linsvm")]), "nested_vote": _query([FAMILIES[f] for f in ("lr", "linsvm")], "vote")}
