"""Training rows of many splits at once: columnar blocks, exact medians, moments, and a solver that fits all models in common rounds.

A split is (repeat, fold, part): part -1 trains on all subjects outside the fold, part p leaves out the fold's inner part p too. Rows are
packed once into blocks that carry each row's folds and parts; a round is one treeAggregate over the blocks that serves every split and
every candidate, so no split's rows ever meet in one task and the driver sees sums alone (splits x candidates x features x classes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.rdd import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Split = tuple[int, int, int]
#: Rows of a block.
ROWS = 4096


@dataclass(frozen=True)
class Block:
    """Rows: features (row, feature), class, rows of the subject, place among them, hash, folds (row, repeat), parts (row, repeat, fold)."""

    epoch: np.ndarray
    subject: np.ndarray
    x: np.ndarray
    y: np.ndarray
    size: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    folds: np.ndarray
    parts: np.ndarray

    def training(self, split: Split, cap: int = 0) -> np.ndarray:
        """Whether a row trains; cap: at most so many rows of a subject, those of least place."""
        repeat, fold, part = split
        own = self.folds[:, repeat] != fold
        if part >= 0:
            own &= self.parts[:, repeat, fold] != part
        return own & (self.place < cap) if cap else own

    def testing(self, split: Split) -> np.ndarray:
        repeat, fold, part = split
        return self.folds[:, repeat] == fold if part < 0 else self.parts[:, repeat, fold] == part

    def share(self, cap: int = 0) -> np.ndarray:
        """1 / rows of the subject: summed over the rows of a class it gives the class's subjects."""
        return 1.0 / (np.minimum(self.size, cap) if cap else self.size)


def members(folds: DataFrame, inner: DataFrame, repeats: int, n_folds: int) -> DataFrame:
    """subject, folds (one a repeat), parts (one a repeat and fold; -1 where the subject is tested)."""
    slot = F.map_from_entries(F.collect_list(F.struct(F.col("repeat").cast("int"), F.col("fold").cast("int")))).alias("f")
    part = F.map_from_entries(F.collect_list(F.struct((F.col("repeat") * n_folds + F.col("fold")).cast("int"), F.col("part").cast("int")))).alias("p")

    def listed(column: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(column, i), F.lit(-1)))

    both = folds.groupBy("subject").agg(slot).join(inner.groupBy("subject").agg(part), "subject", "left")
    return both.select("subject", listed("f", repeats).alias("folds"), listed("p", repeats * n_folds).alias("parts"))


def packed(epochs: DataFrame, folds: DataFrame, inner: DataFrame, repeats: int, n_folds: int, cap: int = 0) -> DataFrame:
    """Rows of (subject, label, epoch, x) as blocks: one row of binary columns a block.

    With a cap, a row has a place among its subject's first rows by md5 of the epoch; tasks keep no more than that many before the shuffle.
    """
    rows = epochs.join(epochs.groupBy("subject").agg(F.count(F.lit(1)).alias("size")), "subject")
    if cap:
        order = Window.partitionBy("subject").orderBy(F.md5(F.col("epoch").cast("string")), "epoch")
        first = epochs.select("subject", "epoch", F.row_number().over(order).alias("place")).where(F.col("place") <= cap)
        rows = rows.join(first, ["subject", "epoch"], "left").withColumn("place", F.coalesce(F.col("place") - 1, F.lit(2**31 - 1)))
    else:
        rows = rows.withColumn("place", F.lit(0))
    rows = rows.join(members(folds, inner, repeats, n_folds), "subject").select(
        *(F.col(c).cast("long") for c in ("epoch", "subject", "label", "size", "place")), F.xxhash64("epoch").alias("hash"), "folds", "parts", F.col("x").cast("array<double>")
    )
    names = ["n", *(f"c{i}" for i in range(9))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                flat = [some.column(i).to_numpy().astype(np.int64) for i in range(6)] + [some.column(i).flatten().to_numpy(zero_copy_only=False).astype(t) for i, t in ((6, np.int64), (7, np.int64), (8, np.float64))]
                yield pa.RecordBatch.from_arrays([pa.array([some.num_rows]), *(pa.array([v.tobytes()]) for v in flat)], names=names)

    return rows.mapInArrow(run, "n long, " + ", ".join(f"{c} binary" for c in names[1:]))


def unpacked(row, repeats: int) -> Block:
    epoch, subject, y, size, place, hash_, folds, parts = (np.frombuffer(row[i], np.int64) for i in range(1, 9))
    n = row[0]
    return Block(epoch, subject, np.frombuffer(row[9], np.float64).reshape(n, -1), y, size, place, hash_, folds.reshape(n, repeats), parts.reshape(n, repeats, -1))


class Rows:
    """Blocks of all rows, kept while models are fitted; lost ones are computed again."""

    def __init__(self, blocks: DataFrame, repeats: int) -> None:
        self.frame, self.repeats = blocks, repeats
        self.rdd: RDD = blocks.rdd.map(lambda r: unpacked(r, repeats))

    def __enter__(self) -> Rows:
        self.rdd.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def __exit__(self, *_) -> None:
        self.rdd.unpersist()

    def total(self, zero: tuple, add: Callable[[tuple, Block], tuple]) -> tuple:
        """Sums of arrays over the blocks, merged through a reduction tree."""
        return self.rdd.treeAggregate(zero, add, lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)), depth=2)


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; NaN becomes the largest."""
    bits = (x + 0.0).view(np.uint64)
    out = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    return np.where(np.isnan(x), np.uint64(2**64 - 1), out)


def doubles(u: np.ndarray) -> np.ndarray:
    return np.where(u >> np.uint64(63), u & np.uint64(2**63 - 1), ~u).view(np.float64)


def medians(rows: Rows, splits: Sequence[Split], width: int, cap: int = 0) -> np.ndarray:
    """Exact medians (split, feature) of the training rows' known values; NaN where there are none.

    Both middle values are found together, 8 bits a round: a round counts, for each split and feature, the values that share the bits
    settled so far by their next 8 bits. Nothing is sorted, and 8 rounds serve all splits and features.
    """
    known = np.zeros((len(splits), width), np.int64)

    def count(into: tuple, b: Block) -> tuple:
        for s, split in enumerate(splits):
            into[0][s] += (~np.isnan(b.x[b.training(split, cap)])).sum(axis=0)
        return into

    (known,) = rows.total((known,), count)
    rank = np.stack([np.maximum(known - 1, 0) // 2, known // 2])
    prefix = np.zeros((2, len(splits), width), np.uint64)
    for level in range(8):
        shift = np.uint64(56 - 8 * level)

        def add(into: tuple, b: Block, prefix: np.ndarray = prefix, level: int = level, shift: np.uint64 = shift) -> tuple:
            u = ordered(b.x)
            ok = ~np.isnan(b.x)
            byte, head = (u >> shift & np.uint64(255)).astype(np.int64), u >> (shift + np.uint64(8)) if level else np.zeros_like(u)
            column = np.broadcast_to(np.arange(width), byte.shape)
            for s, split in enumerate(splits):
                own = b.training(split, cap)
                for half in (0, 1):
                    hit = ok[own] & (head[own] == prefix[half, s])
                    np.add.at(into[0][half, s], (column[own][hit], byte[own][hit]), 1)
            return into

        (counts,) = rows.total((np.zeros((2, len(splits), width, 256), np.int64),), add)
        upto = counts.cumsum(axis=-1)
        chosen = (upto > rank[..., None]).argmax(axis=-1)
        rank = rank - np.where(chosen > 0, np.take_along_axis(upto, np.maximum(chosen - 1, 0)[..., None], axis=-1)[..., 0], 0)
        prefix = prefix << np.uint64(8) | chosen.astype(np.uint64)
    low, high = doubles(prefix)
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(known > 0, np.where(low == high, low, low / 2 + high / 2), np.nan)


def landmarks(rows: Rows, splits: Sequence[Split], width: int, most: int, cap: int) -> list[np.ndarray]:
    """For each split the raw features of at most so many training rows, those of least hash of the epoch: alike on every partitioning."""

    def add(into: list, b: Block) -> list:
        for s, split in enumerate(splits):
            own = np.flatnonzero(b.training(split, cap))
            into[s] = least(into[s], (b.hash[own], b.epoch[own], b.x[own]))
        return into

    def least(a: tuple, b: tuple) -> tuple:
        joined = [np.concatenate(v) for v in zip(a, b, strict=True)]
        order = np.lexsort((joined[1], joined[0]))[:most]
        return tuple(v[order] for v in joined)

    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width)))
    found = rows.rdd.treeAggregate([empty] * len(splits), add, lambda a, b: [least(x, y) for x, y in zip(a, b, strict=True)], depth=2)
    return [x for _, _, x in found]


@dataclass(frozen=True)
class Moments:
    """Of each split's training rows: rows, mean and population deviation (1 where constant), fill for NaN, rows and subjects by class."""

    n: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    fill: np.ndarray
    rows_of: np.ndarray
    subjects_of: np.ndarray

    def scaled(self, s: int, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill[s], x) - self.mean[s]) / self.sd[s]

    def weights(self, s: int, y: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Subjects of a class count alike, classes too; the mean over the training rows is 1."""
        per = self.n[s] / np.maximum((self.subjects_of[s] > 0).sum(), 1) / np.maximum(self.subjects_of[s], 1e-300)
        return per[y] * share


def moments(rows: Rows, splits: Sequence[Split], width: int, classes: int, cap: int = 0) -> Moments:
    """Sums are taken about the mean of all rows."""

    def whole(into: tuple, b: Block) -> tuple:
        ok = ~np.isnan(b.x)
        return into[0] + np.where(ok, b.x, 0).sum(axis=0), into[1] + ok.sum(axis=0), into[2] + (~ok).sum()

    total, known, lacking = rows.total((np.zeros(width), np.zeros(width), np.int64(0)), whole)
    centre = total / np.maximum(known, 1)
    fill = medians(rows, splits, width, cap) if lacking else np.zeros((len(splits), width))
    fill = np.where(np.isnan(fill), 0.0, fill)

    def add(into: tuple, b: Block) -> tuple:
        one = np.eye(classes)[b.y]
        share = b.share(cap)[:, None]
        for s, split in enumerate(splits):
            own = b.training(split, cap)
            x = b.x[own]
            x = np.where(np.isnan(x), fill[s], x) - centre
            into[0][s] += x.sum(axis=0)
            into[1][s] += (x * x).sum(axis=0)
            into[2][s] += one[own].sum(axis=0)
            into[3][s] += (one * share)[own].sum(axis=0)
        return into

    k = len(splits)
    first, second, by_class, subjects = rows.total((np.zeros((k, width)), np.zeros((k, width)), np.zeros((k, classes)), np.zeros((k, classes))), add)
    n = by_class.sum(axis=1)
    mean = first / np.maximum(n, 1)[:, None]
    variance = np.maximum(second / np.maximum(n, 1)[:, None] - mean**2, 0)
    sd = np.sqrt(np.where(variance > 1e-18 * (1 + mean**2), variance, 0))
    return Moments(n, mean + centre, np.where(sd > 0, sd, 1.0), fill, by_class, np.rint(subjects))


def minimise(value: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, tolerance: float = 1e-6, rounds: int = 300, memory: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Minima of many smooth convex functions in common rounds (L-BFGS, steps halved until the value falls enough).

    value(keys, points) gives values and gradients (key, coordinate) of the functions of those keys; a round evaluates those not yet done
    once. Returns the points and whether each reached the tolerance, relative to 1 + the first gradient's largest entry.
    """
    k, n = x.shape
    x = x.copy()
    f, g = value(np.arange(k), x)
    bound = tolerance * (1 + np.abs(g).max(axis=1))
    s_, y_, rho = np.zeros((k, memory, n)), np.zeros((k, memory, n)), np.zeros((k, memory))
    step, towards = np.ones(k), -g / np.maximum(1, np.sqrt((g * g).sum(axis=1)))[:, None]
    done, stuck = np.abs(g).max(axis=1) <= bound, np.zeros(k, bool)
    for _ in range(rounds):
        todo = np.flatnonzero(~(done | stuck))
        if not len(todo):
            break
        trial = x[todo] + step[todo, None] * towards[todo]
        f1, g1 = value(todo, trial)
        slope = (g[todo] * towards[todo]).sum(axis=1)
        ok = f1 <= f[todo] + 1e-4 * step[todo] * slope + 1e-13 * (1 + np.abs(f[todo]))
        step[todo[~ok]] /= 2
        stuck[todo[~ok]] = step[todo[~ok]] < 1e-12
        keys = todo[ok]
        ds, dy = trial[ok] - x[keys], g1[ok] - g[keys]
        sy = (ds * dy).sum(axis=1)
        good = sy > 1e-14 * np.sqrt((ds * ds).sum(axis=1) * (dy * dy).sum(axis=1))
        at = keys[good]
        for store, new in ((s_, ds), (y_, dy)):
            store[at, :-1] = store[at, 1:]
            store[at, -1] = new[good]
        rho[at, :-1] = rho[at, 1:]
        rho[at, -1] = 1 / sy[good]
        x[keys], f[keys], g[keys], step[keys] = trial[ok], f1[ok], g1[ok], 1.0
        done[keys] = np.abs(g[keys]).max(axis=1) <= bound[keys]
        q = g[keys].copy()
        alpha = np.zeros((len(keys), memory))
        for i in range(memory - 1, -1, -1):
            alpha[:, i] = rho[keys, i] * (s_[keys, i] * q).sum(axis=1)
            q -= alpha[:, i, None] * y_[keys, i]
        yy = (y_[keys, -1] ** 2).sum(axis=1)
        q *= np.where(rho[keys, -1] > 0, 1 / np.maximum(rho[keys, -1] * yy, 1e-300), 1 / np.maximum(1, np.sqrt((q * q).sum(axis=1))))[:, None]
        for i in range(memory):
            beta = rho[keys, i] * (y_[keys, i] * q).sum(axis=1)
            q += (alpha[:, i] - beta)[:, None] * s_[keys, i]
        towards[keys] = -q
    return x, done | stuck
