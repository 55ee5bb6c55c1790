"""Leaf-wise boosted trees of many splits and grid places at once, by distributed gradient histograms.

A tree of every (split, candidate, class) grows in common rounds. A round is one treeAggregate that counts, for the leaves asked for, the
training rows' slopes and curvatures by feature and bin. Of two children only the one with fewer rows is counted; the other is its parent
less that one. A tree takes the leaf of largest gain next, whatever its depth; each round asks for all leaves that the order so far might
still split, so the rounds of a tree follow its depth, not its number of leaves, and the order is that of asking one at a time.

Loss: softmax over the classes, weighted as in training.Moments. Slopes and curvatures are whole multiples of 2**-20, so their sums are
exact: siblings are exact and the trees are the same on every partitioning. A row's and a feature's part in a tree are functions of its
hash, the tree's number and the class. NaN is a bin of its own and takes the side of larger gain (right where both are equal, as where
training had none). A class without training rows gets no tree and a probability of EPS; without rows at all every class gets alike.

Bin edges come from at most SAMPLE training rows of the split (those of least hash); every training row is binned and counted.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel

from tidemark.operators.training import Block, Moments, Rows, Split, landmarks, moments

EPS = 1e-7
#: Training rows a split that bin edges are read from.
SAMPLE = 2048
#: Bins of known values; NaN has one more.
BINS = 32
#: Trees after which the rows' scores are stored anew.
STORED = 3
#: Histogram bytes that one round may send to the driver; more splits than fit are done in turn.
ROUND_BYTES = 1 << 28
ONE = 2.0**20


@dataclass(frozen=True)
class Growth:
    """Fixed settings of the published model: rows a leaf, curvature a leaf, penalty, shares of rows and of features a tree."""

    least: int = 50
    curvature: float = 1e-3
    penalty: float = 1.0
    rows: float = 0.8
    features: float = 0.3


@dataclass(frozen=True)
class Trees:
    """Arrays (..., node): feature (-1 at a leaf), last bin to the left, whether NaN goes left, children, value."""

    feature: np.ndarray
    bin: np.ndarray
    lacking: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def at(self, *index) -> Trees:
        return Trees(*(getattr(self, f)[index] for f in self.__dataclass_fields__))

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """(tree, row): the leaf that each row of codes (row, feature) reaches in each tree (tree, node)."""
        tree, row = np.arange(len(self.feature))[:, None], np.arange(len(codes))
        node = np.zeros((len(self.feature), len(codes)), np.int64)
        while True:
            f = self.feature[tree, node]
            if not (f >= 0).any():
                return node
            c = codes[row, f]
            left = np.where(c == BINS, self.lacking[tree, node], c <= self.bin[tree, node])
            node = np.where(f < 0, node, np.where(left, self.left[tree, node], self.right[tree, node]))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """(tree, row): the values of the leaves reached."""
        return self.value[np.arange(len(self.feature))[:, None], self.leaves(codes)]


def edges_of(x: np.ndarray) -> np.ndarray:
    """(feature, BINS - 1) upper ends of all bins but the last: between neighbouring values, at about equal numbers of rows; padded with inf."""
    out = np.full((x.shape[1], BINS - 1), np.inf)
    for j in range(x.shape[1]):
        v, n = np.unique(x[np.isfinite(x[:, j]), j], return_counts=True)
        if len(v) > BINS:
            v = v[np.unique(np.searchsorted(n.cumsum(), np.arange(1, BINS) * n.sum() / BINS).clip(0, len(v) - 2))[:, None] + [0, 1]]
            out[j, : len(v)] = v[:, 0] + (v[:, 1] - v[:, 0]) / 2
        elif len(v) > 1:
            out[j, : len(v) - 1] = v[:-1] + (v[1:] - v[:-1]) / 2
    return out


def coded(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    codes = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1) if x.shape[1] else np.zeros(x.shape)
    return np.where(np.isnan(x), BINS, codes).astype(np.uint8)


def bagged(hash_: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether a row takes part in a tree: a mixed hash of both against the share."""
    with np.errstate(over="ignore"):
        z = hash_.astype(np.uint64) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)) >> np.uint64(11) < share * 2**53


def drawn(width: int, tree: int, k: int, share: float) -> np.ndarray:
    """The features that a class's tree may use."""
    return np.sort(np.random.default_rng((tree, k)).permutation(width)[: max(1, int(np.ceil(share * width)))])


@dataclass(frozen=True)
class State:
    """Of a block's rows: class, hash, weight (split, row; 0 where it does not train), codes (split, row, feature), score (model, class, row)."""

    y: np.ndarray
    hash: np.ndarray
    weight: np.ndarray
    codes: np.ndarray
    score: np.ndarray


def slopes(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, row) slopes and curvatures in units of 2**-20, whole."""
    e = np.exp(score - score.max(axis=0))
    p = e / e.sum(axis=0)
    k = np.isfinite(score[:, 0]).sum() if score.shape[1] else 2
    g = (p - (np.arange(len(p))[:, None] == y)) * weight
    return np.rint(g * ONE), np.rint(k / max(k - 1, 1) * p * (1 - p) * weight * ONE)


class Growing:
    """One tree while it grows, on the driver: node sums, histograms of the leaves not yet settled, their best cuts."""

    def __init__(self) -> None:
        self.total: list[np.ndarray | None] = [None]
        self.hist: list[np.ndarray | None] = [None]
        self.best: list[tuple | None] = [None]
        self.known, self.child, self.order = [False], [None], []

    def _add(self, total: np.ndarray, least: int) -> int:
        for own, v in zip((self.total, self.hist, self.best, self.known, self.child), (total, None, None, total[2] < 2 * least, None), strict=True):
            own.append(v)
        return len(self.total) - 1

    def wanted(self, leaves: int, least: int) -> list[tuple[int, int | None, int | None]]:
        """(node to count, its sibling, their parent) of all that the next cuts may need; nothing where the order is settled."""
        if not self.known[0]:
            return [(0, None, None)]
        heap, self.order, need = [(-self.best[0][0], 0)] if self.best[0] else [], [], []
        while heap and len(self.order) < leaves - 1:
            node = heapq.heappop(heap)[1]
            self.order.append(node)
            if self.child[node] is None:
                low = self.best[node][4]
                self.child[node] = self._add(low, least), self._add(self.total[node] - low, least)
            pair = self.child[node]
            if not all(self.known[c] for c in pair):
                small, large = sorted(pair, key=lambda c: self.total[c][2])
                need.append((small, large, node))
            for c in pair:
                if self.known[c] and self.best[c]:
                    heapq.heappush(heap, (-self.best[c][0], c))
        # what the last cut leaves behind is not cut again
        return [] if len(self.order) == leaves - 1 and [n[2] for n in need] == self.order[-1:] else need


def cuts(hist: np.ndarray, growth: Growth) -> list[tuple | None]:
    """For each histogram (feature, bin, sum) the cut of largest gain: gain, place of the feature, bin, NaN to the left, sums of the left."""
    low = hist[:, :, :BINS].cumsum(axis=2)[:, :, :-1]
    low = np.stack([low, low + hist[:, :, BINS:]], axis=3)
    total = hist[:, :1].sum(axis=2)[:, :, None, None]
    high = total - low

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + growth.penalty * ONE, 1e-300) / ONE

    ok = (np.minimum(low[..., 2], high[..., 2]) >= growth.least) & (np.minimum(low[..., 1], high[..., 1]) >= growth.curvature * ONE)
    gain = np.where(ok, worth(low) + worth(high) - worth(total), 0).reshape(len(hist), -1)
    found = gain.argmax(axis=1)
    out = []
    for i, at in enumerate(found):
        f, b, side = np.unravel_index(at, low.shape[1:4])
        out.append((float(gain[i, at]), int(f), int(b), bool(side), low[i, f, b, side]) if gain[i, at] > 0 else None)
    return out


def arrays(growing: Sequence[Sequence[Growing | None]], features: Sequence[np.ndarray], rates: Sequence[float] | None, growth: Growth) -> Trees:
    """The trees (model, class, node): all nodes cut so far while they grow, or the settled ones with values (with rates)."""
    size = max((len(g.total) for own in growing for g in own if g), default=1)
    shape = (len(growing), len(features), size)
    feature, bin_, left, right = (np.full(shape, v, np.int16) for v in (-1, 0, 0, 0))
    lacking, value = np.zeros(shape, bool), np.zeros(shape)
    for i, own in enumerate(growing):
        for k, g in enumerate(own):
            if g is None:
                continue
            settled = set(g.order) if rates else {n for n, c in enumerate(g.child) if c}
            for n in settled:
                _, f, b, side, _ = g.best[n]
                feature[i, k, n], bin_[i, k, n], lacking[i, k, n] = features[k][f], b, side
                left[i, k, n], right[i, k, n] = g.child[n]
                if rates:
                    for c in g.child[n]:
                        if c not in settled:
                            value[i, k, c] = -rates[i] * g.total[c][0] / max(g.total[c][1] + growth.penalty * ONE, 1e-300)
    return Trees(feature, bin_, lacking, left, right, value)


@dataclass(frozen=True)
class Forest:
    """Fitted models: base (split, class) scores, edges (split, feature, bin), for each model its trees (tree times class, node)."""

    splits: list[Split]
    candidates: list[list[int]]
    moments: Moments
    base: np.ndarray
    edges: np.ndarray
    trees: list[Trees]

    def probabilities(self, s: int, c: int, x: np.ndarray) -> np.ndarray:
        """(row, class); classes without training rows get EPS before the rows are normalised."""
        trees, k = self.trees[s * len(self.candidates[0]) + c], self.base.shape[1]
        present = self.moments.rows_of[s] > 0
        out = []
        for a in range(0, len(x), 512):
            codes = coded(x[a : a + 512], self.edges[s])
            score = self.base[s][:, None] + trees.sums(codes).reshape(-1, k, len(codes)).sum(axis=0)
            e = np.exp(score - score.max(axis=0))
            out.append((e / e.sum(axis=0)).T)
        p = np.where(present, np.concatenate(out) if out else np.zeros((0, k)), EPS)
        return p / p.sum(axis=1, keepdims=True)


def fit(rows: Rows, grid: Sequence[tuple[int, int, float]], splits: Sequence[Split], candidates: Sequence[Sequence[int]], width: int, classes: int, cap: int = 0, growth: Growth = Growth()) -> Forest:
    """Models of the grid places (leaves, trees, rate) named for each split (the same number for each)."""
    most = max(leaves for leaves, _, _ in grid) * len(candidates[0]) * classes * max(1, int(np.ceil(growth.features * width))) * (BINS + 1) * 24
    at_once = max(1, ROUND_BYTES // most)
    parts = [_fit(rows, grid, splits[a : a + at_once], candidates[a : a + at_once], width, classes, cap, growth) for a in range(0, len(splits), at_once)]
    m = Moments(*(np.concatenate([getattr(p.moments, f) for p in parts]) for f in Moments.__dataclass_fields__))
    return Forest([s for p in parts for s in p.splits], [c for p in parts for c in p.candidates], m, np.concatenate([p.base for p in parts]), np.concatenate([p.edges for p in parts]), [t for p in parts for t in p.trees])


def _fit(rows: Rows, grid: Sequence[tuple[int, int, float]], splits: Sequence[Split], candidates: Sequence[Sequence[int]], width: int, classes: int, cap: int, growth: Growth) -> Forest:
    m = moments(rows, splits, width, classes, cap)
    edges = np.stack([edges_of(x) for x in landmarks(rows, splits, width, SAMPLE, cap)])
    places = (m.rows_of > 0).sum(axis=1, keepdims=True)
    # classes weigh alike, so their common score is that of equal shares
    base = np.where(m.rows_of > 0, -np.log(np.maximum(places, 1)), np.where(places > 0, -np.inf, 0.0))
    models = [(s, *grid[c]) for s, own in enumerate(candidates) for c in own]

    def start(b: Block) -> State:
        share, weight, codes = b.share(cap), np.zeros((len(splits), len(b.y))), np.zeros((len(splits), *b.x.shape), np.uint8)
        for s, split in enumerate(splits):
            on = b.training(split, cap)
            weight[s, on] = m.weights(s, b.y[on], share[on])
            codes[s] = coded(b.x, edges[s])
        return State(b.y, b.hash, weight, codes, np.repeat(base[[s for s, *_ in models]][:, :, None], len(b.y), axis=2))

    def advanced(state: State, trees: Sequence[Trees]) -> State:
        score = state.score.copy()
        for tree in trees:
            for i, (s, *_) in enumerate(models):
                if (tree.feature[i] >= 0).any():
                    score[i] += tree.at(i).sums(state.codes[s])
        return replace(state, score=score)

    states = rows.rdd.map(start).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[Trees] = []
    pending: list[Trees] = []
    try:
        for number in range(max(trees for _, _, trees, _ in models)):
            features = [drawn(width, number, k, growth.features) for k in range(classes)]
            growing = [[Growing() if number < trees and m.rows_of[s, k] > 0 else None for k in range(classes)] for s, _, trees, _ in models]
            while True:
                asked = [(i, k, *w) for i, own in enumerate(growing) for k, g in enumerate(own) if g for w in g.wanted(models[i][1], growth.least)]
                if not asked:
                    break
                counted = _count(states, models, asked, arrays(growing, features, None, growth), features, list(pending), advanced, number, growth)
                _settle(growing, asked, counted, growth)
            done.append(arrays(growing, features, [rate for *_, rate in models], growth))
            pending.append(done[-1])
            if len(pending) == STORED:
                newer = states.map(lambda st, trees=tuple(pending): advanced(st, trees)).persist(StorageLevel.MEMORY_AND_DISK)
                newer.count()
                states.unpersist()
                states, pending = newer, []
    finally:
        states.unpersist()
    return Forest(list(splits), [list(c) for c in candidates], m, base, edges, [_joined([d.at(i) for d in done[: models[i][2]]]) for i in range(len(models))])


def _count(states, models, asked, tree: Trees, features, pending, advanced, number: int, growth: Growth) -> np.ndarray:
    """(asked, feature, bin, sum): slopes, curvatures and rows of the asked nodes' training rows that take part in the tree."""
    nf = len(features[0])
    slots: dict[tuple[int, int], tuple[int, dict[int, int]]] = {}
    for place, (i, k, node, *_) in enumerate(asked):
        first, own = slots.setdefault((i, k), (place, {}))
        own[node] = place - first

    def add(into: tuple, st: State) -> tuple:
        st = advanced(st, pending)
        part = bagged(st.hash, number, growth.rows)
        for i in sorted({i for i, _ in slots}):
            s = models[i][0]
            on = np.flatnonzero(part & (st.weight[s] > 0))
            if not len(on):
                continue
            codes = st.codes[s][on]
            node = tree.at(i).leaves(codes)
            g, h = slopes(st.score[i][:, on], st.y[on], st.weight[s][on])
            for k in range(len(features)):
                if (i, k) not in slots:
                    continue
                first, own = slots[i, k]
                to = np.full(tree.feature.shape[2], -1)
                to[list(own)] = list(own.values())
                slot = to[node[k]]
                r = np.flatnonzero(slot >= 0)
                at = ((slot[r][:, None] * nf + np.arange(nf)) * (BINS + 1) + codes[r][:, features[k]]).ravel()
                for j, v in enumerate((g[k, r], h[k, r], np.ones(len(r)))):
                    into[0][first : first + len(own), ..., j] += np.bincount(at, np.repeat(v, nf), len(own) * nf * (BINS + 1)).reshape(len(own), nf, BINS + 1)
        return into

    zero = (np.zeros((len(asked), nf, BINS + 1, 3)),)
    return states.treeAggregate(zero, add, lambda a, b: (a[0] + b[0],), depth=2)[0]


def _settle(growing, asked, counted: np.ndarray, growth: Growth) -> None:
    """Histograms and best cuts of the counted nodes and of their siblings."""
    found: list[tuple[Growing, int, np.ndarray]] = []
    for (i, k, node, sibling, parent), hist in zip(asked, counted, strict=True):
        g = growing[i][k]
        if parent is None:
            g.total[0] = hist[0].sum(axis=0)
        found.append((g, node, hist))
        if sibling is not None:
            found.append((g, sibling, g.hist[parent] - hist))
            g.hist[parent] = None
    for (g, node, hist), best in zip(found, cuts(np.stack([h for *_, h in found]), growth), strict=True):
        g.hist[node], g.best[node], g.known[node] = hist, best, True


def _joined(trees: Sequence[Trees]) -> Trees:
    """Trees (class, node) of all numbers as (number times class, node)."""
    size = max((t.feature.shape[1] for t in trees), default=1)
    fill = {"feature": -1}
    return Trees(*(np.concatenate([np.pad(getattr(t, f), ((0, 0), (0, size - t.feature.shape[1])), constant_values=fill.get(f, 0)) for t in trees]) for f in Trees.__dataclass_fields__))
