"""Quality classifier (operator 9): a generalised additive model with pairwise interactions.

Each text gives a few surface features. Their values are cut into quantile bins. Cyclic boosting visits the features in turn; at
each visit a shallow tree (two levels, four leaves) is fitted to the log-loss gradients over the feature's bins and added, shrunk, to
the feature's lookup table. Then the strongest pairs by one-tree gain are boosted in the same way over coarse bins, by
trees that cut one feature and then the other. A score is the sum of table entries by bin, through a sigmoid: for a batch
a few vectorised additions.

Learning rows: labelled documents outside the held-out fifth, at most ``max_rows`` of them, those least by a hash of doc_id.
Labels, lang, source and doc_id are no features.

Defined results: a null text is empty and scored as such; labels that are null or of unknown documents are ignored; of several
labels of a document the least counts; with no learning rows or one class, the score is the share of label 1 (0.5
without any); repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FEATURES = ("log_words", "mean_word", "distinct", "repeated", "upper", "titled", "symbols", "bangs", "stops", "commas", "lines", "dup_lines", "digits", "wide", "long_words")
MAX_ROWS, BINS, COARSE, ROUNDS, PAIRS, RATE, CUT = 20_000, 32, 8, 150, 6, 0.1, 0.3


def features(text: str | None) -> tuple[float, ...]:
    """Surface features of the whole text, in the order of FEATURES."""
    text = text or ""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return (0.0,) * len(FEATURES)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count = text.count
    return (
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(set(words)) / n**0.8,
        sum(map(eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(count, "#*$%&|<>")) / n,
        count("!") / n,
        count(".") / n,
        count(",") / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(count, "0123456789")) / size,
        1 - len(text.encode("ascii", "ignore")) / size,
        sum(map((12).__lt__, map(len, words))) / n,
    )


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and its features, of every row."""
    names = [*FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, j]) for j in range(len(names))]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names))


@dataclass
class Gam:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: Of each feature, the coarse bin of each bin.
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if self.edges:
            b = self.bins(x)
            for table, j in zip(self.tables, b, strict=True):
                out += table[j]
            for i, j, table in self.pairs:
                out += table[self.coarse[i][b[i]], self.coarse[j][b[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best gain and place of one cut over bins with gradient sums g and curvature sums h."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    G, H = g.sum(), h.sum()
    ok = (b >= least) & (H - b >= least)
    if not ok.any():
        return 0.0, 0
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, a**2 / (b + 1) + (G - a) ** 2 / (H - b + 1) - G**2 / (H + 1), 0.0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, least: float, depth: int = 2) -> np.ndarray:
    """Leaf values over the bins of a tree of that depth."""
    gain, k = _cut(g, h, least)
    if depth == 0 or gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:k], h[:k], least, depth - 1), _tree(g[k:], h[k:], least, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts one side and then, in each part, the other; over a grid of bins."""
    best, out = 0.0, np.zeros_like(g)
    for swap in (False, True):
        a, b = (g.T, h.T) if swap else (g, h)
        for k in range(1, a.shape[0]):
            parts, total = [], 0.0
            for s in (slice(0, k), slice(k, None)):
                p, q = a[s].sum(axis=0), b[s].sum(axis=0)
                gain, _ = _cut(p, q, least)
                total += gain + p.sum() ** 2 / (q.sum() + 1)
                parts.append(np.broadcast_to(_tree(p, q, least, 1), a[s].shape))
            if total > best:
                v = np.concatenate(parts)
                best, out = total, v.T if swap else v
    return best - g.sum() ** 2 / (h.sum() + 1), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE, least: float = 2.0) -> Gam:
    """Deterministic; the cost is rounds times features times rows."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return Gam(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    m = Gam(float(np.log(share / (1 - share))))
    for j in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        # rare high values get edges of their own
        e = np.unique(np.concatenate([e, np.quantile(x[:, j], [0.98, 0.99, 0.995])]))
        m.edges.append(e)
        m.tables.append(np.zeros(len(e) + 1))
        m.coarse.append(np.arange(len(e) + 1) * COARSE // (len(e) + 1))
    bins, margin = m.bins(x), np.full(len(y), m.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(bins):
            g, h = slopes()
            n = len(m.tables[j])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), least)
            m.tables[j] += step
            margin += step[b]
    rough = [m.coarse[j][b] for j, b in enumerate(bins)]
    grid = lambda i, j, v: np.bincount(rough[i] * COARSE + rough[j], v, COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = slopes()
    ranked = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h), least)[0], i, j) for i in range(len(bins)) for j in range(i)), reverse=True)
    m.pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in ranked[:pairs]]
    for _ in range(rounds // 5):
        for i, j, table in m.pairs:
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), least)[1]
            table += step
            margin += step[rough[i], rough[j]]
    return m


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """The model of at most max_rows labelled feature rows outside the held-out fifth."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_y")).where(~held_out())
    some = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(*FEATURES, "_y").collect()
    a = np.array(some, dtype=float).reshape(-1, len(FEATURES) + 1)
    return fit(a[:, :-1], a[:, -1])


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = materialize(feature_rows(docs))
    model = learn(rows, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
