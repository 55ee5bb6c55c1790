"""Repeated passages (operator 7) by sparse suffix arrays.

A passage of SPAN or more words that occurs twice, in two texts or in one, is repeated. Suffixes are retained only at minimiser
positions: of every W consecutive K-grams the one of least hash, W + K - 1 = SPAN, so both copies of any repeated span retain
the same suffixes. Suffixes are sorted by their first K words; those without an equal neighbour are dropped.

A retained suffix is compared with its neighbours over its reach, the SPAN - K words before and after its K-gram: the
reach of most copies is equal as a whole, and then one pair of neighbours settles it and everything in reach is repeated. Only
where reaches differ (the ends of passages) the match is extended left and right word by word: the windows of SPAN words around
the suffix are sorted, equal neighbours are repeated. Runs of repeated windows are the extended match.

Sorting is by range over (hash, row, place), so that equal suffixes of a hot passage spread over tasks; a task compares
neighbours in its range, and the first and last keys of the ranges are compared across. Nothing is collected by key.

Words are [^\\x20\\x09-\\x0D]+ of the text as it is. Hashes have 64 bits; equal hashes count as equal words.

Defined results: null texts and texts of fewer than SPAN words have no spans; exact copies are repeated throughout (if long enough);
repeated rows count as copies; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPAN, K = 50, 16
_G = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, by doubling: hashes of runs of powers of two are combined."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    out, done, run, size = None, 0, w, 1
    while True:
        if n & size:
            part = run[done : done + len(w) - n + 1]
            out = part.copy() if out is None else _mix(out * _G + part)
            done += size
        size *= 2
        if size > n:
            return out
        run = _mix(run[: len(run) - size // 2] * _G + run[size // 2 :] + np.uint64(size))


def minimisers(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash (the last such) in every w consecutive ones."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    # least of every w, by doubling; places ride along
    best, at, size = h, np.arange(len(h)), 1

    def lesser(a, i, b, j):
        take = b <= a
        return np.where(take, b, a), np.where(take, j, i)

    while size * 2 <= w:
        best, at = lesser(best[:-size], at[:-size], best[size:], at[size:])
        size *= 2
    if size < w:
        off = w - size
        best, at = lesser(best[: len(best) - off], at[: len(at) - off], best[off:], at[off:])
    return np.unique(at)


_KEY = "key long, reach long, doc long, h long, pos int"


def named(docs: DataFrame) -> DataFrame:
    """doc (doc_id, -1 for null), h (hash of the text) and text: what names a text, the same in every pass."""
    t = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.col("text").cast("string").alias("text"))
    return t.select("doc", F.xxhash64("text").alias("h"), "text")


def suffixes(texts: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """key (hash of the K-gram), reach (hash of all words in reach; unique where the text ends within it) of each retained suffix."""
    side = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a truncated reach equals no other, not even that of a repeated row; the table is written, so it is drawn once
        rng = np.random.default_rng(int.from_bytes(os.urandom(8)))
        for batch in batches:
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = word_hashes(text.as_py())
                if len(w) < span:
                    continue
                grams = rolling(w, k)
                at = minimisers(grams, span - k + 1)
                full = rolling(w, k + 2 * side)
                reach, begin = rng.integers(0, 1 << 64, len(at), dtype=np.uint64), at - side
                ok = (begin >= 0) & (begin < len(full))
                reach[ok] = full[begin[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(reach.view(np.int64)), pa.array(np.full(len(at), doc), pa.int64()), pa.array(np.full(len(at), h), pa.int64()), pa.array(at.astype(np.int32))], names=["key", "reach", "doc", "h", "pos"])

    return texts.mapInArrow(run, _KEY)


_STATES = ("same", "whole", "border")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range, rows whose key a neighbour has (same), with its reach (whole) or another (border); and the range's two ends."""
    names = ["key", "reach", "doc", "h", "pos", *_STATES, "edge"]
    held: list[np.ndarray] | None = None  # the last row and its states so far
    first = True

    def out(cols: list[np.ndarray], states: list[np.ndarray], edge: np.ndarray) -> pa.RecordBatch:
        take = states[0] | edge
        arrays = [pa.array(c[take]) for c in cols] + [pa.array(x[take]) for x in (*states, edge)]
        arrays[4] = arrays[4].cast(pa.int32())
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(5)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held[:5], cols, strict=True)]
        key, reach = cols[0], cols[1]
        k, r = key[1:] == key[:-1], reach[1:] == reach[:-1]
        states = []
        for eq in (k, k & r, k & ~r):
            x = np.zeros(len(key), bool)
            x[1:] |= eq
            x[:-1] |= eq
            states.append(x)
        if held is not None:
            for x, y in zip(states, held[5:], strict=True):
                x[0] |= y[0]
        edge = np.zeros(len(key), bool)
        edge[0] = first
        if len(key) > 1:
            yield out([c[:-1] for c in cols], [x[:-1] for x in states], edge[:-1])
            first = False
        held = [c[-1:] for c in (*cols, *states)]
    if held is not None:
        yield out(held[:5], held[5:], np.array([True]))


def compare_neighbours(rows: DataFrame) -> DataFrame:
    """rows (key, reach, doc, h, pos) whose key occurs twice or more: doc, h, pos, whole, border.

    The sort is by all columns, so ranges part even the rows of one key. Two ends a range, at most, are compared across ranges.
    """
    order = ["key", "reach", "doc", "h", "pos"]
    marked = materialize(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, f"{_KEY}, same boolean, whole boolean, border boolean, edge boolean"))
    ends = marked.where("edge")
    by_key = ends.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    by_reach = ends.groupBy("key", "reach").agg(F.count(F.lit(1)).alias("_m"))
    settled = ends.join(by_key, "key").join(by_reach, ["key", "reach"]).where("same or _n > 1")
    settled = settled.select("doc", "h", "pos", F.expr("whole or _m > 1").alias("whole"), F.expr("border or _n > _m").alias("border"))
    return marked.where("not edge").select("doc", "h", "pos", "whole", "border").union(settled)


def windows_around(texts: DataFrame, at: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The SPAN-word windows that hold a suffix's K-gram, as rows to compare. at: doc, h, places of the suffixes in that text."""
    side = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, h, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                grams = rolling(word_hashes(text.as_py()), span)
                p = places.values.to_numpy().astype(np.int64)
                starts = np.unique((p[:, None] - np.arange(side + 1)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts < len(grams))]
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(grams[starts].view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, doc), pa.int64()), pa.array(np.full(n, h), pa.int64()), pa.array(starts.astype(np.int32))], names=["key", "reach", "doc", "h", "pos"])

    return texts.join(at, ["doc", "h"]).select("doc", "h", "text", "places").mapInArrow(run, _KEY)


def repeated_passages(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, start, end (in words, end exclusive), n_words of every maximal run of words in repeated SPAN-word windows.

    A run may join several passages that abut or overlap. Equal rows (doc_id and text) have their runs once.
    """
    side = span - k
    alike = materialize(compare_neighbours(materialize(suffixes(named(docs), span, k))))
    # a text's places stay together: they are bounded by its own length
    at = alike.where("border").groupBy("doc", "h").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    windows = compare_neighbours(materialize(windows_around(named(docs), at, span, k)))
    runs = alike.where("whole").select("doc", "h", (F.col("pos") - side).alias("start"), (F.col("pos") + k + side).alias("end"))
    runs = runs.union(windows.select("doc", "h", F.col("pos").alias("start"), (F.col("pos") + span).alias("end")))
    before = F.expr("max(end) over (partition by doc, h order by start, end rows between unbounded preceding and 1 preceding)")
    islands = runs.withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    islands = islands.withColumn("_island", F.expr("sum(_new) over (partition by doc, h order by start, end rows unbounded preceding)"))
    merged = islands.groupBy("doc", "h", "_island").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    return merged.select(F.col("doc").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
