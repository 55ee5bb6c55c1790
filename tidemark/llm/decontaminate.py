"""Benchmark decontamination (operator 6) by winnowing.

Of every K consecutive words a hash is taken; of every W consecutive hashes the least is kept as a fingerprint. Any span
of K + W - 1 = SPAN shared words holds a kept fingerprint, the same on both sides. Training fingerprints are joined with
the benchmark's; each hit is extended: the SPAN-word windows around it are looked up among the benchmark's windows and
compared word by word, so that runs of such windows are the extended hit. Items of fewer than SPAN words have one window,
the whole item; windows that short are looked up at every place, as no kept fingerprint is sure to lie in them.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words (a longer item is a block of its own): one block
is the usual case and needs no shuffle. More blocks make more passes over the texts, whose hits are then merged. A block's index
is arrays of about 40 bytes a word and its vocabulary; blocks are built and sent one after the other.

Defined results: null and wordless texts have no words, hits or items; null or wordless items are ignored; items with
equal item_id count once; repeated document rows each get their own result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPAN, K = 10, 5
BLOCK_WORDS = 1_000_000
#: Words of a batch that numpy handles at once.
BATCH_WORDS = 1 << 20
#: Bytes outside words become spaces; A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive ids."""
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    if len(h):
        m = _mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + m[i : i + len(h)]
    return _mix(h)


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash (the last such) of every w consecutive hashes."""
    if len(h) < w:
        return np.zeros(0, dtype=np.int64)
    n = len(h) - w + 1
    best, at = h[:n].copy(), np.arange(n)
    for i in range(1, w):
        less = h[i : i + n] <= best
        best = np.where(less, h[i : i + n], best)
        at = np.where(less, np.arange(i, i + n), at)
    return np.unique(at)


class Windows:
    """The distinct windows of one length in the items' word ids: sorted hashes, a place of each window's words, the items that have it."""

    def __init__(self, size: int, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        self.size, self.flat = size, flat
        own = np.flatnonzero(length == size if size < SPAN else length >= size)
        count = length[own] - size + 1
        item = np.repeat(own, count)
        start = np.repeat(begin[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        h = rolling(flat, size)[start] if len(start) else np.zeros(0, np.uint64)
        order = np.lexsort((item, *(flat[start + i] for i in reversed(range(size))), h))  # equal windows are neighbours, even if hashes collide
        h, start, item = h[order], start[order], item[order]
        words = np.stack([flat[start + i] for i in range(size)], axis=1) if len(start) else np.zeros((0, size), flat.dtype)
        new = np.append(True, (h[1:] != h[:-1]) | (words[1:] != words[:-1]).any(axis=1))[: len(h)]
        self.hash, self.start = h[new], start[new]
        window = np.cumsum(new) - 1
        fresh = new | np.append(True, item[1:] != item[:-1])[: len(h)]
        self.of = item[fresh].astype(np.int32)
        self.bounds = np.searchsorted(window[fresh], np.arange(len(self.hash) + 1))

    def items(self, k: int) -> np.ndarray:
        return self.of[self.bounds[k] : self.bounds[k + 1]]

    def match(self, ids: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts at which a window really occurs, and the window's index."""
        left, right = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        some = right > left
        starts, left, right = starts[some], left[some], right[some]
        out_s, out_w = [], []
        while len(starts):  # more than one round only if two windows' hashes collide
            same = (ids[starts[:, None] + np.arange(self.size)] == self.flat[self.start[left][:, None] + np.arange(self.size)]).all(axis=1)
            out_s.append(starts[same]), out_w.append(left[same])
            left = left + 1
            go = (left < right) & ~same
            starts, left, right = starts[go], left[go], right[go]
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(out_s), np.concatenate(out_w)) if out_s else (none, none)


class Index:
    """One block of the benchmark, as every task holds it."""

    def __init__(self, items: Sequence[tuple[str, str | None]]) -> None:
        self.names = [n for n, _ in items]
        self.vocab: dict[bytes, int] = {}
        number = self.vocab.setdefault
        ids = [np.fromiter((number(w, len(self.vocab)) for w in words_of(t)), dtype=np.int32) for _, t in items]
        length = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        begin = np.cumsum(length) - length
        prints = [h[winnow(h, SPAN - K + 1)] for h in (rolling(x, K) for x in ids if len(x) >= SPAN)]
        self.prints = np.unique(np.concatenate([np.zeros(0, np.uint64), *prints]))
        self.long = Windows(SPAN, flat, begin, length)
        self.short = [Windows(n, flat, begin, length) for n in sorted({*length[(length > 0) & (length < SPAN)].tolist()})]

    def find(self, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, Windows]]:
        """Windows in a flat array of word ids; texts are set apart by -2, words outside the benchmark are -1."""
        out = []
        h = rolling(ids, K)
        at = winnow(h, SPAN - K + 1)
        at = at[np.isin(h[at], self.prints)] if len(self.prints) else at[:0]
        if len(at):
            full = rolling(ids, SPAN)
            starts = np.unique((at[:, None] - np.arange(SPAN - K + 1)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts < len(full))]
            out.append((SPAN, *self.long.match(ids, starts, full[starts]), self.long))
        for w in self.short:
            h = rolling(ids, w.size)
            starts = np.flatnonzero(np.isin(h, w.hash))
            out.append((w.size, *w.match(ids, starts, h[starts]), w))
        return out


class _Known(dict):
    def __missing__(self, key: bytes) -> int:
        return -1


def _scan(batch: list[str | None], index: Index, known: _Known) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Words, hit ranges and items of each text."""
    get, flat, counts = known.__getitem__, [], []
    for text in batch:
        words = words_of(text)
        counts.append(len(words))
        flat.extend(map(get, words))
        flat.append(-2)
    ids = np.array(flat, dtype=np.int64)
    begin = np.cumsum([0, *counts]) + np.arange(len(counts) + 1)
    spans: list[list[tuple[int, int]]] = [[] for _ in batch]
    items: list[set[str]] = [set() for _ in batch]
    for size, starts, which, w in index.find(ids):
        text = np.searchsorted(begin, starts, "right") - 1
        pairs = np.unique(np.stack([text, which]), axis=1)
        for t, k in pairs.T.tolist():
            items[t].update(index.names[i] for i in w.items(k))
        for t, s in zip(text.tolist(), (starts - begin[text]).tolist(), strict=True):
            own = spans[t]
            if own and own[-1][0] <= s <= own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], s + size))
            else:
                own.append((s, s + size))
    yield from zip(counts, (_union(x) for x in spans), (sorted(x) for x in items), strict=True)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_OUT = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, names: list[str], shared) -> DataFrame:
    """names columns of docs, then n_words, hits and items, against one broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known = _Known(index.vocab)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for part in _parts(texts):
                n, hits, items = zip(*_scan(texts[part].to_pylist(), index, known), strict=True)
                cols = [c[part] for c in batch.columns[:-1]]
                hits = [[{"start": a, "end": b} for a, b in x] for x in hits]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "hits", "items"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema] + [_OUT])
    return docs.select(*names, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def _parts(texts: pa.Array) -> Iterator[slice]:
    """Slices of about BATCH_WORDS * 6 bytes, of one text at least."""
    size, begin = 0, 0
    for i, t in enumerate(texts):
        n = len(t.as_buffer()) if t.is_valid else 0
        if i > begin and size + n > BATCH_WORDS * 6:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[bool, Index]]:
    """The benchmark's items, block by block, and whether a block is all there is; the driver holds one block at a time."""
    n = F.expr("length(text) div 2 + 1")  # no fewer than its words
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(n)).first()[0] or 0
    count = -(-total // block_words)
    if count <= 1:
        yield True, Index([tuple(r) for r in items.collect()])
        return
    for i in range(2 * count):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(2 * count)) == i).collect()
        if rows:
            yield False, Index([tuple(r) for r in rows])


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hits (word ranges), items (item_ids as sorted strings) of every document row."""
    spark = docs.sparkSession
    # item_ids repeated with other texts are one item: sets of names merge them
    keyed, found = None, []
    for alone, index in blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(index)
        if alone:
            return _pass(docs, ["doc_id"], shared)
        # a row is named by its file and place in it, the same in every pass
        keyed = keyed or materialize(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()))
        one = _pass(keyed, ["doc_id", "_row"], shared)
        found.append(materialize(one.where("size(hits) > 0") if found else one))
        shared.destroy()
    parts = reduce(DataFrame.union, found)
    merged = parts.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = """aggregate(array_sort(hits), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
        if(size(acc) > 0 and x.start <= acc[size(acc) - 1].end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'end', greatest(acc[size(acc) - 1].end, x.end)))),
           concat(acc, array(x))))"""
    return merged.select("doc_id", "n_words", F.expr(union).alias("hits"), "items")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(hits, 0L, (n, x) -> n + x.end - x.start)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a hit, with all their columns. The row travels with its text through one pass a block."""
    spark = docs.sparkSession
    out = docs
    for alone, index in blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            known = _Known(index.vocab)
            for batch in batches:
                texts = batch.column(batch.schema.names.index("text"))
                for part in _parts(texts):
                    clean = [not hits for _, hits, _ in _scan(texts[part].to_pylist(), index, known)]
                    yield batch.slice(part.start, part.stop - part.start).filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
        if not alone:
            out = materialize(out)
            shared.destroy()
    return out


def item_digest(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
