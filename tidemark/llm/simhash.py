"""SimHash near-duplicates (operator 5) by deletion-variant signatures.

Fingerprint: 64-bit SimHash of the 3-word shingles. Two fingerprints link at 3 or fewer differing bits. Cut into two
halves, two linked fingerprints differ in at most one bit of one half, so both hold that half with the same single bit
wildcarded. Each distinct fingerprint is indexed under its 2 x 32 one-wildcard half variants; equal keys meet; the full
distance is verified. Exact copies collapse to one fingerprint before that, so hot copies never meet in a group.

A variant bucket is bounded: fingerprints of hot halves (more than BUCKET / 2 distinct ones) get finer keys, which cut the
other half into 16-bit and again 8-bit parts with one wildcard each (the same pigeonhole: at most 3 differing bits leave
at most one in one of two parts). In the finest bucket at most 8 + 3 bits are free: 2,048 members. A bucket emits a
spanning forest of its links, never all pairs. Components come from iterated minima over the forest's edges.

Defined results: null and blank texts have fingerprint zero and link like any other; fewer than 3 words make one shingle;
repeated rows keep their rows and share their component; rows of a null doc_id are kept and link like any other, and a
component's name is the least doc_id in it that is not null (null if there is none).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SEED, RADIUS, BUCKET = 42, 3, 1024
#: Near-duplicate stage: words a shingle, least Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Its join: nodes of a hash that meet in pairs, texts of which one is counted for the order, hashes ordered by count, side of a tile, least width of a sketch.
RUN, SAMPLE, ORDERED, TILE, WIDTH = 64, 8, 100_000, 1024, 64
#: Rows with sketches, rows with whole sets (or pairs to verify) a text that are on disk at once; what is more is done in slices.
SLICE, WHOLE = 3, 0.25
BLOCK = 1 << 17
#: Hot variant keys up to this many are sent to every task; beyond it they are joined.
BROADCAST_KEYS = 100_000


def fingerprint(text: str | None, seed: int = SEED) -> int:
    """SimHash of one text: a bit is 1 if set in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words)
    if n < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: n - 2].tolist()
    hash_of = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    stops = ends[2:].tolist()
    for at in range(0, n - 2, BLOCK):
        h = np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)), dtype=np.uint64, count=min(BLOCK, n - 2 - at))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > n - 2))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest of the links within radius among the distinct fingerprints of one bounded bucket."""
    left = members.copy()
    edges = []
    while len(left):  # breadth first: every member is compared once with the members not yet reached
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            x, front = front[0], front[1:]
            near = _bits(left ^ x) <= radius
            if near.any():
                found = left[near]
                edges += [(int(x), int(y)) for y in found]
                front, left = np.concatenate([front, found]), left[~near]
    return edges


def _variants(fp: np.ndarray, width: int, shift: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the part of fp at shift with each of its bits wildcarded; (row, key)."""
    part = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    i = np.arange(width, dtype=np.uint64)
    key = part[:, None] & ~(np.uint64(1) << i)[None, :]
    return key, i[None, :] + np.uint64(tag * width)


def half_keys(fps: DataFrame) -> DataFrame:
    """fp, key: the 64 one-wildcard half variants of every fingerprint (r, fp). key: r, half and wildcard above the half's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, r = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint64)
            for at in range(0, len(fp), 4096):
                some = fp[at : at + 4096]
                keys = []
                for half in (0, 1):
                    key, tag = _variants(some, 32, 32 * half, half)
                    keys.append((r[at : at + 4096, None] << np.uint64(38)) | (tag << np.uint64(32)) | key)
                key = np.concatenate(keys, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, 64).view(np.int64)), pa.array(key.ravel().view(np.int64))], names=["fp", "key"])

    return fps.select("fp", "r").mapInArrow(run, "fp long, key long")


def hot_keys(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The half variants that more than bucket fingerprints might share: those of halves with over bucket / 2."""
    halves = fps.select("r", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("v")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("v")),
    )).alias("h")).select("r", "h.*")
    hot = halves.groupBy("r", "half", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket // 2)
    wild = hot.select("r", "half", "v", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    return wild.select(F.expr("shiftleft(cast(r * 64 + half * 32 + i as bigint), 32) + (v & ~shiftleft(1L, i))").alias("key")).distinct()


def finer_keys(hot: DataFrame) -> DataFrame:
    """fp, key, fine: for each row of a hot half variant, 32 x 16 variants of the other half's parts (16, then 8 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(fp), 256):
                some, k = fp[at : at + 256], key[at : at + 256]
                other = np.where((k >> 37) & 1, some, some >> np.uint64(32)) & np.uint64(0xFFFFFFFF)
                fine = []
                for a in (0, 1):
                    k1, t1 = _variants(other, 16, 16 * a, a)
                    rest = (other >> np.uint64(16 * (1 - a))) & np.uint64(0xFFFF)
                    for b in (0, 1):
                        k2, t2 = _variants(rest, 8, 8 * b, b)
                        f = (((t1 << np.uint64(16)) | k1)[:, :, None] << np.uint64(12)) | ((t2 << np.uint64(8)) | k2)[:, None, :]
                        fine.append(f.reshape(len(some), -1))
                f = np.concatenate(fine, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, f.shape[1]).view(np.int64)), pa.array(np.repeat(k, f.shape[1])), pa.array(f.ravel().view(np.int64))], names=["fp", "key", "fine"])

    return hot.select("fp", "key").mapInArrow(run, "fp long, key long, fine long")


def _forest_links(fp: np.ndarray) -> np.ndarray:
    return np.array(forest(fp), dtype=np.uint64).reshape(-1, 2)


def _linker():
    """Links within runs of equal keys, a spanning forest each; the partition comes sorted by key, fine. Gives r, a, b with a < b."""

    def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, fine, fp = cols
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (fine[1:] != fine[:-1])]))
        size = np.diff(np.append(new, len(key)))
        two = new[size == 2]
        x, y = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
        near = _bits(x ^ y) <= RADIUS
        found = [np.stack([key[two][near] >> 38, x[near].view(np.int64), y[near].view(np.int64)])]
        for s, n in zip(new[size > 2], size[size > 2], strict=True):
            e = _forest_links(fp[s : s + n].view(np.uint64)).view(np.int64)
            found.append(np.stack([np.full(len(e), key[s] >> 38), e[:, 0], e[:, 1]]))
        r, a, b = np.concatenate(found, axis=1)
        rows = np.unique(np.stack([r, np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["r", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "fine", "fp")]
            if not len(cols[0]):
                continue
            rest = [np.concatenate(x) for x in zip(rest, cols, strict=True)] if rest else cols
            key, fine, _ = rest
            last = np.searchsorted(key, key[-1])
            last += np.searchsorted(fine[last:], fine[-1])  # the last run may go on in the next batch
            if last:
                yield flush([x[:last] for x in rest])
                rest = [x[last:] for x in rest]
        if rest:
            yield flush(rest)

    return run


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """r, a, b: links between distinct fingerprints (r, fp) of one r, enough to connect all that are connected."""
    keys, hot = half_keys(fps), materialize(hot_keys(fps, bucket))
    n_hot = hot.count()
    zero = F.lit(0).cast("long").alias("fine")
    if not n_hot:
        rows = keys.select("key", zero, "fp")
    else:
        side = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        cold = keys.join(side, "key", "left_anti").select("key", zero, "fp")
        rows = cold.union(finer_keys(keys.join(side, "key", "left_semi").select("fp", "key")).select("key", "fine", "fp"))
    return rows.repartition("key", "fine").sortWithinPartitions("key", "fine").mapInArrow(_linker(), "r long, a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable, over edges (a, b). Alternating stars until nothing moves, one written table a round."""
    star = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        # large star: larger neighbours of a node move to its least neighbour; small star: smaller ones do
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.expr("array(struct(u, m as v), struct(v as u, m as v))")).alias("e")).select("e.*").where("u <> v").distinct()
        old, star = star, materialize(small)
        discard(old, least)
        before, mark = mark, star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id of its component, of every row."""
    own = materialize(fingerprints(docs))
    # components are those of fingerprints, so a text without a doc_id links as well
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("d")))
    edges = materialize(links(fps.select(F.lit(0).cast("long").alias("r"), "fp"), bucket))
    label = components(edges.select("a", "b"))
    of_fp = materialize(fps.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "d", F.coalesce("label", "fp").alias("label")))
    names = materialize(of_fp.groupBy("label").agg(F.min("d").alias("component_id")))
    named = materialize(of_fp.join(names, "label").select("fp", "component_id"))
    discard(fps, edges, of_fp, names)
    return own.join(named, "fp")  # both sides are read from files: a fingerprint of many copies can be split


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles, A-Z lower-cased; of the whole sequence if shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = (b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else ()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64))


def _prefix(s: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of the set s in the order (count if common, hash), cut into its rare and its common hashes.

    Two sets of that similarity share a hash of their prefixes, whatever the order, as long as it is one for all sets.
    """
    if not len(s):
        return np.zeros(1, dtype=np.int64), s.view(np.int64)  # sets without words meet each other
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    count = np.where(common[at] == s, counts[at], 0) if len(common) else np.zeros(len(s), dtype=np.int64)
    first = np.lexsort((s, count))[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]
    rare = count[first] == 0
    return s[first][rare].view(np.int64), s[first][~rare].view(np.int64)


def _runs(names: Sequence[str], flush: Callable[..., Iterator[pa.RecordBatch]]):
    """flush of the columns called names, with where the runs of equal values of the first begin and their lengths; the partition comes sorted by it."""

    def whole(cols: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        t = cols[0].to_numpy()
        new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        yield from flush(new, np.diff(np.append(new, len(t))), *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Array] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c) for c in names]
            rest = [pa.concat_arrays(x) for x in zip(rest, cols, strict=True)] if rest else cols
            t = rest[0].to_numpy()
            last = int(np.searchsorted(t, t[-1]))  # the last run may go on in the next batch
            if last:
                yield from whole([c[:last] for c in rest])
                rest = [c[last:] for c in rest]
        if rest:
            yield from whole(rest)

    return run


def _shared(run_of: int, similarity: float):
    """t, node, place, least, many, star of the rows that are not alone with their t. least: the run's least node; many: whether it has over run_of nodes; star: whether the row may be similar to least, by size and place."""

    def flush(new: np.ndarray, length: np.ndarray, *cols: pa.Array) -> Iterator[pa.RecordBatch]:
        node, place = cols[1].to_numpy(), cols[2].to_numpy()
        least = np.repeat(np.minimum.reduceat(node, new), length)
        of, here = np.repeat(length, length), np.arange(len(node))
        hub = np.repeat(np.maximum.reduceat(np.where(node == least, here, 0), new), length)
        star = (node != least) & _near(place >> 32, place & 0xFFFFFFFF, here, hub, similarity)
        rows = pa.RecordBatch.from_arrays([*cols, pa.array(least), pa.array(of > run_of), pa.array(star)], names=["t", "node", "place", "least", "many", "star"])
        yield rows.filter(pa.array(of > 1))

    return _runs(["t", "node", "place"], flush)


def _is_in(s: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of s are in the sorted array among."""
    at = np.searchsorted(among, s)
    return among[np.minimum(at, len(among) - 1)] == s if len(among) else np.zeros(len(s), dtype=bool)


def _quarter(n: int, similarity: float, r: int, common: np.ndarray):
    """t, node, need of texts (node, text, spare): the hashes of a text in the rth quarter of their values that are not common, and one row with t = node.

    need: how many of them must be in other texts; spare: how many of a text may yet be in no other (null: none was looked at).
    """

    def rows_of(some: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        size = [len(t) + 1 for _, _, t in some]
        node, need = (np.repeat(np.array([x[c] for x in some], dtype=np.int64), size) for c in (0, 1))
        t = np.concatenate([np.append(t, np.int64(node)) for node, _, t in some])
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(node), pa.array(need.astype(np.int32))], names=["t", "node", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, many = [], 0
            for node, text, spare in zip(*batch.columns, strict=True):
                s = shingle_set(text.as_py(), n)
                left = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) if not spare.is_valid else spare.as_py()
                s = s[np.searchsorted(s, np.uint64(r << 62)) :]
                s = s if r == 3 else s[: np.searchsorted(s, np.uint64((r + 1) << 62))]
                t = s[~_is_in(s, common)].view(np.int64)
                some.append((node.as_py(), len(t) - left, t))
                many += len(t) + 1
                if many >= BLOCK:
                    yield rows_of(some)
                    some, many = [], 0
            if some:
                yield rows_of(some)

    return run


def _met():
    """node, need of the rows that are not alone with their t, and of those with t = node."""

    def flush(new: np.ndarray, length: np.ndarray, t: pa.Array, node: pa.Array, need: pa.Array) -> Iterator[pa.RecordBatch]:
        keep = (np.repeat(length, length) > 1) | (t.to_numpy() == node.to_numpy())
        yield pa.RecordBatch.from_arrays([node, need], names=["node", "need"]).filter(pa.array(keep))

    return _runs(["t", "node", "need"], flush)


def _in_company(texts: DataFrame, n_texts: int, n: int, similarity: float, common: np.ndarray, only: DataFrame | None) -> DataFrame:
    """node (and spare) of the texts that may be similar to another, of those in only.

    A set shares at least that part of its hashes with a similar one, so a text goes as soon as more of its hashes than the rest are in no
    other text. They are looked at by quarters of their values. A text that went is similar to none, so it counts no more in the next
    quarter, and no link is lost by that. A quarter that leaves over three fourths of the texts is the last.
    """
    left = None
    for r in range(4):
        some = texts.select("node", "text", F.lit(None).cast("int").alias("spare")) if left is None else texts.join(_few(left, n_left), "node").select("node", "text", "spare")
        rows = some.mapInArrow(_quarter(n, similarity, r, common), "t long, node long, need int").repartition("t").sortWithinPartitions("t").mapInArrow(_met(), "node long, need int")
        now = rows.groupBy("node").agg((F.count(F.lit(1)) - 1 - F.max("need")).cast("int").alias("spare")).where("spare >= 0")
        now = materialize(now if only is None or r else now.join(only, "node", "left_semi"))
        discard(*([left] if r else []))
        left, before, n_left = now, n_left if r else n_texts, now.count()
        if 4 * n_left > 3 * before:
            break
    return left


def _few(nodes: DataFrame, n: int) -> DataFrame:
    return F.broadcast(nodes) if n <= BROADCAST_KEYS else nodes.hint("merge")


def _near(size: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether a pair's first common hash leaves enough of both sets behind it; no similar pair is lost by that test."""
    return np.minimum(size[x] - pos[x], size[y] - pos[y]) * (1 + similarity) >= similarity * (size[x] + size[y]) - 1e-6


def _pairs(new: np.ndarray, length: np.ndarray, place: np.ndarray, label: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows x, y of the same run and different labels that may be similar by size and place."""
    size, pos = place >> 32, place & 0xFFFFFFFF
    for k in np.unique(length[length > 1]):
        every = new[length == k]
        i, j = np.triu_indices(k, 1)
        for s in np.array_split(every, -(-len(every) * len(i) // BLOCK)):
            x, y = (s[:, None] + i).ravel(), (s[:, None] + j).ravel()
            keep = (label[x] != label[y]) & _near(size, pos, x, y, similarity)
            yield x[keep], y[keep]


def _open(similarity: float):
    """The rows that may be similar, by size and place, to one of their run in another component."""

    def flush(new: np.ndarray, length: np.ndarray, *cols: pa.Array) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(len(cols[0]), dtype=bool)
        for x, y in _pairs(new, length, cols[2].to_numpy(), cols[3].to_numpy(), similarity):
            keep[x] = keep[y] = True
        yield pa.RecordBatch.from_arrays(list(cols), names=["t", "node", "place", "label"]).filter(pa.array(keep))

    return _runs(["t", "node", "place", "label"], flush)


def _meet(similarity: float):
    """a, b: pairs of nodes with an equal t, in different components, that may be similar by size, place and sketch."""

    def flush(new: np.ndarray, length: np.ndarray, t: pa.Array, node: pa.Array, place: pa.Array, label: pa.Array, sketch: pa.Array) -> Iterator[pa.RecordBatch]:
        node, place, label = (c.to_numpy() for c in (node, place, label))
        width, rows = _by_width(sketch)
        at = np.zeros(len(node), dtype=np.int64)
        for w in rows:
            at[width == w] = np.arange(len(rows[w]))
        found = [np.zeros((2, 0), dtype=np.int64)]
        for x, y in _pairs(new, length, place, label, similarity):
            for w in rows:
                for v in rows:
                    some = (width[x] == w) & (width[y] == v)
                    a, b = x[some], y[some]
                    may = _may_be_similar(rows[w][at[a]], rows[v][at[b]], similarity)
                    a, b = node[a[may]], node[b[may]]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return _runs(["t", "node", "place", "label", "sketch"], flush)


def _sketch(s: np.ndarray) -> np.ndarray:
    """How many hashes of the sorted set s fall in each of WIDTH, or for larger sets 4, 16, ... times as many, equal ranges of hashes."""
    width = WIDTH
    while len(s) >= 8 * width:
        width *= 4
    return np.bincount((s >> np.uint64(65 - width.bit_length())).astype(np.int64), minlength=width).astype("<u2")


def _may_be_similar(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows of sketches x and y, of one width or to be folded to the lesser, leave room for that similarity.

    Two sets share no more hashes than the lesser count of each range, so no similar pair is lost.
    """
    width = min(x.shape[-1], y.shape[-1])
    x, y = (v if v.shape[-1] == width else v.reshape(*v.shape[:-1], width, v.shape[-1] // width).sum(axis=-1, dtype=np.uint16) for v in (x, y))
    total = x.sum(axis=-1, dtype=np.int64) + y.sum(axis=-1, dtype=np.int64)
    return np.minimum(x, y).sum(axis=-1, dtype=np.int64) * (1 + similarity) >= similarity * total - 1e-6


def _by_width(sketches: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Width of each sketch, and the sketches of a width as rows."""
    flat = sketches.combine_chunks() if isinstance(sketches, pa.ChunkedArray) else sketches
    raw = [np.frombuffer(v.as_buffer(), "<u2") for v in flat]
    width = np.array([len(v) for v in raw], dtype=np.int64)
    return width, {int(w): np.stack([raw[i] for i in np.flatnonzero(width == w)]) for w in np.unique(width)}


def _sifted(similarity: float):
    """Of pairs with their sketches, those that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            (wx, xs), (wy, ys) = _by_width(batch.column(3)), _by_width(batch.column(4))
            for w in xs:
                for v in ys:
                    rows = np.flatnonzero((wx == w) & (wy == v))
                    x, y = (m[np.searchsorted(np.flatnonzero(width == k), rows)] for m, width, k in ((xs[w], wx, w), (ys[v], wy, v)))
                    keep[rows] = _may_be_similar(x, y, similarity)
            yield batch.select([0, 1, 2]).filter(pa.array(keep))

    return run


def _sift_tile(similarity: float):
    """node: the odd rows of a tile that may be similar to a row of another label, and those rows."""

    def run(table: pa.Table) -> pa.Table:
        odd = table.column("odd").to_numpy()
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        width, rows = _by_width(table.column("sketch"))
        place = np.zeros(len(node), dtype=np.int64)
        for w in rows:
            place[width == w] = np.arange(len(rows[w]))
        others = {w: np.flatnonzero(~odd & (width == w)) for w in rows}
        found = np.zeros(len(node), dtype=bool)
        for x in np.flatnonzero(odd):
            for w, some in others.items():
                near = some[(label[some] != label[x]) & _may_be_similar(rows[int(width[x])][place[x]][None], rows[w][place[some]], similarity)]
                found[near] = True
                found[x] |= len(near) > 0
        return pa.table({"node": np.unique(node[found])})

    return run


def _tile(similarity: float):
    """a, b: for each odd row of a tile, one similar row of each other label."""

    def run(table: pa.Table) -> pa.Table:
        odd = table.column("odd").to_numpy()
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        s = table.column("s").combine_chunks()
        size = np.diff(s.offsets.to_numpy())
        ids = np.unique(s.flatten().to_numpy(), return_inverse=True)[1]
        ends = np.cumsum(size)
        alls = np.flatnonzero(~odd)
        of = np.concatenate([np.zeros(0, dtype=np.int64), *(ids[ends[i] - size[i] : ends[i]] for i in alls)])
        stop = np.cumsum(size[alls])
        mark = np.zeros(len(ids) + 1, dtype=bool)
        found = []
        for x in np.flatnonzero(odd):
            mine = ids[ends[x] - size[x] : ends[x]]
            mark[mine] = True
            hits = np.concatenate([[0], np.cumsum(mark[of])])
            mark[mine] = False
            shared = hits[stop] - hits[stop - size[alls]]
            near = alls[(shared >= similarity * (size[x] + size[alls] - shared)) & (label[alls] != label[x])]
            found += [(min(node[x], node[y]), max(node[x], node[y])) for y in near[np.unique(label[near], return_index=True)[1]]]
        e = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    return run


def _tiles(own: DataFrame, value: DataFrame, tile: int, at_once: float, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Distinct rows that work gives on tiles of rows of own (node, label, g) with their value.

    A tile (g, i, j) has about tile odd rows of a group, those outside its largest component, and about tile rows of all. As every odd row
    meets all, rows are copied to many tiles: no more than about at_once copies are made before they are worked off.
    """
    sizes = own.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("k"))
    sizes = sizes.select("g", F.col("m.label").alias("main"), "k", (F.col("k") - F.col("m.k")).alias("o")).where("o > 0")
    sizes = materialize(sizes.withColumns({"nj": F.ceil(F.col("k") / tile), "ni": F.ceil(F.col("o") / tile)}))
    copies = sizes.agg(F.sum(F.expr("k * ni + o * nj"))).first()[0] or 0
    rows = own.join(sizes, "g").join(value, "node").withColumn("h", F.xxhash64("node"))
    named = ["node", "label", *[c for c in value.columns if c != "node"]]
    every = rows.select("g", F.explode(F.expr("sequence(0L, ni - 1)")).alias("i"), F.expr("pmod(h, nj)").alias("j"), F.lit(False).alias("odd"), *named)
    odd = rows.where("label <> main").select("g", F.expr("pmod(h, ni)").alias("i"), F.explode(F.expr("sequence(0L, nj - 1)")).alias("j"), F.lit(True).alias("odd"), *named)
    both, out = every.union(odd), []
    slices = max(1, math.ceil(copies / max(at_once, 1)))
    for r in range(slices):
        some = both if slices == 1 else both.where(F.pmod(F.xxhash64("g", "i", "j"), F.lit(slices)) == r)
        out.append(materialize(some.groupBy("g", "i", "j").applyInArrow(work, schema).distinct()))
    done = materialize(reduce(DataFrame.union, out).distinct()) if slices > 1 else out[0]
    discard(sizes, *(out if slices > 1 else ()))
    return done


def _across(hot: DataFrame, verified: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, tile: int, texts: int) -> DataFrame | None:
    """a, b: similar pairs between the components of the verified links, of nodes that share a hash of hot (a: its least node, b, t).

    Nodes tied by such hashes are a group, parted by size: similar sets are in one band of sizes or in neighbouring ones, and a part holds
    two bands. All its nodes outside its largest component meet all its nodes, in tiles of about tile x tile: first their sketches, then
    the whole sets of the nodes that have a likely partner. A tile gives no more than one link a row and component.
    """
    label = materialize(components(verified))
    named = materialize(hot.select("t", "a", F.col("b").alias("node")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    open_ = materialize(named.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("t"))
    n_open = open_.count()
    if not n_open:
        return None
    left = materialize(named.join(F.broadcast(open_) if n_open <= BROADCAST_KEYS else open_, "t", "left_semi").select("a", "node", "label").distinct())
    group = components(left.select("a", F.col("node").alias("b")))
    own = left.select("node", F.col("label").alias("c")).distinct().join(group, "node", "left").select("node", F.col("c").alias("label"), F.coalesce("label", "node").alias("g"))
    # a little wider than the similarity, so that rounding parts no pair
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(1.001 / similarity)) if similarity < 1 else F.col("size")
    own = materialize(own.join(sketches.select("node", band.alias("z")), "node").select("node", "label", F.explode(F.array(F.xxhash64("g", "z"), F.xxhash64("g", F.col("z") + 1))).alias("g")))
    likely = _tiles(own, sketches.select("node", "sketch"), tile, SLICE * texts, _sift_tile(similarity), "node long")
    whole = sets_of(likely)
    few = materialize(own.join(likely, "node", "left_semi"))
    pairs = _tiles(few, whole, tile, WHOLE * texts, _tile(similarity), "a long, b long")
    discard(label, named, open_, left, own, likely, whole, few)
    return pairs


def similar_links(texts: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, only: DataFrame | None = None, known: DataFrame | None = None, run_of: int = RUN, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """a, b: pairs of nodes of texts (node, text; node distinct) with that Jaccard similarity of n-word shingles, enough to connect all that are connected.

    only: the nodes to compare, if not all. known: links (a, b) that hold already; pairs
    that they connect are not tried, and the result has them too.

    Only texts that share enough hashes with others are compared (_in_company); they are written once more, if need be all of them.
    An exact prefix-filter join: similar sets share one of their rarest hashes. Nodes of a hash in up to run_of prefixes meet: each the
    least one first, then all that are still in different components. Of a more common hash all meet its least node too, then only those
    still in different components (_across). Pairs whose sketches leave no room for the similarity go where they meet, before they are
    written; the others are verified on their whole sets. What grows faster than the texts is done in slices of SLICE or WHOLE rows a text.
    Which hashes count as common, from one text in sample, orders the work and leaves the result alone.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), n).view(np.int64))], names=["t"])

    seen = texts.where(F.pmod(F.xxhash64("node"), F.lit(sample)) == 0).select("text").mapInArrow(every, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("k"))
    most = materialize(seen.where(F.col("k") * sample > run_of).orderBy(F.desc("k"), "t").limit(ORDERED))
    top = most.toArrow()
    discard(most)
    common, counts = top.column("t").to_numpy().view(np.uint64), top.column("k").to_numpy()
    common, counts = common[np.argsort(common)], counts[np.argsort(common)]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), n) for t in batch.column(1)]
            both = [_prefix(s, similarity, common, counts) for s in sets]
            size = pa.array([len(s) for s in sets], pa.int64())
            rare, hot = (pa.array([x[c] for x in both], pa.list_(pa.int64())) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), size, rare, hot, pa.array([_sketch(s).tobytes() for s in sets], pa.binary())], names=["node", "size", "rare", "hot", "sketch"])

    n_texts = texts.count()
    company = _in_company(texts, n_texts, n, similarity, common, only)
    texts = materialize(texts.select("node", "text").join(_few(company, company.count()), "node", "left_semi"))
    own = materialize(texts.mapInArrow(prefixes, "node long, size long, rare array<long>, hot array<long>, sketch binary"))
    sketches = materialize(own.select("node", "size", "sketch"))
    rare = own.select("node", "size", F.posexplode("rare").alias("pos", "t")).select("t", "node", F.expr("shiftleft(size, 32) + pos").alias("place"))
    shared = materialize(rare.repartition("t").sortWithinPartitions("t").mapInArrow(_shared(run_of, similarity), "t long, node long, place long, least long, many boolean, star boolean"))
    hot = own.select("node", F.explode("hot").alias("t"))
    least = hot.groupBy("t").agg(F.min("node").alias("a"))  # at most ORDERED rows
    crowd = shared.where("many").select(F.col("least").alias("a"), F.col("node").alias("b"), "t")
    crowd = materialize(crowd.union(hot.join(F.broadcast(least), "t").select("a", F.col("node").alias("b"), "t")))
    discard(own, company)
    few = shared.where("not many")

    def labelled(some: DataFrame, label: DataFrame, node: str, into: str) -> DataFrame:
        return some.join(label.select(F.col("node").alias(node), F.col("label").alias(into)), node, "left").withColumn(into, F.coalesce(into, node))

    def sliced(rows: DataFrame, key: list[str], at_once: float, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Distinct rows that work gives on slices by key of written rows, which go."""
        slices, out = max(1, math.ceil(rows.count() / max(at_once, 1))), []
        for r in range(slices):
            out.append(materialize(work(rows if slices == 1 else rows.where(F.pmod(F.xxhash64(*key), F.lit(slices)) == r)).distinct()))
        done = materialize(reduce(DataFrame.union, out).distinct()) if slices > 1 else out[0]
        discard(rows, *(out if slices > 1 else ()))
        return done

    def meet(label: DataFrame) -> DataFrame:
        """Pairs of shared hashes between components that may be similar. Only rows with a possible partner get their sketches."""
        rows = labelled(few, label, "node", "label").select("t", "node", "place", "label")
        rows = materialize(rows.repartition("t").sortWithinPartitions("t").mapInArrow(_open(similarity), "t long, node long, place long, label long"))
        return sliced(rows, ["t"], SLICE * n_texts, lambda some: some.join(sketches.drop("size"), "node").select("t", "node", "place", "label", "sketch").repartition("t").sortWithinPartitions("t").mapInArrow(_meet(similarity), "a long, b long"))

    def sift(some: DataFrame, label: DataFrame) -> DataFrame:
        """Of pairs (a, b), those between components that may be similar."""
        apart = materialize(labelled(labelled(some, label, "a", "x"), label, "b", "y").where("x <> y").select("a", "b").distinct())
        x, y = (sketches.select(F.col("node").alias(c), F.col("sketch").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        return sliced(apart, ["a", "b"], SLICE * n_texts / 2, lambda some: some.join(x, "a").join(y, "b").select("a", "b", F.lit(True).alias("star"), "x", "y").mapInArrow(_sifted(similarity), "a long, b long, star boolean").select("a", "b"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([shingle_set(text.as_py(), n).view(np.int64)], pa.list_(pa.int64()))], names=["node", "s"])

    def sets_of(needed: DataFrame) -> DataFrame:
        return materialize(texts.join(_few(needed, needed.count()), "node", "left_semi").select("node", "text").mapInArrow(sets, "node long, s array<long>"))

    def verify(every: DataFrame) -> DataFrame:
        slices, out = max(1, math.ceil(every.count() / max(WHOLE * n_texts, 1))), []
        for r in range(slices):
            some = every if slices == 1 else every.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == r)
            needed = materialize(some.select(F.explode(F.array("a", "b")).alias("node")).distinct())
            whole = sets_of(needed)
            both = some.join(whole.select(F.col("node").alias("a"), "s"), "a").join(whole.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
            common = F.size(F.array_intersect("s", "t"))
            out.append(materialize(both.where(common >= similarity * (F.size("s") + F.size("t") - common)).select("a", "b")))
            discard(needed, whole)
        return reduce(DataFrame.union, out)

    # the pairs with the least node of a run settle most; of the others only those between components are left to compare
    first = materialize(components(known)) if known is not None else texts.sparkSession.createDataFrame([], "node long, label long")
    hubs = few.where("star").select(F.col("least").alias("a"), F.col("node").alias("b")).union(crowd.select("a", "b").where("a <> b"))
    stars = sift(hubs.distinct(), first)
    found = verify(stars)
    found = found if known is None else known.union(found)
    label = materialize(components(found))
    others = meet(label)
    found = found.union(verify(others))
    discard(label, stars, others, shared)
    more = _across(crowd, found, sketches, sets_of, similarity, tile, n_texts)
    discard(texts, sketches, crowd)
    return found if more is None else found.union(more)


def simhash_links(texts: DataFrame, only: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: the links of operator 5 between nodes of texts (node, text) that are in only: nodes of one fingerprint, and of two within RADIUS bits."""
    own = fingerprints(texts.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "fp")
    own = materialize(own.join(only, "node", "left_semi"))
    fps = materialize(own.groupBy("fp").agg(F.min("node").alias("a")))
    near = materialize(links(fps.select(F.lit(0).cast("long").alias("r"), "fp"), bucket))
    between = near.select(F.col("a").alias("fp"), F.col("b").alias("other")).join(fps, "fp").select("a", F.col("other").alias("fp")).join(fps.withColumnRenamed("a", "b"), "fp").select("a", "b")
    out = materialize(own.join(fps, "fp").where("a <> node").select("a", F.col("node").alias("b")).union(between))
    discard(own, fps, near)
    return out


def drop_near_duplicates(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, by_simhash: bool = False) -> DataFrame:
    """The documents, all columns, one of each group of exact or near copies: the one of least doc_id (null last).

    by_simhash: texts link first as in operator 5, by SimHash fingerprints within RADIUS bits; pairs of that Jaccard similarity whose
    fingerprints lie further apart are found by the exact join, between the groups that SimHash leaves. Else by the exact join alone.
    """
    names = docs.columns
    keyed = materialize(docs.withColumn("_sh_row", F.monotonically_increasing_id()))
    ids = keyed.select("_sh_row", F.col("doc_id").cast("long").alias("_d"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("_t"))
    # exact copies, told by 128 bits: the least (doc_id, row) stands for its text
    order = F.struct(F.col("_d").isNull(), "_d", "_sh_row")
    firsts = materialize(ids.groupBy("_t").agg(F.min(order).alias("o")).select(F.col("o._sh_row").alias("node"), F.col("o._d").alias("d")))
    texts = keyed.select(F.col("_sh_row").alias("node"), F.col("text").cast("string").alias("text"))
    known = simhash_links(texts, firsts.select("node")) if by_simhash else None
    label = components(similar_links(texts, n, similarity, only=firsts.select("node"), known=known))
    named = firsts.join(label, "node", "left").select("node", "d", F.coalesce("label", "node").alias("label"))
    stay = named.groupBy("label").agg(F.min(F.struct(F.col("d").isNull(), "d", "node")).alias("o")).select(F.col("o.node").alias("_sh_row"))
    stay = materialize(stay)
    discard(firsts, label, *([known] if by_simhash else []))
    return keyed.join(stay.hint("merge"), "_sh_row", "left_semi").select(*[F.col(f"`{c}`") for c in names])


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
