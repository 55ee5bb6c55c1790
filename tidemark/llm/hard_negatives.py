"""Operator 13, hard-negative mining: exact top lists by inner product from k-means inverted lists.

An anchor's positives are the best rows of its own label; for each positive, the negatives are the best rows of other labels whose score
lies in a window below the positive's. Rows stand in inverted lists: centroids are fitted on a bounded sample, every row goes to its
nearest one, and a list stores its radius, the largest distance of a member. By Cauchy and Schwarz a member's product with an anchor
differs from the centroid's by at most radius times the anchor's length, which bounds a list's scores from above and below. An anchor
visits the lists with the highest upper bounds first; after that only lists whose upper bound isn't strictly below the kth score found,
and lists wholly outside the windows are skipped. So results equal those over all pairs, whatever the sample and the centroids.

How it runs: lists are cut into segments of some LIST_ROWS rows and these into blocks of BLOCK_ROWS, so that a list that holds a third of
all rows is many tasks; anchors of a list travel in batches of ANCHORS, once for each segment; a task multiplies block and batch matrices
and keeps the best of each. The driver sees the sample and one row a list. Blocks are written to the shared folder.

Numbers: components become floor(scale * x). Vectors whose products could reach 2^50 raise ValueError (at 64 components: beyond 16,000);
below that doubles hold products exactly.
Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do vectors of another length
than that of the smallest id. "Other" rows have another id; repeated rows each take a place in a list; of several anchor rows of one id
the one of least label (then least stored bytes) counts once. No rows give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import binary_rows, finite_rows, floors, matrix

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Centroids are fitted on at most SAMPLE rows, those of least hash; there are at most LISTS.
SAMPLE, LISTS, ROUNDS = 16_384, 256, 8
LIST_ROWS, BLOCK_ROWS, ANCHORS, FIRST = 32_768, 2_048, 256, 8
#: A list's labels are stored while there are at most so many of them.
LABELS = 32

MOST = 2.0**50
_ROW = "id long, label long, x binary"
_BATCH = "list int, ids binary, labels binary, xs binary, lows binary, highs binary, floors binary"


@dataclass(frozen=True)
class Lists:
    """One row a list: whole-number centroid, radius, rows, segments, and its labels (none: more than LABELS)."""

    centroids: np.ndarray
    radius: np.ndarray
    segments: np.ndarray
    labels: list[frozenset[int] | None]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds (anchor, list), widened by more than doubles can lose."""
        middle = x @ self.centroids.T.astype(np.float64)
        spread = np.sqrt((x * x).sum(axis=1))[:, None] * self.radius
        loss = 1e-9 * (np.abs(middle) + spread) + 1
        return middle + spread + loss, middle - spread - loss

    def holds(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """Whether a list may hold rows of the label, or rows of other labels (anchor, list)."""
        kinds, at = np.unique(labels, return_inverse=True)
        told = np.array([[own is None or (k in own if same else bool(own - {k})) for own in self.labels] for k in kinds.tolist()], dtype=bool)
        return told.reshape(len(kinds), len(self.labels))[at]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of a nearest centroid and the distance to it, rounded up."""
    c = centroids.astype(np.float64)
    at = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
    return at, np.sqrt(((x - c[at]) ** 2).sum(axis=1)) * (1 + 1e-9)


def centroids_of(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Whole-number k-means centroids of a sample, started from evenly spaced rows."""
    k = min(lists, max(1, len(x) // 32))
    c = x[np.arange(k) * len(x) // k].astype(np.float64)
    for _ in range(rounds):
        at, _ = nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.rint(c).astype(np.int64)


def whole_rows(df: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """id, label, x (binary whole numbers) of every row that takes part."""
    rows = finite_rows(df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")), "v").where("id is not null and label is not null")
    first = rows.agg(F.min_by(F.size("v"), "id").alias("n")).first()
    width = first.n or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = floors(batch.column(2), scale)
                if x.size and float(np.abs(x).max()) ** 2 * width >= MOST:
                    raise ValueError("inner products could reach 2^50")
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], binary_rows(x.astype(np.int32))], names=["id", "label", "x"])

    return rows.where(F.size("v") == F.lit(width)).mapInArrow(run, _ROW)


def vectors(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column (row, component) as doubles."""
    return matrix(column, "<i4").astype(np.float64)


def sampled(rows: DataFrame, most: int) -> np.ndarray:
    """At most so many rows' vectors, those of least hash of the id; a threshold keeps tasks from sending more than they must."""
    n = rows.count()
    share = min(1.0, 1.5 * most / max(n, 1))
    told = rows.select("id", "x", F.xxhash64("id").alias("h")).where(F.pmod("h", F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    got = told.orderBy("h", "x").limit(most).select("x").toArrow()
    return vectors(got.column("x").combine_chunks())


def listed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows, their list and distance to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far = nearest(vectors(batch.column(2)), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], names=["id", "label", "x", "list", "far"])

    return rows.mapInArrow(run, f"{_ROW}, list int, far double")


def indexed(rows: DataFrame, centroids: np.ndarray) -> tuple[DataFrame, Lists]:
    """The blocks (list, segment, ids, labels, xs), written, and one row a list."""
    spark, k = rows.sparkSession, len(centroids)
    at = listed(rows, centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, labels = np.zeros(k, np.int64), np.zeros(k), [set() for _ in range(k)]
        for batch in batches:
            own = batch.column(3).to_numpy()
            n += np.bincount(own, minlength=k)
            np.maximum.at(far, own, batch.column(4).to_numpy())
            for i, label in set(zip(own.tolist(), batch.column(1).to_pylist(), strict=True)):
                if len(labels[i]) <= LABELS:
                    labels[i].add(label)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(far[some]), pa.array([sorted(labels[i]) for i in some], pa.list_(pa.int64()))], names=["list", "n", "far", "labels"])

    # a task gives one row a list with some labels of it, the driver sees one row a list
    parts = at.mapInArrow(sums, "list int, n long, far double, labels array<long>")
    told = {r.list: r for r in parts.groupBy("list").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.slice(F.array_distinct(F.flatten(F.collect_list("labels"))), 1, LABELS + 1).alias("labels")).collect()}
    segments = np.array([-(-told[i].n // LIST_ROWS) if i in told else 0 for i in range(k)])
    lists = Lists(centroids, np.array([told[i].far if i in told else 0.0 for i in range(k)]), segments, [frozenset() if i not in told else frozenset(told[i].labels) if len(told[i].labels) <= LABELS else None for i in range(k)])
    cut = spark.createDataFrame([(i, int(n)) for i, n in enumerate(segments)], "list int, segments int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(3).to_numpy().astype(np.int64) << 32 | batch.column(4).to_numpy()
            ends = [*np.flatnonzero(np.diff(key)) + 1, batch.num_rows] if batch.num_rows else []
            start = 0
            for end in ends:
                if held and _place(held[0]) != (batch.column(3)[start].as_py(), batch.column(4)[start].as_py()):
                    yield _block(held)
                    held = []
                while start < end:
                    some = batch.slice(start, min(end - start, BLOCK_ROWS - sum(h.num_rows for h in held)))
                    held.append(some)
                    start += some.num_rows
                    if sum(h.num_rows for h in held) == BLOCK_ROWS:
                        yield _block(held)
                        held = []
        if held:
            yield _block(held)

    placed = at.join(F.broadcast(cut), "list").select("id", "label", "x", "list", F.pmod(F.xxhash64("id", "label", "x"), "segments").cast("int").alias("segment"))
    blocks = placed.repartition("list", "segment").sortWithinPartitions("list", "segment").mapInArrow(run, "list int, segment int, ids binary, labels binary, xs binary")
    return materialize(blocks), lists


def _place(batch: pa.RecordBatch) -> tuple[int, int]:
    return batch.column(3)[0].as_py(), batch.column(4)[0].as_py()


def _block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One block of rows of one segment, in the order of their ids."""
    ids, labels = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))
    xs, order = np.concatenate([matrix(h.column(2), "<i4") for h in held]), np.argsort(ids, kind="stable")
    place = _place(held[0])
    return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), *(pa.array([v[order].tobytes()]) for v in (ids, labels, xs))], names=["list", "segment", "ids", "labels", "xs"])


def _visits(upper: np.ndarray, fits: np.ndarray, need: np.ndarray | None, first: int) -> np.ndarray:
    """Lists to visit (anchor, list): the first ones by upper bound, or of the others those that are still needed."""
    order = np.argsort(np.where(fits, -upper, np.inf), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
    return fits & (place < first) if need is None else fits & (place >= first) & need


def routed(anchors: DataFrame, lists: Lists, same: bool, later: bool, first: int) -> DataFrame:
    """Batches of anchors for each list that they visit.

    anchors: id, label, x, and one number a slot: lows, highs (the window) and floors (the kth score so far, later visits only).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * ANCHORS):
                part = batch.slice(a, 4 * ANCHORS)
                labels, x = part.column(1).to_numpy(), vectors(part.column(2))
                low, high, floor = (np.stack(part.column(i).to_numpy(zero_copy_only=False)) for i in (3, 4, 5))
                upper, lower = lists.bounds(x)
                inside = (upper[:, None, :] >= low[:, :, None]) & (lower[:, None, :] <= high[:, :, None])
                fits = lists.holds(labels, same) & inside.any(axis=1) & (lists.segments > 0)
                need = (inside & (upper[:, None, :] >= floor[:, :, None])).any(axis=1) if later else None
                row, at = np.nonzero(_visits(upper, fits, need, first))
                if len(row):
                    cols = [part.column(i).take(pa.array(row)) for i in (0, 1, 2)]
                    packed = [binary_rows(v[row]) for v in (low, high, floor)]
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *cols, *packed], names=["list", "id", "label", "x", "low", "high", "floor"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            ends = [*np.flatnonzero(np.diff(at)) + 1, len(at)] if len(at) else []
            start = 0
            for end in ends:
                for a in range(start, end, ANCHORS):
                    part = batch.slice(a, min(ANCHORS, end - a))
                    yield pa.RecordBatch.from_arrays([pa.array([int(at[a])], pa.int32()), *(pa.array([part.column(i).to_numpy().tobytes()]) for i in (1, 2)), *(pa.array([b"".join(part.column(i).to_pylist())]) for i in (3, 4, 5, 6))], names=["list", "ids", "labels", "xs", "lows", "highs", "floors"])
                start = end

    rows = anchors.select("id", "label", "x", "lows", "highs", "floors").mapInArrow(run, f"list int, {_ROW}, low binary, high binary, floor binary")
    # anchors of one list go to several tasks; a batch need not be full
    return rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("list").mapInArrow(pack, _BATCH)


def best(scores: np.ndarray, fits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best fitting columns of each row: higher scores, then earlier columns."""
    n = scores.shape[1]
    key = np.where(fits, -scores * n + np.arange(n), np.iinfo(np.int64).max)
    top = np.argpartition(key, most - 1, axis=1)[:, :most] if n > most else np.broadcast_to(np.arange(n), key.shape)
    row = np.repeat(np.arange(len(scores)), top.shape[1])
    column = top.ravel()
    keep = fits[row, column]
    return row[keep], column[keep]


def visited(batches: DataFrame, blocks: DataFrame, lists: Lists, same: bool, most: int) -> DataFrame:
    """anchor, slot, id, score: the best rows of each block for each anchor and slot."""
    width = lists.centroids.shape[1]

    def run(joined: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in joined:
            for pair in pairs.to_pylist():
                ids, labels, anchors, own = (np.frombuffer(pair[c], np.int64) for c in ("ids", "labels", "a_ids", "a_labels"))
                x, y = (np.frombuffer(pair[c], np.int32).reshape(-1, width).astype(np.float64) for c in ("a_xs", "xs"))
                scores = (x @ y.T).astype(np.int64)
                alike = own[:, None] == labels
                fits = alike & (anchors[:, None] != ids) if same else ~alike
                low, high, floor = (np.frombuffer(pair[c], np.int64).reshape(len(anchors), -1) for c in ("a_lows", "a_highs", "a_floors"))
                out = []
                for slot in range(low.shape[1]):
                    inside = fits & (scores >= np.maximum(low, floor)[:, slot, None]) & (scores <= high[:, slot, None])
                    some = np.flatnonzero(inside.any(axis=1))
                    row, column = best(scores[some], inside[some], most)
                    out.append((anchors[some[row]], np.full(len(row), slot), ids[column], scores[some[row], column]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in zip(*out, strict=True)], names=["anchor", "slot", "id", "score"])

    segments = batches.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(lists.segments) if n], "list int, n int")
    # one row a list: a batch goes to each of the list's segments
    sent = batches.join(F.broadcast(segments), "list").select("list", F.explode(F.expr("sequence(0, n - 1)")).alias("segment"), *(F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "xs", "lows", "highs", "floors")))
    return sent.join(blocks, ["list", "segment"]).mapInArrow(run, "anchor long, slot long, id long, score long")


def _top(found: DataFrame, most: int) -> DataFrame:
    """The best of each anchor and slot; Spark limits each task's rows before the shuffle."""
    return found.withColumn("rank", F.expr("row_number() over (partition by anchor, slot order by score desc, id)")).where(F.col("rank") <= most)


def searched(anchors: DataFrame, blocks: DataFrame, lists: Lists, same: bool, most: int, slots: int, first: int = FIRST) -> DataFrame:
    """anchor, slot, id, score, rank: the best rows within each slot's window. Written."""
    started = materialize(_top(visited(routed(anchors, lists, same, False, first), blocks, lists, same, most), most))
    kth = started.where(F.col("rank") == most).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
    never = F.lit(-(2**63)).cast("long")
    floors_ = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.try_element_at("kth", i.cast("long")), never))
    again = anchors.drop("floors").join(kth, anchors["id"] == kth["anchor"], "left").select("id", "label", "x", "lows", "highs", floors_.alias("floors"))
    rest = visited(routed(again, lists, same, True, first), blocks, lists, same, most)
    out = materialize(_top(started.drop("rank").unionByName(rest), most))
    discard(started)
    return out


def mine(df: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, lists: int = LISTS, sample: int = SAMPLE, first: int = FIRST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: a condition on the column id. A negative's score s and its positive's p satisfy low * p <= 100 * s <= high * p (low and high above 0).
    """
    rows = whole_rows(df, key, label, vector, scale)
    some = sampled(rows, sample)
    if not len(some):
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks, told = indexed(rows, centroids_of(some, lists, ROUNDS))
    least, most = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    anchors = materialize(rows.where(anchor).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x", F.array(least).alias("lows"), F.array(most).alias("highs"), F.array(least).alias("floors")))
    near = searched(anchors, blocks, told, True, positives, 1, first)
    # whole-number ends of the window, which a negative score turns round
    window = near.where("score >= 0").select("anchor", (F.col("rank") - 1).alias("slot"), F.expr(f"({low} * score + 99) div 100").alias("lo"), F.expr(f"{high} * score div 100").alias("hi"))
    window = window.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("lo", "hi")))).alias("w"))

    def ends(end: str, none: Column) -> Column:
        """An end of each slot's window; a slot without a window has none that fits."""
        return F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("w", i)[end], none))

    asked = anchors.select("id", "label", "x").join(window, anchors["id"] == window["anchor"]).select("id", "label", "x", ends("lo", most).alias("lows"), ends("hi", least).alias("highs"), F.array_repeat(least, positives).alias("floors"))
    far = searched(asked, blocks, told, False, negatives, positives, first)
    discard(blocks, anchors)
    own = near.select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(own, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def digest(df: DataFrame) -> DataFrame:
    """The query's labels and anchors: where the id is divisible by 7 the label is the next of ten, anchors have ids divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0)
