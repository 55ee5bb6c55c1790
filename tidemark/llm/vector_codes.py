"""Operator 11, vector code compression: product quantisation of embeddings by exact whole-number k-means.

A vector's components become whole numbers and are cut into equal parts; each part is stored as the index of its codebook's nearest
entry. The codebooks start from the vectors of the smallest ids and improve in rounds. A round is one RDD treeAggregate over columnar
NumPy blocks (part, component, row): distances accumulate component by component, np.add.at gathers int64 sums and counts, and the
tensors (parts x entries x width, whatever the data) merge through a reduction tree. Sums of whole numbers are alike in any order, so
the codebooks do not depend on the partitioning. Nothing is cached: each round reads the input again, and a lost executor's blocks are
read again.

Defined cases: a null vector and one with a null or non-finite component is left out; so is a vector of another length than that of the
smallest id (it has no codebook). Among rows of one id the least vector starts an entry; every row gets its code. A null id starts no
entry unless there is no other. Fewer ids than entries give smaller codebooks, no rows give an empty result. A vector whose squared
distances could leave 64 bits, or a length that the parts do not divide, raises ValueError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.rdd import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite_rows, floors

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances to all entries are held at once.
ROWS = 1024
#: A label with over 1 / HOT of all rows joins by broadcast (there are fewer than HOT of them), the others by a shuffle.
HOT = 1000

Sums = tuple[np.ndarray, np.ndarray]


def columnar(x: np.ndarray, parts: int) -> np.ndarray:
    """(part, component, row) of vectors (row, component)."""
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 2, 0))


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry (ties: the lower index) for part (component, row) and book (entry, component)."""
    most = max((int(np.abs(v).max()) for v in (part, book) if v.size), default=0)
    if 4 * most * most * len(part) >= 2**63:
        raise ValueError("squared distances leave 64 bits")
    kind = np.int32 if 4 * most * most * len(part) < 2**31 else np.int64
    index, least = np.empty(part.shape[1], np.int64), np.empty(part.shape[1], np.int64)
    for a in range(0, part.shape[1], ROWS):
        some = part[:, a : a + ROWS].astype(kind)
        d = np.zeros((some.shape[1], len(book)), kind)
        for x, entry in zip(some, book.T.astype(kind), strict=True):
            step = x[:, None] - entry
            d += step * step
        index[a : a + ROWS] = d.argmin(axis=1)
        least[a : a + ROWS] = d.min(axis=1)
    return index, least


def gather(into: Sums, block: np.ndarray, books: np.ndarray) -> Sums:
    """Add a block's parts to the sums and counts of their nearest entries."""
    sums, counts = into
    for p, part in enumerate(block):
        index, _ = nearest(part, books[p])
        np.add.at(sums[p], index, part.T)
        np.add.at(counts[p], index, 1)
    return sums, counts


def merge(a: Sums, b: Sums) -> Sums:
    return a[0] + b[0], a[1] + b[1]


def blocks(rows: DataFrame, scale: int, parts: int) -> RDD:
    """Columnar blocks of the vectors, one for each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([columnar(floors(batch.column(0), scale), parts).tobytes()])], names=["n", "x"])

    packed = rows.select("_v").mapInArrow(run, "n long, x binary").rdd
    return packed.map(lambda r: np.frombuffer(r.x, np.int64).reshape(parts, -1, r.n))


def first_books(rows: DataFrame, scale: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, component) of the vectors of the smallest ids; none without rows."""
    ids = rows.groupBy("_id").agg(F.min("_v").alias("_v")).orderBy(F.col("_id").asc_nulls_last()).limit(entries).collect()
    ids = [r._v for r in ids if r._id is not None or len(ids) == 1]
    ids = [v for v in ids if len(v) == len(ids[0])]
    if not ids:
        return np.zeros((parts, 0, 0), np.int64)
    if len(ids[0]) % parts:
        raise ValueError(f"vectors of {len(ids[0])} components can't be cut into {parts} equal parts")
    x = floors(pa.array(ids, pa.list_(pa.float64())), scale)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def fit(rows: DataFrame, books: np.ndarray, scale: int, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds; an entry that no part chooses stays."""
    parts = blocks(rows, scale, len(books))
    for _ in range(rounds):
        zero = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        sums, counts = parts.treeAggregate(zero, lambda into, block, books=books: gather(into, block, books), merge, depth=2)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def books_sha256(books: np.ndarray) -> str:
    """Of all components as decimal numbers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, the columns to keep, codes array<int>, error) of every usable row, and the codebooks (part, entry, component)."""
    kept = [f"_k{i}" for i in range(len(keep))]
    rows = finite_rows(df.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True))), "_v")
    books = first_books(rows.select("_id", "_v"), scale, parts, entries)
    rows = rows.where(F.size("_v") == F.lit(books.shape[0] * books.shape[2]))
    if books.size:
        books = fit(rows, books, scale, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(part, book) for part, book in zip(columnar(floors(batch.column(0), scale), parts), books, strict=True)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([listed, pa.array(sum(e for _, e in found)), *batch.columns[1:]], names=["_codes", "_error", *batch.schema.names[1:]])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = rows.select("_v", "_id", *kept).mapInArrow(run, ", ".join(["_codes array<int>", "_error long", *(f"{c} {types[c]}" for c in ("_id", *kept))]))
    return coded.select(F.col("_id").alias(key), *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), F.col("_codes").alias("codes"), F.col("_error").alias("error")), books


def with_group_error(coded: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """label_error: the error summed over equal labels, nulls together.

    Sums are made before any shuffle. Fewer than HOT labels hold over 1 / HOT of all rows each: those join by broadcast, and in the join
    of the others their rows are spread over HOT keys that match nothing.
    """
    sums = coded.groupBy(F.col(label).alias("_l")).agg(F.sum("error").alias("_e"), F.count(F.lit(1)).alias("_n"))
    least = sums.agg(F.sum("_n").alias("_all"))
    told = sums.crossJoin(F.broadcast(least))  # one row: how many rows there are
    hot = told.where(F.col("_n") * HOT > F.col("_all")).select("_l", F.col("_e").alias("_hot"))
    rest = told.where(F.col("_n") * HOT <= F.col("_all")).select("_l", F.col("_e").alias("_rest"), F.lit(0).alias("_s"))
    rows = coded.join(F.broadcast(hot), F.col(label).eqNullSafe(F.col("_l")), "left").drop("_l")
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(key, "codes"), F.lit(HOT))).cast("int")
    joined = rows.withColumn("_spread", spread).join(rest, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_spread") == F.col("_s")), "left")
    return joined.select(*coded.columns, F.coalesce("_hot", "_rest").alias("label_error"))


def digest(df: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    coded, books = compress(df, keep=("label",))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_group_error(coded).select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
