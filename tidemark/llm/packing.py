"""Sequence packing (operator 8): shortest-pack-first over the length histogram.

A document is its token ids and a closing id 0, cut into pieces of at most LENGTH ids. The histogram of piece lengths has
LENGTH bins at most, whatever the input. Lengths are placed longest first: open packing patterns (the lengths in a sequence,
and how many sequences are so packed) are kept by free room; a length goes to the shortest pack, the pattern with most room,
and only the counts of the two patterns change. So the driver holds patterns, never documents. Within its length each piece
has a rank, counted by bucket and then in the bucket, so that a length that a third of all pieces share is no single
task's; patterns own ranges of ranks, and the join of ranks and ranges gives sequence and offset.

A sequence is padded to LENGTH unless its ids are a power of two in number.

Defined results: null and empty texts are the single id 0; very long texts are tokenized whole; repeated rows are packed as often
as they come; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH, CLOSING, BUCKETS = 1024, 0, 256
#: A text with a word or a white-space run longer than these goes to the tokenizer itself.
LONG_WORD, LONG_SPACE = 5000, 500
#: Fixed pattern: how the byte-level tokenizer parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def is_extreme(text: str) -> bool:
    """Whether a slice of half those lengths is one word or white space alone; any longer run holds such a slice."""
    n, m = LONG_SPACE // 2, LONG_WORD // 2
    return any(text[i : i + n].isspace() for i in range(0, len(text) - n + 1, n)) or any(len(text[i : i + m].split(None, 1)) == 1 for i in range(0, len(text) - m + 1, m))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> dict[str, int]:
    """The sign that a byte-level vocabulary writes for each byte: itself where it prints, else the next of those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in plain)
    return signs | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts, as the tokenizer file's own library gives them.

    The file's vocabulary, in which ids rise in the order of merges, is loaded into a faster implementation of the same
    merging; tests hold both equal. Texts with extremely long words or white space go to the file's own library.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        signs = _byte_signs()
        ranks = {bytes(map(signs.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in added}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if is_extreme(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece."""
    path = path or tokenizer_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    schema = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(CLOSING)).astype("<u4")
                starts = range(0, len(ids), length)
                parts = [ids[a : a + length] for a in starts]
                for col, values in zip(cols, ([doc] * len(parts), starts, map(len, parts), map(zlib.crc32, parts), [len(ids)] * len(parts), (x.astype(np.int32) for x in parts)), strict=False):
                    col.extend(values)
                if len(cols[0]) >= 2000:
                    yield _record(cols, names)
                    cols = [[] for _ in names]
            if cols[0]:
                yield _record(cols, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _record(cols: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def patterns(histogram: Mapping[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(piece length, times)]) of each pattern.

    The longest length left goes to the shortest open pack, which has most room; where even that has too little, new packs open.
    Packs that are packed alike are one pattern with a count, so the cost rests on the number of lengths and not on that of pieces.
    """
    open_: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}
    rooms: list[int] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def add(room: int, count: int, packed: tuple[tuple[int, int], ...]) -> None:
        if room == 0:
            done.append((count, list(packed)))
            return
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][packed] = open_[room].get(packed, 0) + count

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not rooms or rooms[-1] < size:
                # a new pack has most room until it is full of this length
                times = min(length // size, left)
                count = left // times
                add(length - times * size, count, ((size, times),))
                left -= count * times
                continue
            room = rooms[-1]
            packed, count = open_[room].popitem()
            used = min(count, left)
            if used < count:
                open_[room][packed] = count - used
            elif not open_[room]:
                del open_[room]
                rooms.pop()
            grown = (*packed[:-1], (size, packed[-1][1] + 1)) if packed[-1][0] == size else (*packed, (size, 1))
            add(room - size, used, grown)
            left -= used
    return done + [(n, list(p)) for room in open_.values() for p, n in room.items()]


def ranges(packed: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, times): ranks of a length in the order of the patterns."""
    out, sequence, rank = [], 0, {}
    for count, parts in packed:
        offset = 0
        for size, times in parts:
            first = rank.get(size, 0)
            rank[size] = first + count * times
            out.append((size, first, rank[size], sequence, offset, times))
            offset += size * times
        sequence += count
    return out


def place(cut: DataFrame, length: int = LENGTH, buckets: int = BUCKETS) -> DataFrame:
    """cut (a written table with doc_id, start, length) and each piece's sequence_id and offset."""
    spark = cut.sparkSession
    keyed = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    # lengths x buckets rows at most, however many pieces there are
    counts = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram: dict[int, int] = {}
    base = []
    for size, b, n in sorted(map(tuple, counts)):
        base.append((size, b, histogram.get(size, 0)))
        histogram[size] = histogram.get(size, 0) + n
    table = ranges(patterns(histogram, length))
    at = spark.createDataFrame(base, "length long, _b long, _base long")
    owned = spark.createDataFrame(table, "length long, _first long, _end long, _sequence long, _offset long, _times long")
    inside = F.expr("row_number() over (partition by length, _b order by doc_id, start, ids_crc32) - 1")
    ranked = keyed.withColumn("_i", inside).join(at, ["length", "_b"]).withColumn("_rank", F.col("_base") + F.col("_i"))
    hit = ranked.join(F.broadcast(owned), (ranked.length == owned.length) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))).drop(owned.length)
    k = F.col("_rank") - F.col("_first")
    placed = hit.withColumn("sequence_id", F.col("_sequence") + F.floor(k / F.col("_times"))).withColumn("offset", F.col("_offset") + k % F.col("_times") * F.col("length"))
    return placed.select(*cut.columns, "sequence_id", "offset")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids)."""
    return place(materialize(pieces(docs, path, length, with_ids)), length)
