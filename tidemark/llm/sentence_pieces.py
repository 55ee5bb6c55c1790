"""Operator 12, SentencePiece encoding and decoding: byte-pair pieces of whole texts by a merge-type prefix table.

Greedy merging (best score first, ties leftmost) gives every prefix of a symbol string one segmentation, and that one is the
segmentation of a shorter prefix and one more piece. So a prefix is stored as its unique last piece: of the pieces that end there (an
Aho-Corasick automaton names them), the one that is compatible with the last piece before it. Two pieces are compatible if merging
their joined symbols gives these two again; a sequence is the merging's result if and only if all neighbours are compatible. Ids are
then recovered backwards from the end. Time is linear in the text, with at most as many tests a symbol as a piece is long.

Texts are cut first where no piece can cross: before a white-space sign that follows another character, and around characters that no
longer piece holds. Cuts change no id; the units' ids are kept in a table of bounded size a worker, as words repeat.

Models: byte-pair type, identity normaliser, no user-defined pieces, any vocabulary; others raise ValueError. Characters outside the
vocabulary become their UTF-8 bytes' pieces, or the unknown id where the model has none (a run of them gives one id).
Defined cases: a null text is empty, an empty text has no ids; other columns are kept as they are by name, repeated rows stay.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries of a worker's tables of units and of pairs. A full table of units becomes the older one, a full table of pairs is emptied.
UNITS, PAIRS = 250_000, 500_000
#: Units longer than this are encoded without being kept.
LONG = 64


def model_path() -> str:
    """The 32,000-piece public model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merged(symbols: Sequence[str], score: dict[str, float]) -> list[str]:
    """Plain merging of a few symbols: the neighbours whose joined text has the best score, leftmost first, until none is a piece."""
    out, never = list(symbols), float("-inf")
    gain = [score.get(a + b, never) for a, b in pairwise(out)]
    while gain and (best := max(gain)) > never:
        i = gain.index(best)
        out[i : i + 2] = [out[i] + out[i + 1]]
        del gain[i]
        if i < len(gain):
            gain[i] = score.get(out[i] + out[i + 1], never)
        if i:
            gain[i - 1] = score.get(out[i - 1] + out[i], never)
    return out


class Units(dict):
    """Ids of a unit of text, encoded when first asked for."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.older.get(unit) or self.encode(unit)
        if len(unit) <= LONG:
            if len(self) >= UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class PrefixTable:
    """Encoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, rules = sentencepiece_model_pb2.ModelProto.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: not a byte-pair model with an identity normaliser")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: user-defined or unused pieces")
        self.prefix = SPACE * rules.add_dummy_prefix
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.bytes = [self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.unknown = self.processor.unk_id()
        self.pieces = [p.piece for p in model.pieces]
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        joined = [p for p in self.ids if len(p) > 1]
        joining = {c for p in joined for c in p}
        # a character that only longer pieces hold merges like any other; alone it is spelt
        self.known = len(self.pieces)
        self.pieces += sorted(joining - self.ids.keys())
        for piece, i in chain(self.ids.items(), ((c, self.known + i) for i, c in enumerate(self.pieces[self.known :]))):
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        word = "".join(map(re.escape, sorted(joining - {SPACE})))
        inner = any(SPACE in p.lstrip(SPACE) for p in joined)
        self.cut = re.compile(f"[{word}{SPACE}]+|." if inner else f"{SPACE}+[{word}]*|[{word}]+|.", re.DOTALL) if word else re.compile(".", re.DOTALL)
        self.units = Units(self._unit)

    def _test(self, before: int, piece: int) -> bool:
        """Whether merging leaves the two pieces apart and whole; before -1: at the start."""
        pair = [*([self.pieces[before]] if before >= 0 else []), self.pieces[piece]]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        known = self.compatible[before * len(self.pieces) + piece] = merged("".join(pair), self.score) == pair
        return known

    def _unit(self, unit: str) -> tuple[int, ...]:
        if len(unit) == 1:
            i = self.ids.get(unit)
            return self._spelt(unit) if i is None else (i,)
        if (whole := self.ids.get(unit)) is not None and self._test(-1, whole):
            return (whole,)
        last, size, settled, known, many = [-1] * (len(unit) + 1), [0] * (len(unit) + 1), 0, self.compatible.get, len(self.pieces)
        for at, (piece, n) in self.automaton.iter(unit):
            # longest first; a prefix once settled has no other last piece
            if at >= settled:
                before = last[at + 1 - n]
                fits = known(before * many + piece)
                if self._test(before, piece) if fits is None else fits:
                    settled = at + 1
                    last[settled], size[settled] = piece, n
        out, end = [], len(unit)
        while end:
            piece = last[end]
            out += (piece,) if piece < self.known else reversed(self._spelt(self.pieces[piece]))
            end -= size[end]
        return tuple(reversed(out))

    def _spelt(self, character: str) -> tuple[int, ...]:
        """Ids of a character that is no piece."""
        return tuple(self.bytes[b] for b in character.encode()) if self.bytes else (self.unknown,)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        found = self.cut.findall(self.prefix + text.replace(" ", SPACE))
        ids = list(chain.from_iterable(map(self.units.__getitem__, found)))
        if self.bytes is None:
            ids = [x for x, before in zip(ids, [None, *ids], strict=False) if x != self.unknown or before != x]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The library's decoding."""
        return self.processor.decode(ids)


_TABLES: dict[str, PrefixTable] = {}


def _table(path: str) -> PrefixTable:
    """One table a Python worker, kept from task to task."""
    if path not in _TABLES:
        _TABLES[path] = PrefixTable(path)
    return _TABLES[path]


def _mapped(docs: DataFrame, source: Column, added: dict[str, str], make: Callable[[PrefixTable, pa.Array], list[pa.Array]], path: str | None) -> DataFrame:
    """docs with the added columns (name: type) that make gives for a batch of the source column; columns of those names are replaced."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *make(_table(path), batch.column(0))], names=[*(f"_c{i}" for i in range(batch.num_columns - 1)), *(f"_a{i}" for i in range(len(added)))])

    fields = [f for f in docs.schema if f.name not in added]
    names = [f"_c{i}" for i in range(len(fields))]
    new = [f"_a{i}" for i in range(len(added))]
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True)), *(f"{n} {t}" for n, t in zip(new, added.values(), strict=True))])
    rows = docs.select(source.alias("_source"), *(F.col(f"`{f.name}`").alias(n) for n, f in zip(names, fields, strict=True)))
    return rows.mapInArrow(run, schema).toDF(*(f.name for f in fields), *added)


def _lists(rows: Iterable[list[int]]) -> pa.Array:
    """Lists of ids as one flat array and its offsets; no list is kept once it is copied."""
    flat, ends = array("i"), [0]
    for ids in rows:
        flat.fromlist(ids)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()) if not flat else pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))


def _encoded(table: PrefixTable, texts: pa.Array) -> pa.Array:
    return _lists(table.encode(t.as_py()) for t in texts)


def _decoded(table: PrefixTable, ids: pa.Array) -> pa.Array:
    return pa.array([table.decode(x.values.to_pylist()) if x.is_valid else "" for x in ids], pa.string())


def _both(table: PrefixTable, texts: pa.Array) -> list[pa.Array]:
    """Ids of texts and their decoding, from the encoder's own lists: ids do not go to Arrow and back in between."""
    decoded: list[str] = []

    def rows() -> Iterator[list[int]]:
        for text in texts:
            ids = table.encode(text.as_py())
            decoded.append(table.decode(ids))
            yield ids

    return [_lists(rows()), pa.array(decoded, pa.string())]


def encode(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """docs and the ids of their text."""
    return _mapped(docs, F.col(text).cast("string"), {into: "array<int>"}, lambda table, x: [_encoded(table, x)], path)


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """docs and the text of their ids; null ids are none."""
    return _mapped(docs, F.col(ids).cast("array<int>"), {into: "string"}, lambda table, x: [_decoded(table, x)], path)


def round_trip(docs: DataFrame, text: str = "text", into: tuple[str, str] = ("ids", "decoded"), path: str | None = None) -> DataFrame:
    """docs, the ids of their text and the text of these ids, in one pass."""
    return _mapped(docs, F.col(text).cast("string"), dict(zip(into, ("array<int>", "string"), strict=True)), _both, path)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    coded = round_trip(docs.select("doc_id", "text"), path=path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
