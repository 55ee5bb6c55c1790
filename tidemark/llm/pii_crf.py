"""Personal data (operator 4): base patterns plus a linear-chain conditional random field over word-shape features.

Base spans come from fixed patterns and are never lost. The field adds spans the patterns miss (card-like numbers that fail
the check digit, phone numbers without a country code): it is trained on the driver from a small labelled table of
sentences, made by rule, and decoded by Viterbi in numpy batches. A span of the field that overlaps a base span is dropped.

The field reads the whole text: every token has its features (shapes of it and two neighbours on each side, and the gaps between
them, packed in one integer) and emissions. Where a token outside all spans leads any other label by more than transitions and
its neighbour could make up, every best path passes through it, so Viterbi need only decode the tokens between such ones
(``open_parts``); the labels are those of decoding the text as one sequence.

Defined results: a null text is empty and has no spans; repeated rows get equal results; an empty table gives no rows; extra
columns are ignored (``mask_documents`` keeps them). Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: O, then begin and inside of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, in time linear in the text: each at-sign with the run of local characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        free = m.end() if m else at + 1
        if m:
            yield 0, begin, m.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out = list(emails(text))
    if _DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


#: Classes of code points: white space, letters (runs are tokens), 0-9 (runs are tokens), any other sign (a token each).
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
#: Shapes: letters by case, digits by their number (up to 5, 11, 15, 16, 19, more), another sign, the text's end; ASCII signs are _ASCII and their code.
_LOWER, _UPPER, _MIXED, _DIGITS1, _OTHER, _END, _ASCII = 0, 1, 2, 3, 13, 14, 16
_DIGIT_STEPS = np.array([1, 2, 3, 4, 5, 11, 15, 16, 19])


@lru_cache(maxsize=1)
def _points() -> tuple[np.ndarray, np.ndarray]:
    """Class, and case flags (1 lower, 2 upper or title), of every code point."""
    kind, case = np.full(0x110000, _SIGN, dtype=np.uint8), np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            kind[i] = _SPACE
        elif "0" <= c <= "9":
            kind[i] = _DIGIT
        elif c.isalnum() and not c.isdecimal():
            kind[i] = _LETTER
            case[i] = c.islower() + 2 * (c.isupper() or c.istitle())
    return kind, case


@dataclass
class Tokens:
    """Tokens of several texts: their places in the text, their context keys, and where each text's tokens begin."""

    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    first: np.ndarray


#: A context key, from its high bits: two shapes before, each with the gap after it, the token's shape, two after with the gap before each.
_WIDTH = 8
_S2L, _G2L, _S1L, _G1L, _S0, _G1R, _S1R, _G2R, _S2R = 36, 35, 27, 26, 18, 17, 9, 8, 0


def _mask(*fields: int) -> int:
    return sum((1 if f in (_G2L, _G1L, _G1R, _G2R) else 255) << f for f in fields)


#: Fields of the features: none, the shape, a neighbour, pairs, triples.
FEATURES = np.array([_mask(*f) for f in ((), (_S0,), (_S1L, _G1L), (_G1R, _S1R), (_S1L, _G1L, _S0), (_S0, _G1R, _S1R), (_S2L, _G2L, _S1L, _G1L, _S0), (_S0, _G1R, _S1R, _G2R, _S2R), (_S1L, _G1L, _S0, _G1R, _S1R))], dtype=np.int64)
_NUMBER = np.arange(len(FEATURES), dtype=np.int64) << 44


def tokens_of(texts: Sequence[str]) -> Tokens:
    kind_of, case_of = _points()
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    # a space after each text parts their tokens
    flat = np.frombuffer("".join(f"{t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kind_of[flat]
    new = np.ones(len(kind), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _SIGN)
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(kind))
    real = kind[at] != _SPACE
    case = np.bitwise_or.reduceat(case_of[flat], at) if len(at) else np.zeros(0, np.uint8)
    at, stop, case = at[real], stop[real], case[real]
    head, sign = kind[at], flat[at]
    shape = np.where(case == 1, _LOWER, np.where(case == 2, _UPPER, _MIXED)).astype(np.int64)
    shape = np.where(head == _DIGIT, _DIGITS1 + np.searchsorted(_DIGIT_STEPS, stop - at), shape)
    shape = np.where(head == _SIGN, np.where(sign < 128, _ASCII + sign.astype(np.int64), _OTHER), shape)
    owner = np.searchsorted(begin, at, "right") - 1
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    # two ends stand between texts, so that neighbours are plain shifts
    place = np.arange(len(at)) + 2 * (owner + 1)
    s = np.full(len(at) + 2 * (len(texts) + 1), _END, dtype=np.int64)
    gap = np.ones(len(s) + 1, dtype=np.int64)  # before each place
    s[place] = shape
    same = np.flatnonzero((owner[1:] == owner[:-1]) & (at[1:] == stop[:-1])) + 1
    gap[place[same]] = 0
    key = (s[place - 2] << _S2L) | (gap[place - 1] << _G2L) | (s[place - 1] << _S1L) | (gap[place] << _G1L) | (shape << _S0)
    key |= (gap[place + 1] << _G1R) | (s[place + 1] << _S1R) | (gap[place + 2] << _G2R) | s[place + 2]
    return Tokens(at - begin[owner], stop - begin[owner], key, first)


def features_of(key: np.ndarray) -> np.ndarray:
    """Features of each context, as integers: the feature's number and the fields it looks at."""
    return (key[:, None] & FEATURES) | _NUMBER


def labelled_sentences(n: int = 300, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """The training table, made by rule: plain words, personal data, and look-alikes that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghinorstuéü") for _ in range(rng.randint(1, 9)))
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    email = lambda: f"{word()}{rng.choice(['.', '_', '', '-', '+'])}{rng.choice([d(2), word(), ''])}@{rng.choice([word(), f'{word()}{d(1)}', f'{word()}-{word()}'])}{rng.choice(['', '.' + word()])}.{rng.choice(['com', 'org', 'net', 'de'])}"
    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    card = lambda: rng.choice([d(16), d(16), d(16), " ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4)), d(19)])
    phone = lambda: rng.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)}-{d(3)}-{d(7)}"])
    none = lambda: rng.choice([f"20{d(2)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}", d(rng.randint(1, 8)), f"{d(2)}:{d(2)}", f"${d(3)}.{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f'"{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"@{word()}", f"{word()}{d(2)}", f"({d(4)})", f"{d(3)}-{d(3)}", d(10), d(13), f"{d(1)},{d(3)},{d(3)}", d(rng.randint(22, 40))])
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 14)):
            u = rng.random()
            kind = rng.randrange(4) if u < 0.3 else None
            part = (email, ip, card, phone)[kind]() if kind is not None else none() if u < 0.5 else rng.choice([str.lower, str.upper, str.title])(word()) + rng.choice(["", "", "", ",", ".", "%%%", "!!", " |", ":"])
            text += rng.choice([" ", " ", " ", "\n"]) if text else ""
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part + (rng.choice(["", "", "", "!!", "###", ".", ","]) if u < 0.5 else "")
        rows.append((text, spans))
    return rows


@dataclass
class Crf:
    """vocabulary: sorted features; weights: a row each and a last one, zero, for unknown features."""

    vocabulary: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, key: np.ndarray) -> np.ndarray:
        f = features_of(key)
        at = np.searchsorted(self.vocabulary, f)
        at[at == len(self.vocabulary)] = 0
        at[self.vocabulary[at] != f] = len(self.weights) - 1
        return self.weights[at].sum(axis=1)


#: A label may follow O, or any; an inside label only its own kind.
_ALLOWED = np.array([[b[0] != "I" or a[1:] == b[1:] for b in LABELS] for a in LABELS])
_FIRST = np.array([x[0] != "I" for x in LABELS])
_NO = -1e4


def _pad(parts: Sequence[np.ndarray], fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts])
    out = np.full((len(parts), size.max(), *parts[0].shape[1:]), fill, dtype=parts[0].dtype)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out, size


def train(table: Sequence[tuple[str, list[Span]]], epochs: int = 40, rate: float = 0.6, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by Adagrad over the whole table; forward and backward run over all sentences at once."""
    feats, gold = [], []
    tokens = tokens_of([text for text, _ in table])
    for i, (_, spans) in enumerate(table):
        own = slice(tokens.first[i], tokens.first[i + 1])
        feats.append(features_of(tokens.key[own]))
        y = np.zeros(len(feats[-1]), dtype=np.int64)
        for k, a, b in spans:
            inside = np.flatnonzero((tokens.start[own] >= a) & (tokens.end[own] <= b))
            y[inside] = 2 * k + 2
            y[inside[:1]] = 2 * k + 1
        gold.append(y)
    names = np.unique(np.concatenate(feats))
    ids, size = _pad([np.searchsorted(names, f) for f in feats], len(names))
    y, _ = _pad(gold)
    n, steps, L = len(size), ids.shape[1], len(LABELS)
    real = np.arange(steps)[None, :] < size[:, None]
    w, moves = np.zeros((len(names) + 1, L)), np.zeros((L, L))
    gw, gm = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    one = np.eye(L)[y] * real[:, :, None]
    block, start = np.where(_ALLOWED, 0.0, _NO), np.where(_FIRST, 0.0, _NO)
    soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    pairs_gold = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
    for _ in range(epochs):
        e = w[ids].sum(axis=2)
        t = moves + block
        alpha, beta = np.zeros((n, steps, L)), np.zeros((n, steps, L))
        alpha[:, 0] = e[:, 0] + start
        for i in range(1, steps):
            alpha[:, i] = np.where(real[:, i, None], soft(alpha[:, i - 1, :, None] + t, 1) + e[:, i], alpha[:, i - 1])
        for i in range(steps - 2, -1, -1):
            beta[:, i] = np.where(real[:, i + 1, None], soft(t[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
        z = soft(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        d = ((one - p) / n).reshape(-1, L)
        flat = np.repeat(d, ids.shape[2], axis=0)
        grad = np.stack([np.bincount(ids.ravel(), flat[:, k], len(w)) for k in range(L)], axis=1)
        grad -= l2 * w / n * 10
        move = (pairs_gold - pair.sum(axis=(0, 1))) / n
        gw += grad**2
        gm += move**2
        w += rate * grad / np.sqrt(gw)
        moves += rate * move / np.sqrt(gm)
        w[-1] = 0
    return Crf(names, w, moves)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    """The field of the rule-made table, fitted once a session."""
    return train(labelled_sentences())


def viterbi(model: Crf, parts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Best label sequences of parts (emissions by token), in padded batches of like lengths."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
    order = sorted((i for i in range(len(parts)) if len(parts[i])), key=lambda i: len(parts[i]))
    t = np.where(_ALLOWED, model.moves, _NO)
    at = 0
    while at < len(order):
        # at most about a million tokens with padding
        n = max(1, min(4096, (1 << 20) // len(parts[order[min(at + 4095, len(order) - 1)]])))
        some = order[at : at + n]
        at += n
        e, size = _pad([parts[i] for i in some])
        steps = e.shape[1]
        back = np.zeros((len(some), steps, len(LABELS)), dtype=np.int8)
        best = e[:, 0] + np.where(_FIRST, 0.0, _NO)
        for i in range(1, steps):
            go = best[:, :, None] + t
            back[:, i] = go.argmax(axis=1)
            best = np.where((i < size)[:, None], go.max(axis=1) + e[:, i], best)
        last = best.argmax(axis=1)
        path = np.zeros((len(some), steps), dtype=np.int64)
        rows = np.arange(len(some))
        for i in range(steps - 1, -1, -1):
            path[:, i] = last
            last = np.where(i < size, back[rows, i, last], last)
        for k, i in enumerate(some):
            out[i] = path[k, : size[k]]
    return out


def open_parts(model: Crf, tokens: Tokens) -> list[tuple[int, np.ndarray]]:
    """(first token, emissions) of the runs of tokens that may belong to a span, each with the O before and after it, in the text's bounds.

    Where a path has another label at a token, O can stand there instead, if what is left of the span after it is mended: its next token
    begins a span (B for I), or is O as well and the one after it is mended. ``mend`` bounds what that may cost; each transition that
    changes costs ``step`` at most. A token whose lead exceeds the bound is O on every best path.
    """
    allowed = model.moves[_ALLOWED]
    step = float(allowed.max() - allowed.min()) + 1e-6
    kinds, of = np.unique(tokens.key, return_inverse=True)
    e = model.emissions(kinds)
    lead = (e[:, 0] - e[:, 1:].max(axis=1))[of]
    ends, starts = (e[:, 0] - e[:, 2::2].max(axis=1))[of], (e[:, 2::2] - e[:, 1::2]).max(axis=1)[of]
    n = len(of)
    edge = np.zeros(n + 1, dtype=bool)
    edge[tokens.first] = True
    mend = np.zeros(n + 1)
    for depth in range(6):
        cost = starts + step if not depth else np.minimum(starts + step, step - ends + mend[1:])
        mend = np.append(np.maximum(0.0, cost), 0.0)
        mend[edge] = 0.0  # seen from the token before it, no span goes on past its text
    loose = lead - 2 * step <= mend[1:]
    # runs of loose tokens, parted at text edges
    begin = np.flatnonzero(loose & (edge[:-1] | ~np.append(False, loose[:-1])))
    stop = np.flatnonzero(loose & (edge[1:] | ~np.append(loose[1:], False))) + 1
    a, b = np.where(edge[begin], begin, begin - 1), np.where(edge[stop], stop, stop + 1)
    out = []
    for x, y, left, right in zip(a.tolist(), b.tolist(), (a < begin).tolist(), (b > stop).tolist(), strict=True):
        part = e[of[x:y]]
        if left:
            part[0, 1:] = -1e6
        if right:
            part[-1, 1:] = -1e6
        out.append((x, part))
    return out


def _spans(labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Kind, first and end token of each run of labels."""
    i = 0
    while i < len(labels):
        if labels[i]:
            k, j = (labels[i] - 1) // 2, i + 1
            while j < len(labels) and labels[j] == 2 * k + 2:
                j += 1
            yield int(k), i, j
            i = j
        else:
            i += 1


def field_spans(texts: Sequence[str], model: Crf) -> list[list[Span]]:
    """Spans of the field in each text, decoded whole."""
    tokens = tokens_of(texts)
    parts = open_parts(model, tokens)
    out: list[list[Span]] = [[] for _ in texts]
    for (x, _), labels in zip(parts, viterbi(model, [p for _, p in parts]), strict=True):
        if labels.any():
            owner = int(np.searchsorted(tokens.first, x, "right")) - 1
            out[owner] += [(k, int(tokens.start[x + i]), int(tokens.end[x + j - 1])) for k, i, j in _spans(labels)]
    return out


def plausible(kind: int, text: str) -> bool:
    """What any span of the field must hold: enough digits for its kind, the dots of an ip, an at-sign for an address."""
    digits = len(_DIGITS.findall(text))
    return (kind == 0 and "@" in text and "." in text) or (kind == 1 and digits >= 4 and text.count(".") == 3) or (kind == 2 and 13 <= digits <= 19) or (kind == 3 and 7 <= digits <= 15)


def find_spans(texts: Sequence[str | None], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    added = [[s for s in own if plausible(s[0], t[s[1] : s[2]])] for t, own in zip(whole, field_spans(whole, model), strict=True)]
    out = []
    for b, a in zip(base, added, strict=True):
        taken: list[list[int]] = []  # the base spans' union
        for _, x, y in sorted(b, key=lambda v: v[1]):
            if taken and x < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], y)
            else:
                taken.append([x, y])
        free = []
        for v in a:
            k = bisect_left(taken, v[2], key=lambda t: t[0]) - 1  # the last that begins before the span's end
            if k < 0 or taken[k][1] <= v[1]:
                free.append(v)
        out.append((b, free))
    return out


def _say(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _ranges(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about that many bytes, so that a batch's tokens stay few."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t.as_buffer()) if t.is_valid else 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def find(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id and found: kind, start, end, base (whether a pattern found it), by kind, then start."""
    crf = model or default_model()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _ranges(batch.column(1)):
                rows = []
                for base, added in find_spans(batch.column(1)[a:b].to_pylist(), crf):
                    rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": f} for k, s, e, f in sorted([(*x, True) for x in base] + [(*x, False) for x in added])])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(rows, kind)], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their SHA-256, and all spans as text."""
    said = lambda c: F.expr(f"array_join(transform({c}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
    f = found.withColumn("b", F.expr("filter(found, x -> x.base)"))
    counts = [F.expr(f"cast(size(filter(b, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return f.select("doc_id", *counts, F.sha2(said("b"), 256).alias("base_sha256"), said("found").alias("spans"))


def mask(text: str, spans: Sequence[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """The documents, all columns as they are but text, where personal data is masked; a null text stays null. n_chars, if there, is the new length."""
    crf = model or default_model()
    names = docs.columns
    i = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _ranges(batch.column(i)):
                texts = batch.column(i)[a:b].to_pylist()
                new = [t if t is None else mask(t, [*x, *y]) for t, (x, y) in zip(texts, find_spans(texts, crf), strict=True)]
                cols = [c[a:b] for c in batch.columns]
                cols[i] = pa.array(new, cols[i].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def sha(spans: Sequence[Span]) -> str:
    return hashlib.sha256(_say(spans).encode()).hexdigest()
