"""URL filter (operator 10): rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table (``labelled_urls``, made by rule), and its weights,
2**bits floats, travel with the task. Urls are scored in Arrow batches: the n-grams of a batch are hashed with numpy.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the model
(no n-grams: the intercept alone; the training table holds such rows as allowed); repeated rows get equal verdicts; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, SIZES, CUT = 18, (3, 4, 5), 0.5
#: Fixed rules: verdict, host, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


#: Words of the rule-made training table.
_BAD = ("casino", "poker", "jackpot", "slots", "bet", "bonus", "viagra", "pharma", "pills", "meds", "diet", "loan", "payday", "credit", "cash", "crypto", "forex", "xxx", "porn", "adult", "escort", "hookup", "replica", "crack", "warez", "keygen", "torrent", "spam", "ads", "popup", "click", "track", "prize", "winner", "cheap", "free", "hot", "deal", "promo", "coupon")
_GOOD = ("library", "weather", "history", "garden", "science", "museum", "cooking", "travel", "school", "poetry", "news", "journal", "college", "hospital", "council", "archive", "nature", "physics", "theatre", "cinema", "orchestra", "bakery", "village", "harbour", "mountain", "railway", "chess", "painting", "language", "grammar", "forum", "wiki", "docs", "manual", "recipe", "local", "public", "open", "city", "old")
_TOPS = ("com", "org", "net", "info", "co.uk", "de", "example.com", "example.org", "example.net")
#: Letters of made-up names, as often as they come in English text.
_LETTERS = "eeeeeeeeeeeettttttttaaaaaaaaooooooooiiiiiiinnnnnnnsssssshhhhhhrrrrrrddddllllcccuuummmwwffggyyppbbvkjxqz"
_TAILS = ("", "/", ".html", "?page=2", "#top", "?id=7", "/index.php")


def labelled_urls(n: int = 4000, seed: int = 5) -> list[tuple[str, int]]:
    """The training table, 1 = block: hosts and paths of spam words, against plain words and plain made-up names of the same build."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(_LETTERS) for _ in range(rng.randint(4, 12)))
    rows = [("", 0), ("no scheme", 0), ("mailto:someone", 0)] * 20
    for i in range(n):
        bad = int(i % 3 == 0)
        words = _BAD if bad else _GOOD
        pick = lambda: rng.choice(words)
        shapes = [pick, lambda: f"{pick()}{rng.choice(('-', '', '-', '.'))}{pick()}", lambda: f"{pick()}{rng.choice(('-', ''))}{name()}", lambda: f"{name()}{rng.choice(('-', ''))}{pick()}"]
        host = rng.choice([*shapes, lambda: f"{pick()}{rng.randint(1, 99)}"] if bad else [*shapes, *[name] * 8])()
        path = rng.choice(("", f"/{rng.choice(('en', 'de', 'fr', 'es'))}/{rng.randint(1, 999)}", f"/{pick()}/{name()}", f"/{rng.randint(2000, 2025)}/{name()}-{pick()}"))
        rows.append((f"http{rng.choice(('', 's'))}://{rng.choice(('', '', 'www.', 'm.', 'blog.'))}{host}.{rng.choice(_TOPS)}{path}{rng.choice(_TAILS) if path else ''}", bad))
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without '://'."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:stop]


def grams(hosts: Sequence[str], paths: Sequence[str], bits: int = BITS, sizes: Iterable[int] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every character n-gram of '^host$' and '^path$'; host and path n-grams hash apart."""
    rows, cols = [], []
    for salt, texts in ((1, hosts), (2, paths)):
        full = [f"^{t}$" if t else "" for t in texts]
        n = np.array([len(t) for t in full], dtype=np.int64)
        flat = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        row, end = np.repeat(np.arange(len(full)), n), np.repeat(np.cumsum(n), n)
        for size in sizes:
            if len(flat) < size:
                continue
            h = np.full(len(flat) - size + 1, salt * 1000003 + size, dtype=np.uint64)
            for i in range(size):
                h = (h ^ flat[i : len(flat) - size + 1 + i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            ok = np.arange(len(h)) + size <= end[: len(h)]
            rows.append(row[: len(h)][ok])
            cols.append((h[ok] % np.uint64(1 << bits)).astype(np.int64))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (none, none)


def margins(rows: np.ndarray, cols: np.ndarray, n: int, w: np.ndarray, b: float) -> np.ndarray:
    """Linear score: mean weight of the n-grams by sqrt count, so that long urls don't saturate."""
    count = np.bincount(rows, minlength=n)
    return b + np.bincount(rows, weights=w[cols], minlength=n) / np.sqrt(np.maximum(count, 1))


def train(table: Sequence[tuple[str, int]], bits: int = BITS, epochs: int = 400, rate: float = 20.0, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression; deterministic."""
    parts = [split_url(u) for u, _ in table]
    y = np.array([v for _, v in table], dtype=float)
    rows, cols = grams([h for h, _ in parts], [p for _, p in parts], bits)
    n = len(y)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    weight = 1 / max(n, 1)
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(epochs):
        g = weight * (1 / (1 + np.exp(-margins(rows, cols, n, w, b))) - y)
        w -= rate * (np.bincount(cols, weights=(g * scale)[rows], minlength=1 << bits) + l2 * w)
        b -= rate * g.sum()
    return w.astype(np.float32), float(b)


@lru_cache(maxsize=1)
def default_model() -> tuple[np.ndarray, float]:
    """The model of the rule-made table, fitted once a session."""
    return train(labelled_urls())


def fit_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str] | None:
    """The longest rule that fits host (or a parent of it) and path, as (rule, verdict)."""
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else None


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, table: Sequence[tuple[str, int]] | None = None, cut: float = CUT) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's block probability of every row."""
    w, b = default_model() if table is None else train(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            p = 1 / (1 + np.exp(-margins(*grams(hosts, paths), len(parts), w, b)))
            hit = [fit_rule(h, q, rules) for h, q in parts]
            said = [f[1] if f else ("block" if x >= cut else "allow") for f, x in zip(hit, p, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([f and f[0] for f in hit], pa.string()), pa.array(said, pa.string()), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "p_block"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, p_block double")
