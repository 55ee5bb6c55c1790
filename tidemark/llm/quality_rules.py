"""Quality rules with risk-controlled cutoffs (operator 2), native.

Every text gets surface statistics. Each rule compares one statistic with a cutoff out of a list, mildest first. For each stratum
a cutoff is selected rule by rule on labelled holdouts: with the cutoffs selected so far in force, the rule's next stricter cutoff
is tested with the exact binomial tail P(Bin(n, alpha) <= k), n good holdout texts of which the rules together would reject k;
the first cutoff that fails ends the rule's list and the one before it is selected (none: the rule rejects nothing there).

Each list is a fixed sequence, but which lists are walked rests on the rules before, so p-values are Bonferroni-corrected over all
lists that a stratum might walk and over all strata. With probability 1 - delta no stratum rejects more than a share alpha of its good texts.

Defined results: null text counts as empty (0 words, base_failed); null lang falls in stratum "other"; a document with
several labels is good only if all of them are 1; repeated rows each get their own result; empty tables give empty
results; other columns are ignored by ``rule_columns`` and kept by ``filter_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_of

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STRATA = ("en", "de", "fr", "es")
ALPHA, DELTA = 0.05, 0.05
#: The rules in the order of selection, with their cutoffs, mildest first. A text above the cutoff is rejected.
CUTOFFS = {
    "symbol_ratio": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1),
    "bang_ratio": (0.9, 0.6, 0.5, 0.4, 0.3, 0.2),
    "upper_ratio": (0.9, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.95, 0.8, 0.7, 0.6, 0.55, 0.5),
}
RULES, LEVELS = len(CUTOFFS), len(CUTOFFS["symbol_ratio"])
#: Lists that one stratum might walk: the first rule's, the second's after each outcome of the first, and so on.
WALKS = sum((LEVELS + 1) ** r for r in range(RULES))
#: Labelled documents up to this many are sent to every task; beyond it they are joined.
BROADCAST_IDS = 1_000_000


def statistics(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs, n_upper of each text."""
    pre = "_qr_"
    t = docs.select(*keep, text_of().alias(f"{pre}t"))
    t = t.select(*keep, f"{pre}t", F.expr(f"array_remove(split({pre}t, r'{SPACE}'), '')").alias(f"{pre}w"))
    t = t.select(
        *keep,
        f"{pre}w",
        F.size(f"{pre}w").cast("long").alias("n_words"),
        F.length(F.array_join(f"{pre}w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(f"{pre}t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(f"{pre}t", "[^!]+", "")).cast("long").alias("n_bangs"),
        F.length(F.regexp_replace(f"{pre}t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.expr(rf"filter(split({pre}t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')").alias(f"{pre}l"),
        F.expr(
            f"case when size({pre}w) < 4 then cast(array() as array<bigint>) else "
            f"transform(slice({pre}w, 1, size({pre}w) - 2), (x, i) -> xxhash64(x, get({pre}w, i + 1), get({pre}w, i + 2))) end"
        ).alias(f"{pre}h"),
    )
    lines = [F.size(f"{pre}l").cast("long").alias("n_lines"), (F.size(f"{pre}l") - F.size(F.array_distinct(f"{pre}l"))).cast("long").alias("n_dup_lines")]
    # only texts with a repeated window are sorted by (hash, place); equal neighbours are the repeats
    t = t.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_bangs", "n_upper", *lines,
        F.expr(
            f"case when size(array_distinct({pre}h)) = size({pre}h) then cast(array() as array<struct<h:bigint,i:int>>) "
            f"else sort_array(transform({pre}h, (x, i) -> named_struct('h', x, 'i', i))) end"
        ).alias(f"{pre}s"),
    )
    return t.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(
            f"cast(case when size({pre}s) = 0 then 0 else size(array_distinct(flatten(transform("
            f"filter({pre}s, (x, j) -> coalesce(x.h = get({pre}s, j - 1).h, false) or coalesce(x.h = get({pre}s, j + 1).h, false)), "
            f"x -> array(x.i, x.i + 1, x.i + 2))))) end as bigint)"
        ).alias("n_repeat_words"),
        "n_lines", "n_bangs", "n_upper",
    )


def ratios() -> dict[str, Column]:
    per_word = lambda c: F.try_divide(F.col(c), F.col("n_words"))
    return {
        "symbol_ratio": per_word("n_symbols"),
        "bang_ratio": per_word("n_bangs"),
        "upper_ratio": F.try_divide(F.col("n_upper"), F.col("word_chars")),
        "repeat_ratio": per_word("n_repeat_words"),
    }


def strikes() -> list[Column]:
    """By rule, how many of its cutoffs the text is above: it is above the strictest ones."""
    return [sum((F.when(r > c, 1).otherwise(0) for c in CUTOFFS[k]), F.lit(0)) for k, r in ratios().items()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum(strata: Sequence[str] = STRATA) -> Column:
    return F.when(F.col("lang").isin(*strata), F.col("lang")).otherwise(F.lit("other"))


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    at = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(at(i)) for i in range(k + 1)))


def certify(good: Mapping[str, Mapping[tuple[int, ...], int]], strata: Sequence[str], alpha: float, delta: float) -> dict[str, tuple[int, ...]]:
    """By stratum and rule, how many cutoffs are certified. good: the good holdouts of a stratum, counted by their strikes."""
    each, out = delta / ((len(strata) + 1) * WALKS), {}
    for s, counts in good.items():
        n, chosen = sum(counts.values()), []
        for r in range(RULES):
            before = {x: any(x[j] > LEVELS - c for j, c in enumerate(chosen)) for x in counts}
            level = 0
            while level < LEVELS and n and tail(n, sum(v for x, v in counts.items() if before[x] or x[r] >= LEVELS - level), alpha) <= each:
                level += 1
            chosen.append(level)
        out[s] = tuple(chosen)
    return out


def cutoffs(stats: DataFrame, good: DataFrame, strata: Sequence[str] = STRATA, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, tuple[int, ...]]:
    """Certified cutoffs by stratum, from stats (doc_id, lang and statistics) and good ids. Base failures are not the method's to reject."""
    hold = stats.join(good, "doc_id", "left_semi").where(~base_failed()).select(stratum(strata).alias("s"), *[x.alias(f"x{i}") for i, x in enumerate(strikes())])
    # one row a stratum and combination of strikes: at most (strata + 1) * (LEVELS + 1) ** RULES rows
    counts: dict[str, dict[tuple[int, ...], int]] = {}
    for s, *x, n in hold.groupBy("s", *[f"x{i}" for i in range(RULES)]).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(s, {})[tuple(x)] = n
    return certify(counts, strata, alpha, delta)


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null").select("doc_id")


def _of_stratum(levels: Mapping[str, tuple[int, ...]], strata: Sequence[str], r: int) -> Column:
    level = F.lit(0)
    for s, n in levels.items():
        level = F.when(stratum(strata) == s, F.lit(n[r])).otherwise(level)
    return level


def verdict(levels: Mapping[str, tuple[int, ...]], strata: Sequence[str] = STRATA) -> Column:
    """kept: false if base_failed, else false if a certified cutoff of the stratum rejects the text."""
    kept = ~base_failed()
    for r, x in enumerate(strikes()):
        kept &= x <= LEVELS - _of_stratum(levels, strata, r)
    return kept


def rule_columns(docs: DataFrame, labels: DataFrame, strata: Sequence[str] = STRATA, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a document: doc_id, statistics, base_failed, kept and the certified cutoffs of its stratum, by rule."""
    stats = materialize(statistics(docs, ["doc_id", "lang"]))
    levels = cutoffs(stats, good_ids(labels), strata, alpha, delta)
    certified = F.array(*[_of_stratum(levels, strata, r) for r in range(RULES)])
    return stats.withColumns({"base_failed": base_failed(), "kept": verdict(levels, strata), "certified": certified})


def filter_documents(docs: DataFrame, labels: DataFrame, strata: Sequence[str] = STRATA, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents kept, with all their columns, whatever these are called."""
    good = materialize(good_ids(labels))
    few = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    holdouts = materialize(statistics(docs.select("doc_id", "lang", "text").join(few, "doc_id", "left_semi"), ["doc_id", "lang"]))
    levels = cutoffs(holdouts, few, strata, alpha, delta)
    discard(holdouts, good)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_qr_row"), "text", "lang")
    # an outer explode, as the optimizer would push a filter below the statistics and compute them once a mention
    judged = statistics(row, ["_qr_row", "lang"]).select(F.when(verdict(levels, strata), F.array("_qr_row")).alias("_qr_kept"))
    kept = judged.select(F.explode_outer("_qr_kept").alias("_qr_row")).where("_qr_row is not null")
    return kept.select([F.col("_qr_row").getField(c).alias(c) for c in names])
