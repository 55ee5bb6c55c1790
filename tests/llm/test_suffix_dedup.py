import random
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import suffix_dedup as s


def brute(rows, span):
    """Maximal runs of words in span-word windows that occur twice or more, of each distinct (doc_id, text)."""
    texts = [(d, t, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + span]) for _, _, w in texts for i in range(len(w) - span + 1))
    out = set()
    for d, _, w in texts:
        hit = sorted({j for i in range(len(w) - span + 1) if seen[tuple(w[i : i + span])] > 1 for j in range(i, i + span)})
        for j in hit:
            if j - 1 not in hit:
                end = j
                while end in hit:
                    end += 1
                out.add((d, j, end))
    return out


def corpus(seed, span):
    rng = random.Random(seed)
    say = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(n)]
    shared = [say(rng.randint(span - 3, span * 3)) for _ in range(6)]
    docs = []
    for i in range(40):
        parts = [say(rng.randint(0, span * 2)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            x = list(rng.choice(shared))
            if rng.random() < 0.4:
                x[rng.randrange(len(x))] = "changed"
            parts.insert(rng.randint(0, len(parts)), x)
        docs.append((i, " ".join(w for p in parts for w in p)))
    docs += [(100, docs[0][1]), (101, docs[1][1]), (1, docs[1][1]), (102, None), (103, ""), (104, "same " * (span * 4)), (105, " ".join(shared[0] + shared[1] + shared[0]))]
    near = docs[2][1].split()
    for i in range(25):
        x = list(near)
        if x:
            x[rng.randrange(len(x))] = f"new{i}"
        docs.append((200 + i, "\n".join(x)))
    return docs


@pytest.mark.parametrize(("seed", "span", "k"), [(1, 50, 16), (2, 12, 5), (3, 20, 20), (4, 50, 16)])
def test_matches_brute_force(spark, seed, span, k):
    rows = corpus(seed, span)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, h int")
    got = s.repeated_passages(docs, span, k).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == brute(rows, span)
    assert len(got) == len({tuple(r) for r in got}) and all(r.n_words == r.end - r.start >= span for r in got)


def test_rolling_and_minimisers():
    w = np.random.default_rng(0).integers(0, 9, 300).astype(np.uint64)
    for n in (1, 2, 3, 16, 50, 299, 300, 301):
        h = s.rolling(w, n)
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        assert len(h) == len(grams) and len(set(zip(h.tolist(), grams, strict=True))) == len(set(grams)) == len(set(h.tolist()))
    for n in (1, 2, 5, 35):
        at = s.minimisers(w, n)
        want = {max(j for j in range(i, i + n) if w[j] == w[i : i + n].min()) for i in range(len(w) - n + 1)}
        assert set(at.tolist()) == want


def test_hot_key_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    rows = [(7, i % 3, i, 0, 0) for i in range(500)] + [(8, 1, 1, 0, 0), (9, 1, 1, 0, 0), (9, 2, 2, 0, 0)]
    try:
        got = s.compare_neighbours(spark.createDataFrame(rows, s._KEY)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 502 and sum(r.whole for r in got) == 500 and sum(r.border for r in got) >= 5


def test_empty(spark):
    assert s.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
