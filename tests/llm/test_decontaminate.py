import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from tidemark.llm import decontaminate as d


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        x = words(t)
        n = min(10, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def case(seed):
    rng = random.Random(seed)
    vocab = ["the", "Of", "a1", "é", "x-y", "b.", "zz", "q"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 40]))) for i in range(30) if i % 5] + [(100, None), (101, "..."), (102, "the the the the the the the the the the the")]
    items = [x for x in items if len(words(x[1])) not in (1, 2, 3) or x[0] < 3]
    docs = [(i, say(rng.randint(0, 120))) for i in range(40)] + [(50, None), (51, ""), (52, "the " * 300), (53, items[3][1]), (54, f"{items[4][1]} extra {items[5][1]}")]
    return docs + [docs[3]], items


@pytest.mark.parametrize(("seed", "block"), [(1, d.BLOCK_WORDS), (2, d.BLOCK_WORDS), (3, 40)])
def test_matches_brute_force(spark, seed, block):
    docs, items = case(seed)
    text = dict(docs)
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.digest(d.find_contamination(df, bench, block)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == brute(text[r.doc_id], items), text[r.doc_id]
    kept = d.remove_contaminated(df, bench, block)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in docs if not brute(t, items)[4])


def test_the_index_of_a_full_block_is_small_and_quick():
    rng = random.Random(0)
    items = [(str(i), " ".join(f"w{rng.randrange(50_000)}" for _ in range(100))) for i in range(d.BLOCK_WORDS // 100)]
    tracemalloc.start()
    began = time.process_time()
    index = d.Index(items)
    took, (held, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 60 and held < 80e6 and peak < 500e6, (took, held, peak)
    hit = d._scan([f"x y {items[7][1]} z"], index, d._Known(index.vocab))
    assert next(iter(hit)) == (103, [(2, 102)], ["7"])


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50, 400), rng.integers(50, 99, 400)
    for at in range(0, 300, 7):
        b2 = b.copy()
        b2[at : at + d.SPAN] = a[at : at + d.SPAN]
        fp = [{int(h[i]) for i in d.winnow(h, d.SPAN - d.K + 1)} for h in (d.rolling(a, d.K), d.rolling(b2, d.K))]
        assert fp[0] & fp[1]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.digest(d.find_contamination(docs, bench)).first().contaminated is False
    assert d.find_contamination(docs.limit(0), bench).count() == 0 and d.remove_contaminated(docs, bench).count() == 1
