import random

import numpy as np
import pytest
from tidemark.llm import quality_gam as q


def test_features_of_odd_texts():
    for t in (None, "", " \n", "a", "é\n\né", "A!! " * 10**5, "%" * 10**5):
        f = q.features(t)
        assert len(f) == len(q.FEATURES) and all(np.isfinite(f))


def test_learns_additive_and_pairwise_effects():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 4))
    y = ((x[:, 0] > 0.5) ^ ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)
    m, plain = q.fit(x[:4000], y[:4000]), q.fit(x[:4000], y[:4000], pairs=0)
    right = lambda m: ((m.score(x[4000:]) > 0.5) == y[4000:]).mean()
    assert right(m) > 0.9 and right(m) > right(plain) + 0.02


def test_one_class_or_none():
    assert q.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == pytest.approx(0.5)
    assert q.fit(np.zeros((5, 2)), np.ones(5)).score(np.zeros((1, 2)))[0] > 0.99


def test_held_out_accuracy_and_rows(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "river", "Stone", "under,", "light."]) for _ in range(rng.randint(30, 200)))
    bad = lambda: " ".join(rng.choice(["x%%%", "y$$$", "z***"]) for _ in range(rng.randint(30, 200)))
    rows = [(i, good() if i % 3 else bad(), "s") for i in range(900)]
    docs = spark.createDataFrame([*rows, (5000, None, None), (5001, "", None), (1, rows[1][1], "t"), (None, "no id", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)] + [(9999, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = q.score_documents(docs, labels).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert {r.doc_id for r in held} == {i for i in range(900) if q.is_held_out(i)}
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.97
    assert q.score_documents(docs.limit(0), labels).count() == 0 and q.score_documents(docs, labels.limit(0)).first().score == pytest.approx(0.5)


def test_learning_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"{'a' * (i % 7)} b{i}") for i in range(200)], "doc_id long, text string")
    a = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - i % 2 if q.is_held_out(i) else i % 2) for i in range(200)], "doc_id long, quality int")
    assert sorted(map(tuple, q.score_documents(docs, a).collect())) == sorted(map(tuple, q.score_documents(docs, b).collect()))
