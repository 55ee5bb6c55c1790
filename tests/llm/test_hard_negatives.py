import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import hard_negatives as h
from tidemark.llm.sql import SQL

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, step=100):
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for r in sorted(rows, key=lambda r: (*r[:2], np.array(r[2], "<i4").tobytes())):
        first.setdefault(r[0], r)
    out = []
    for a, (_, y, v) in first.items():
        if a % step:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, z, w in rows)
        near = [(i, -s) for s, i, z in scored if z == y and i != a][:5]
        for p, ps in near:
            far = [(i, -s) for s, i, z in scored if z != y and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(a, p, k, i, ps, s) for k, (i, s) in enumerate(far, 1)]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, h.mine(df.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0, **more).collect()))


def made(n, seed, step=1, width=6, near=True):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(4, width))
    x = (centres[g.integers(0, 4, n)] + 0.3 * g.normal(size=(n, width))).astype(np.float32)
    x[g.random(n) < 0.3] = x[0]  # a third are copies: ties
    return [(i * step, x[i].tolist(), int(g.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs_at_any_index(spark, seed, monkeypatch):
    rows = made(900, seed, 10)
    want = plain(rows)
    assert len(want) > 500
    assert got(spark, rows) == want
    # many small lists, blocks and batches, a sample of a tenth, one first visit
    monkeypatch.setattr(h, "LIST_ROWS", 40)
    monkeypatch.setattr(h, "BLOCK_ROWS", 16)
    monkeypatch.setattr(h, "ANCHORS", 3)
    monkeypatch.setattr(h, "LABELS", 2)
    assert got(spark, rows, sample=90, lists=12, first=1) == want


def test_lists_are_skipped_and_nothing_is_lost(spark):
    g = np.random.default_rng(4)
    centres = 8 * np.eye(8)
    rows = [(i, (centres[i % 8] + 0.05 * g.normal(size=8)).astype(np.float32).tolist(), i % 8 // 2) for i in range(800)]
    df = h.whole_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding", 256)
    blocks, told = h.indexed(df, h.centroids_of(h.sampled(df, 800), 8, 8))
    assert sum(len(b.ids) // 8 for b in blocks.collect()) == 800
    x = h.vectors(df.select("x").toArrow().column("x").combine_chunks())
    upper, lower = told.bounds(x[:50])
    at, _ = h.nearest(x, told.centroids)
    score = x[:50] @ x.T
    assert all((score[:, at == i] <= upper[:, [i]]).all() and (score[:, at == i] >= lower[:, [i]]).all() for i in range(8) if (at == i).any())
    assert h._visits(upper, told.holds(np.array([r[2] for r in rows[:50]]), True), None, 8).mean() < 0.6
    assert got(spark, rows) == plain(rows)


def test_nulls_infinities_repeats_and_negative_scores(spark):
    rows = made(120, 5, 5)
    rows += rows[:30] + [(100, [9.0] * 6, 1), (900, None, 1), (901, [1.0] * 6, None), (None, [1.0] * 6, 1), (902, [None] + [1.0] * 5, 1), (903, [float("nan")] * 6, 1), (904, [float("inf")] * 6, 2), (1000, [-5.0] * 6, 4), (1001, [5.0] * 6, 4), (1100, [0.0] * 6, 5), (1101, [0.0] * 6, 5)]
    assert got(spark, rows) == plain(rows)


def test_few_rows_and_empty_tables(spark):
    assert got(spark, []) == [] == got(spark, [(100, None, 1)])
    assert got(spark, [(100, [1.0] * 4, 1)]) == []
    rows = [(100, [1.0] * 4, 1), (101, [1.0] * 4, 1), (102, [0.5] * 4, 2), (103, [1.0] * 5, 2)]
    assert got(spark, rows) == [(100, 101, 1, 102, 262144, 131072)]
    with pytest.raises(Exception, match="2.50"):
        got(spark, [(100, [1e7] * 4, 1), (101, [1e7] * 4, 1)])


def test_extra_columns_are_ignored(spark):
    rows = made(200, 6, 10)
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", id int, x string, score double")
    assert sorted(map(tuple, h.digest(df).collect())) == plain(rows)


def test_best_breaks_ties_by_place():
    scores = np.array([[5, 7, 7, 7, 1, 9]])
    row, column = h.best(scores, np.array([[True] * 5 + [False]]), 2)
    assert sorted(column.tolist()) == [1, 2] and row.tolist() == [0, 0]


def test_sql_equals_the_operator(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    assert sorted(map(tuple, h.digest(spark.read.parquet(f"{path}/embeddings.parquet")).collect())) == sorted(con.sql(SQL["op13_hard_negatives"]).fetchall())
