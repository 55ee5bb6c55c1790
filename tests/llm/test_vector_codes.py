import hashlib
import math

import duckdb
import numpy as np
import pytest
from tidemark.llm import vector_codes as v
from tidemark.llm.sql import SQL

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """The contract, row by row, in Python's own whole numbers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    cut = [[[math.floor(1024 * float(np.float32(x))) for x in r[1]][p * len(r[1]) // 4 : (p + 1) * len(r[1]) // 4] for p in range(4)] for r in rows]
    first = {}
    for r, c in sorted(zip(rows, cut, strict=True), key=lambda x: (x[0][0], x[1])):
        first.setdefault(r[0], c)
    books = [[c[p] for c in list(first.values())[:256]] for p in range(4)]

    def at(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p, book in enumerate(books):
            own = {}
            for c in cut:
                own.setdefault(at(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(x) // len(own[i]) for x in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[at(c[p], books[p]) for p in range(4)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(rows, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted([(r[0], "".join(f"{i:02x}" for _, i in f), e, by[r[2]], sha) for r, f, e in zip(rows, found, error, strict=True)], key=str)


def digest(spark, rows, parts=3):
    return sorted(map(tuple, v.digest(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()), key=str)


def made(n, seed=0, width=8, same=0.3):
    g = np.random.default_rng(seed)
    x = np.where(g.random((n, 1)) < same, np.float32([0.5] * width), g.normal(size=(n, width)).astype(np.float32))
    return [(i, x[i].tolist(), None if i % 11 == 0 else int(g.integers(0, 3))) for i in range(n)]


def test_equals_plain_python_on_more_and_fewer_rows_than_entries(spark):
    for n in (1, 7, 300):
        assert digest(spark, made(n)) == plain(made(n))


def test_null_and_infinite_vectors_ties_repeats_and_partitions(spark):
    rows = made(40) + made(40)[:20] + [(90, None, 1), (91, [1.0, None] * 4, 1), (92, [float("nan")] * 8, 1), (93, [float("-inf")] + [0.0] * 7, None), (94, [-0.0] * 8, None), (95, [-1e-9] * 8, None)]
    assert digest(spark, rows, 1) == digest(spark, rows, 8) == plain(rows)


def test_empty_table_null_ids_other_lengths_and_refusals(spark):
    assert digest(spark, []) == digest(spark, [(1, None, 2)]) == []
    assert [r[0] for r in digest(spark, [(None, [1.0] * 4, 1), (3, [2.0] * 4, 1), (4, [2.0] * 8, 1)])] == [3, None]
    assert digest(spark, [(None, [1.0] * 4, 1)])[0][:3] == (None, "00000000", 0)
    with pytest.raises(ValueError, match="equal parts"):
        digest(spark, [(1, [1.0] * 6, 1)])
    with pytest.raises(Exception, match="64 bits|whole number"):
        digest(spark, [(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1)])


def test_extra_columns_are_ignored_and_general_interface(spark):
    rows = [(*r, "x", i) for i, r in enumerate(made(30))]
    df = spark.createDataFrame(rows, SCHEMA + ", codes string, error long")
    assert sorted(map(tuple, v.digest(df).collect()), key=str) == plain(made(30))
    coded, books = v.compress(df, parts=2, entries=4, rounds=1)
    assert books.shape == (2, 4, 4) and all(len(r.codes) == 2 and max(r.codes) < 4 for r in coded.collect())


def test_hot_label_and_many_labels_have_their_sums(spark):
    rows = [(i, [float(i % 5)] * 4, 7 if i % 3 == 0 else i) for i in range(3000)]
    got = {r[0]: (r[2], r[3]) for r in digest(spark, rows)}
    hot = sum(got[i][0] for i in range(3000) if i % 3 == 0 or i == 7)
    assert all(got[i][1] == (hot if i % 3 == 0 or i == 7 else got[i][0]) for i in range(3000))


def test_blocks_are_columnar_and_wide_values_use_64_bits():
    x = np.arange(24).reshape(3, 8)
    assert v.columnar(x, 4)[2].tolist() == [[4, 12, 20], [5, 13, 21]]
    far, book = np.array([[10**8], [-(10**8)]]), np.array([[0, 0], [10**8, -(10**8)], [10**8, -(10**8)]])
    assert [a.tolist() for a in v.nearest(far, book)] == [[1], [0]]


def test_sql_equals_the_operator(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    want = con.sql(SQL["op11_vector_codes"]).fetchall()
    assert sorted(map(tuple, v.digest(spark.read.parquet(f"{path}/embeddings.parquet")).collect())) == sorted(want)
