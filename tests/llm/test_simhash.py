import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.llm import simhash as s


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


@given(st.text(alphabet="aB é\t\n\x0b\x85", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert s.fingerprint(text) == plain(text)


def classes(fps, radius=3):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            label[i] = min(label[j] for j, b in enumerate(fps) if bin(a ^ b).count("1") <= radius)
    return label


def cloud(rng, n, centres, spread):
    out = set()
    mids = [rng.getrandbits(64) for _ in range(centres)]
    while len(out) < n:
        x = rng.choice(mids)
        for _ in range(rng.randint(0, spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bucket", [2, 8, 1024])
def test_links_connect_what_brute_force_connects(spark, bucket):
    fps = cloud(random.Random(bucket), 120, 5, 6)
    df = spark.createDataFrame([(1, s._signed(x)) for x in fps], "r long, fp long")
    at = {s._signed(x): i for i, x in enumerate(fps)}
    edges = [(at[r.a], at[r.b]) for r in s.links(df, bucket).collect()]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 3 for a, b in edges)
    got = {r.node: r.label for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == classes(fps)


def test_components_of_a_long_path(spark):
    n = 300
    got = s.components(spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")).collect()
    assert {(r.node, r.label) for r in got} == {(i, 0) for i in range(1, n + 1)}


def test_forest_is_bounded():
    x = np.arange(2048, dtype=np.uint64)
    assert len(s.forest(x)) == 2047


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 300))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        c = list(b)
        c[rng.randrange(len(c))] = "new"
        texts.append(" ".join(c))
    texts += [None, "", " \n", "A b", "a B", texts[0], texts[0]]
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts)] + [(ids[0], texts[0], 1), (None, "lonely words here", 1)], "doc_id long, text string, fp int")
    order = sorted(range(len(ids)), key=ids.__getitem__)
    label = classes([plain(texts[i]) for i in order])
    want = {ids[i]: ids[order[label[k]]] for k, i in enumerate(order)}
    got = s.near_duplicates(docs).select("doc_id", s.hex_of().alias("fingerprint"), "component_id").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.fingerprint == f"{plain(texts[ids.index(r.doc_id)]):016x}"


def test_a_text_without_doc_id_links_its_neighbours(spark, monkeypatch):
    fps = {"a": 0, "b": 7, "c": 63}  # b is within 3 bits of both, a and c are not of each other
    monkeypatch.setattr(s, "fingerprints", lambda docs: docs.selectExpr("doc_id", "cast(case text when 'b' then 7 when 'c' then 63 else 0 end as bigint) as fp"))
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.fp, r.component_id) for r in s.near_duplicates(docs).collect()} == {(1, fps["a"], 1), (None, fps["b"], 1), (2, fps["c"], 1)}
    alone = spark.createDataFrame([(None, "b"), (4, "zz")], "doc_id long, text string").withColumn("text", F.expr("case when doc_id = 4 then 'a' else text end"))
    assert {r.component_id for r in s.near_duplicates(alone).collect()} == {4}


def test_empty(spark):
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard(a, b):
    x, y = set(s.shingle_set(a, 5).tolist()), set(s.shingle_set(b, 5).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def near_corpus(rng):
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for g in range(12):
        base = say(rng.randint(60, 400))
        rows.append((g * 100 + 50, " ".join(base)))
        for i in range(rng.randint(0, 6)):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 100))):
                x[rng.randrange(len(x))] = f"n{rng.randrange(10**6)}"
            rows.append((g * 100 + rng.randrange(100), " ".join(x)))
    return rows


def test_similar_links_are_exact_and_found(spark):
    rows = [(i, t) for i, (_, t) in enumerate(near_corpus(random.Random(1)))]
    text = dict(rows)
    got = {(r.a, r.b) for r in s.similar_links(spark.createDataFrame(rows, "node long, text string")).collect()}
    want = {(a, b) for a in text for b in text if a < b and jaccard(text[a], text[b]) >= 0.8}
    label = {e: {i: i for i in text} for e in "gw"}
    for e, pairs in (("g", got), ("w", want)):
        for _ in text:
            for a, b in pairs:
                label[e][a] = label[e][b] = min(label[e][a], label[e][b])
    assert got <= want and sum(label["g"][i] == label["w"][i] for i in text) >= 0.95 * len(text)


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    rows = near_corpus(random.Random(2))
    rows += [(5000, None), (5001, ""), (rows[0][0], rows[0][1]), (None, rows[1][1]), (7000, "all alone here"), (7001, "all alone here too")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = s.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    groups: list[list[int]] = []
    for i, (_, t) in enumerate(rows):
        near = [g for g in groups if any(jaccard(t, rows[j][1]) >= 0.8 for j in g)]
        for g in near:
            groups.remove(g)
        groups.append([i, *(j for g in near for j in g)])
    want = sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in g)[1] for g in groups)
    assert sorted(r.doc_id for r in got) == want
    assert s.drop_near_duplicates(docs.limit(0)).count() == 0


@given(st.integers(1, 3000), st.floats(0, 1), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_sketches_never_part_a_similar_pair(n, share, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    y = np.unique(np.concatenate([x[rng.random(len(x)) < share], rng.integers(0, 1 << 64, int(n * (1 - share)) // 4, dtype=np.uint64)]))
    both = len(np.intersect1d(x, y))
    if both >= 0.8 * (len(x) + len(y) - both):
        assert s._may_be_similar(s._sketch(x)[None], s._sketch(y)[None], 0.8).all()


def test_sketches_part_most_unlike_pairs():
    rng = np.random.default_rng(1)
    for n in (60, 300, 500, 2000, 9000):
        rows = [s._sketch(np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))) for _ in range(40)]
        near = [s._may_be_similar(a[None], b[None], 0.8)[0] for i, a in enumerate(rows) for b in rows[:i]]
        assert np.mean(near) < 0.1


def edited_copies(rng, n, words=300):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        x = list(base)
        for at in rng.sample(range(words), rng.randint(1, 6)):
            x[at] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(x))
    return out


def groups_of(nodes, pairs):
    label = {i: i for i in nodes}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {i: root(i) for i in nodes}


def brute_links(texts):
    sets = [set(s.shingle_set(t, 5).tolist()) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_groups_of_many_edited_copies_are_whole(spark):
    rng = random.Random(3)
    texts = edited_copies(rng, 400) + edited_copies(rng, 30) + [t for _, t in near_corpus(rng)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(groups_of(range(len(texts)), brute_links(texts)).values())
    assert {r.doc_id for r in s.drop_near_duplicates(docs).collect()} == want


def test_sifting_pairs_of_sketches_of_several_widths():
    hashes = np.random.default_rng(7).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    sets = [hashes[k : k + n] for k, n in ((0, 500), (0, 520), (9000, 500), (0, 2100), (0, 2040))]
    rows = [s._sketch(np.sort(x)).tobytes() for x in sets]
    assert len({len(x) for x in rows}) == 3
    pairs = [(i, j) for i in range(5) for j in range(5)]
    names = ["a", "b", "star", "x", "y"]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs]), pa.array([j for _, j in pairs]), pa.array([True] * 25), pa.array([rows[i] for i, _ in pairs], pa.binary()), pa.array([rows[j] for _, j in pairs], pa.binary())], names=names)
    got = {(r["a"], r["b"]) for out in s._sifted(0.8)([batch.slice(0, 0), batch]) for r in out.to_pylist()}
    assert got == {(i, j) for i, j in pairs if i == j or {i, j} in ({0, 1}, {3, 4})}


def test_unlike_texts_that_share_a_rare_shingle_are_not_written_as_pairs(spark, monkeypatch):
    rng = random.Random(8)
    shared = [" ".join(f"s{i}x{j}" for j in range(5)) for i in range(15)]
    texts = [" ".join([*shared, *(f"n{rng.randrange(10**6)}" for _ in range(200))]) for _ in range(50)]
    texts += [t + " end" for t in texts[:5]]
    rows, write = [], s.materialize

    def counted(df):
        out = write(df)
        rows.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(s, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = groups_of(range(len(texts)), [(r.a, r.b) for r in s.similar_links(docs, sample=10**9).collect()])
    assert got == groups_of(range(len(texts)), brute_links(texts))
    assert max(n for names, n in rows if names[:2] == ["a", "b"]) < 4 * len(texts)


def test_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(s, "SLICE", 20)
    monkeypatch.setattr(s, "WHOLE", 1)
    rng = random.Random(9)
    texts = edited_copies(rng, 24, 60) + edited_copies(rng, 4, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = groups_of(range(len(texts)), [(r.a, r.b) for r in s.similar_links(docs, run_of=40, sample=10**9).collect()])
    assert got == groups_of(range(len(texts)), brute_links(texts))


def test_only_texts_in_company_get_sketches_and_no_similar_pair_is_parted(spark, monkeypatch):
    rng = random.Random(10)
    lines = [" ".join(f"s{i}x{j}" for j in range(12)) for i in range(40)]
    alone = [" ".join([rng.choice(lines), *(f"n{rng.randrange(10**6)}" for _ in range(150)), rng.choice(lines)]) for _ in range(120)]
    texts = alone + edited_copies(rng, 12, 150) + [alone[0] + " end", "", "  ", "a b", "A b"]
    rows, write = [], s.materialize

    def counted(df):
        out = write(df)
        rows.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(s, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    links = brute_links(texts)
    got = groups_of(range(len(texts)), [(r.a, r.b) for r in s.similar_links(docs).collect()])
    assert got == groups_of(range(len(texts)), links)
    assert max(n for names, n in rows if "sketch" in names) <= len({i for e in links for i in e}) + 10
    for similarity in (0.5, 0.8, 1.0):
        sets = [set(s.shingle_set(t, 5).tolist()) for t in texts]
        near = {i for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and len(x & y) >= similarity * len(x | y)}
        for common in (set(), set(rng.sample(sorted(set().union(*sets)), 300))):
            left = s._in_company(docs, len(texts), 5, similarity, np.array(sorted(common), dtype=np.uint64), docs.select("node"))
            assert near <= {r.node for r in left.collect()}
