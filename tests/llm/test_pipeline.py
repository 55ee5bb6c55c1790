import random
import re

import corpus_pipeline
from tidemark.llm import packing, pii_crf, simhash
from tokenizers import Tokenizer


def tables(tmp_path, spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" if rng.random() < 0.9 else "the" for _ in range(n))
    spell = lambda letters, n: re.sub(r"\d", lambda m: letters[int(m[0])], say(n))
    clean = {i: spell("abcdefghij", rng.randint(60, 300)) for i in range(400)}
    docs = dict(clean)
    docs |= {1000 + i: " ".join(f"{w}%%%" for w in clean[i].split()) for i in range(40)}  # junk
    docs |= {2000 + i: clean[i] for i in range(5)}  # exact copies
    docs |= {2100 + i: clean[10 + i].replace(clean[10 + i].split()[7], "changed", 1) for i in range(5)}  # near copies
    bench = {i: spell("zyxwvutsrq", 30) for i in range(5)}
    docs |= {3000 + i: f"{spell('klmnopqrst', 60)} {bench[i]} {spell('klmnopqrst', 60)}" for i in range(5)}
    docs |= {4000: f"{spell('bcdefghijk', 80)} mail joe.d@mail.example.org or +1 (487) 555-7209 end", 5000: "too short", 5001: None}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i in docs if i < 1040], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def test_stages_against_what_was_planted(tmp_path, spark):
    texts = tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, left = docs.columns, {*texts}
    gone = [{i for i in texts if 1000 <= i < 1040 or i >= 5000}, {i for i in texts if 2000 <= i < 2200}, {i for i in texts if 3000 <= i < 3005}, set()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            left -= gone[i]
            assert docs.columns == names and sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(left), name
        if i == 3:
            masked = {r.doc_id: r.text for r in docs.collect()}
            model = pii_crf.train(pii_crf.labelled_sentences())
            assert "joe" not in masked[4000] and "555" not in masked[4000] and masked[4000].endswith("[PHONE] end")
            assert all(masked[d] == pii_crf.mask(texts[d], sum(pii_crf.find_spans([texts[d]], model)[0], [])) for d in left)
            assert masked[20] == texts[20]
    token = Tokenizer.from_file(packing.tokenizer_path())
    size = {d: len(token.encode(masked[d], add_special_tokens=False).ids) + 1 for d in left}
    got = {}
    for r in docs.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == size


def test_run_gives_the_same_rows(tmp_path, spark):
    tables(tmp_path, spark)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {20, 4000}


def test_near_duplicates_go_by_simhash_and_by_the_exact_join(tmp_path, spark):
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    often = " ".join(say(8) * 40)  # sets the fingerprint, as its shingles count with their repeats, but adds few to the set
    x, y = (f"{often} {' '.join(say(30))}" for _ in "xy")
    base = say(80)
    z, v = " ".join(base), " ".join([*base[:30], "new", "newer", *base[32:]])
    assert bin(simhash.fingerprint(x) ^ simhash.fingerprint(y)).count("1") <= 3 < bin(simhash.fingerprint(z) ^ simhash.fingerprint(v)).count("1")
    a, b = (set(simhash.shingle_set(t, 5).tolist()) for t in (x, y))
    assert len(a & b) < 0.8 * len(a | b)
    docs = spark.createDataFrame([(1, x), (2, y), (3, z), (4, v), (5, " ".join(say(80)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3, 5]
