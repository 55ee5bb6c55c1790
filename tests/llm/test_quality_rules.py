import math
import random
import re
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from tidemark.llm import quality_rules as q
from tidemark.llm.sql import SQL

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \t\n", "a", "a b", "a b c a b c", "x " * 500, "a b c\n\na b c\n \na b c", "%%% ## é|<>\x0b b", "w x y", "a a a", "a a a a", " ".join(map(str, range(5000))) + " 7 8 9", "l1\nl1\r\nl1"]


def test_statistics_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(0, None, None, None)], SCHEMA)
    got = q.statistics(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(TEXTS) + 1
    for row in got:
        assert tuple(row)[1:] == brute(TEXTS[row.doc_id]), TEXTS[row.doc_id]


def test_tail_is_exact():
    assert q.tail(3, 0, 0.5) == pytest.approx(0.125)
    assert q.tail(10, 10, 0.3) == 1.0
    assert q.tail(4, 1, 0.25) == pytest.approx(0.75**4 + 4 * 0.25 * 0.75**3)


def plain_certify(counts, alpha, each):
    n, chosen = sum(counts.values()), []
    for r in range(4):
        best = 0
        for level in range(1, 7):
            k = sum(v for x, v in counts.items() if any(x[j] > 6 - c for j, c in enumerate([*chosen, level])))
            if binom(n, k, alpha) > each:
                break
            best = level
        chosen.append(best)
    return tuple(chosen)


def binom(n, k, p):
    a, b = Decimal(str(p)), 1 - Decimal(str(p))
    return float(sum(Decimal(math.comb(n, i)) * a**i * b ** (n - i) for i in range(min(k, n) + 1)))


def test_certified_cutoffs_bound_false_rejection():
    none, each = (0, 0, 0, 0), q.DELTA / (5 * 400)
    good = {
        "en": {none: 1800, (0, 2, 0, 0): 30, (0, 0, 6, 0): 900, (3, 0, 0, 1): 20},  # upper must stay off, the others bind
        "de": {none: 30},  # too few
        "fr": {none: 300, (1, 0, 0, 0): 40, (0, 1, 0, 0): 1},
        "es": {none: 600, (0, 0, 0, 4): 60},
    }
    got = q.certify(good, q.STRATA, q.ALPHA, q.DELTA)
    assert got == {s: plain_certify(c, q.ALPHA, each) for s, c in good.items()}
    assert got["en"][0] == 6 and got["en"][2] == 0 and got["de"] == (0, 0, 0, 0) and got["fr"][0] == 5 and got["es"] == (6, 6, 6, 2)


def test_ties_at_a_cutoff_are_not_above_it(spark):
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words[:-10] + [f"{w}#" for w in words[-10:]])), (2, " ".join(words[:-11] + [f"{w}#" for w in words[-11:]]))], "doc_id long, text string")
    got = {r.doc_id: r.x for r in q.statistics(docs, ["doc_id"]).select("doc_id", q.strikes()[0].alias("x")).collect()}
    assert got == {1: 0, 2: 1}  # 0.1 symbols a word, and 0.11


def test_sql_with_certified_strata_and_binding_rules(spark, tmp_path):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(2600):
        lang = ("en", "de", "fr", "xx")[i % 4 if i < 2000 else 3]
        u = rng.random()
        mark = "%%#" if u < 0.03 else "!" if u < 0.1 else ""
        text = " ".join(f"{'W' * (u > 0.9)}{rng.randrange(9999)}{mark * (rng.random() < 0.4)}" for _ in range(rng.randint(45, 90)))
        rows.append((i, text, lang, "s"))
        if i % 9:
            labels.append((i, int(u > 0.03 or lang == "fr"), 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {x[0]: x[-1] for x in con.sql(SQL["op2_quality_rules"]).fetchall()}
    got = q.rule_columns(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert {r.doc_id: r.kept for r in got} == want
    assert sum(not r.kept and not r.base_failed for r in got) > 20 and len({tuple(r.certified) for r in got}) > 1


def test_very_long_text(spark):
    text = " ".join(f"w{i * 7919 % 50021}" for i in range(120_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(q.statistics(docs, ["doc_id"]).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").first()) == brute(text)


def docs_and_labels(spark):
    rows = [(i, f"{i} " + " ".join(f"w{j * (i + 1) % 997}" for j in range(80)), "en", "s") for i in range(600)]
    rows += [(1000 + i, " ".join(f"w{j}{i}%%%#" for j in range(80)), "en", "s") for i in range(50)]
    rows += [(2000, "w%%% " + " ".join(f"v{j}%%%" for j in range(80)), "xx", "s"), (2001, None, None, None)]
    labels = [(i, 1, 0) for i in range(600)] + [(1000 + i, 0, 0) for i in range(50)] + [(None, 1, 0), (1000, None, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_verdict_keeps_clean_and_drops_junk(spark):
    docs, labels = docs_and_labels(spark)
    kept = {r.doc_id: r.kept for r in q.rule_columns(docs, labels).collect()}
    assert all(kept[i] for i in range(600)) and not any(kept[1000 + i] for i in range(50))
    assert kept[2000]  # a stratum without holdouts rejects nothing
    assert not kept[2001]
    out = q.filter_documents(docs.withColumnRenamed("source", "n_words"), labels)
    assert out.columns == ["doc_id", "text", "lang", "n_words"] and {r.doc_id for r in out.collect()} == {i for i, k in kept.items() if k}


def test_empty_tables(spark):
    docs, labels = docs_and_labels(spark)
    assert q.rule_columns(docs.limit(0), labels).count() == 0
    assert q.rule_columns(docs, labels.limit(0)).where("kept").count() == 651
