import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import pii_crf as c


@pytest.fixture(scope="module")
def model():
    return c.train(c.labelled_sentences())


def brute(text):
    """The patterns as written, without regard to speed."""
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    ok = [lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 16 <= len(digits(m)) <= 19 and c.luhn(digits(m)), lambda m: 8 <= len(digits(m)) <= 15]
    return [(k, *m.span()) for k, p in enumerate(pats) for m in re.finditer(p, text) if ok[k](m)]


@given(st.text(alphabet="a.@-1 2+()_é%", max_size=40) | st.text(alphabet="1. 4@a", max_size=30))
@settings(max_examples=500, deadline=None)
def test_base_spans(text):
    assert c.base_spans(text) == brute(text)


def test_base_spans_of_known_forms_and_long_runs():
    text = "x a.b@c.d_e@f.gh 001.2.3.255 1.2.3.256 1.2.3.4.5.6.7.8 4539-1488-0343-6467 4539148803436468 +1 (487) 555-7209. "
    assert c.base_spans(text) == brute(text)
    for t in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000, "+1" + "(" * 100_000, "1 " * 50_000):
        c.base_spans(t)


def test_viterbi_is_the_best_path(model):
    rng = np.random.default_rng(1)
    parts = [rng.normal(size=(n, 9)) * 3 for n in (1, 2, 4, 0, 3)]
    for e, got in zip(parts, c.viterbi(model, parts), strict=True):
        paths = (p for p in itertools.product(range(9), repeat=len(e)) if all(c._ALLOWED[a, b] for a, b in itertools.pairwise(p)) and (not p or c._FIRST[p[0]]))
        value = lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(model.moves[a, b] for a, b in itertools.pairwise(p))
        assert value(tuple(got)) == pytest.approx(max(map(value, paths)))


def test_held_out_accuracy(model):
    table = c.labelled_sentences(200, seed=99)
    found = c.field_spans([t for t, _ in table], model)
    hit = said = true = 0
    for (_, spans), got in zip(table, found, strict=True):
        hit, said, true = hit + len(set(got) & set(spans)), said + len(got), true + len(spans)
    assert hit / said > 0.95 and hit / true > 0.95


#: Written by hand; personal data in double brackets, with its kind.
BY_HAND = """
Write to [[0:maria.lopez@uni-hof.example.de]] before Friday, or ring [[3:(030) 555-0134]] at the desk.
The server at [[1:192.168.14.7]] answered 3 times in 20 ms; version 2.14.1 was fine.
Charge [[2:4111 1111 1111 1111]] for the 2 tickets and send the bill to [[0:bill_2@shop.org]].
She was born on 1984-07-12, lived at 12 Elm Street, and earned $3,500.50 in 2011.
My old number was [[3:+44 20 7946 0958]], the new one is [[3:+44-20-7946-0991]].
Order 12345678 of 17/03/2020 (page 4 of 9) was shipped at 10:45.
Card [[2:5500000000000004]] expired; use [[2:3782-8224-6310-0055]] instead.
Tweet @nobody or see chapter 3.2; the ratio is 0.75.
Contact: [[0:j+k@mail.example.com]], fax [[3:555-867-5309]].
Hosts [[1:10.0.0.1]] and [[1:10.0.0.254]] were down between 02:00 and 03:30.
"""


def test_accuracy_on_sentences_written_by_hand(model):
    texts, spans = [], []
    for line in BY_HAND.strip().split("\n"):
        text, own = "", []
        for i, part in enumerate(re.split(r"\[\[|\]\]", line)):
            if i % 2:
                own.append((int(part[0]), len(text), len(text) + len(part) - 2))
                part = part[2:]
            text += part
        texts.append(text)
        spans.append(own)
    found = [set(base) | set(added) for base, added in c.find_spans(texts, model)]
    hit = sum(len(f & set(s)) for f, s in zip(found, spans, strict=True))
    assert hit >= 0.9 * sum(map(len, spans)) and hit >= 0.9 * sum(map(len, found))


def plain_tokens(text):
    return [m.span() for m in re.finditer(r"[^\W\d_]+|[0-9]+|[^\w\s]|[_]|\w", text)]


@given(st.lists(st.text(alphabet="aB1 9.@é_²٣ǅ中%\n", max_size=15), max_size=5))
@settings(max_examples=200, deadline=None)
def test_tokens_of_several_texts(texts):
    t = c.tokens_of(texts)
    for i, text in enumerate(texts):
        own = slice(t.first[i], t.first[i + 1])
        assert list(zip(t.start[own].tolist(), t.end[own].tolist(), strict=True)) == plain_tokens(text)
        assert t.key[own].tolist() == c.tokens_of([text]).key.tolist()


@given(st.lists(st.text(alphabet="aB1 9.@+(-)%", max_size=60), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_parts_give_what_whole_texts_give(model, texts):
    t = c.tokens_of(texts)
    want = []
    for i, y in enumerate(c.viterbi(model, [model.emissions(t.key[a:b]) for a, b in itertools.pairwise(t.first)])):
        at = t.first[i]
        want.append([(k, int(t.start[at + a]), int(t.end[at + b - 1])) for k, a, b in c._spans(y)])
    assert c.field_spans(texts, model) == want


def test_most_tokens_of_plain_prose_are_settled(model):
    t = c.tokens_of(["the Quick brown fox, as they say, jumped. Over 12 dogs and Ün ort " * 500])
    assert sum(len(p) for _, p in c.open_parts(model, t)) < 0.35 * len(t.key)


def test_adds_what_patterns_miss_and_leaves_clean_texts(model):
    texts = ["pay 1234567812345678 now", "call (212) 555-0188 today", "On 2024-05-12 v1.2.3 cost $12.50 at 10:30, see pages 12-17.", "mail a.b@c.org", None, "", "no digits here"]
    found = c.find_spans(texts, model)
    assert [[t[a:b] for _, a, b in x] for t, (_, x) in zip(texts, found, strict=True)][:2] == [["1234567812345678"], ["(212) 555-0188"]]
    assert found[2] == ([], []) and [len(b) for b, _ in found] == [0, 0, 0, 1, 0, 0, 0]


def test_mask():
    assert c.mask("a b@c.d 12 34", [(0, 2, 7), (3, 8, 13), (2, 9, 12)]) == "a [EMAIL] [PHONE]"


def test_rows(spark, model):
    rng = random.Random(0)
    text = " ".join(rng.choice(["w", "x@y.zz", "10.0.0.1", "4539148803436467", "+1 (487) 555-7209", "1234567812345678"]) for _ in range(3000))
    rows = [(1, text, "en"), (1, text, "en"), (2, None, None), (3, "", "x"), (4, "plain", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = c.digest(c.find(docs, model)).collect()
    base = c.base_spans(text)
    assert len(got) == 5
    for r in got:
        want = base if r.doc_id == 1 else []
        assert r.base_sha256 == c.sha(want) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in want) for i in range(4))
        assert set(c._say(want).split(",")) <= set(r.spans.split(","))
    masked = c.mask_documents(docs, model)
    assert masked.columns == docs.columns and {r.doc_id: r.text for r in masked.collect()}[4] == "plain"
    assert not any("@" in (r.text or "") for r in masked.collect())
    assert c.find(docs.limit(0), model).count() == 0
