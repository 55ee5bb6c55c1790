import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import sentence_pieces as s

TABLE = s.PrefixTable(s.model_path())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=s.model_path())


@given(st.text(alphabet="  ▁abtheinr\n\t019é日ゼ🎉́<0x>A/s", max_size=60))
@settings(max_examples=600, deadline=None)
def test_ids_equal_the_library(text):
    assert TABLE.encode(text) == LIBRARY.encode(text)


@given(st.text(max_size=40))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library_on_any_text(text):
    assert TABLE.encode(text) == LIBRARY.encode(text)


@given(st.lists(st.sampled_from(sorted(TABLE.ids)), max_size=8))
@settings(max_examples=600, deadline=None)
def test_ids_equal_the_library_on_joined_pieces(pieces):
    text = "".join(pieces)
    assert TABLE.encode(text) == LIBRARY.encode(text)


def test_every_piece_alone():
    assert all(TABLE.encode(p) == LIBRARY.encode(p) for p in TABLE.ids)


def test_long_texts_in_linear_time():
    g = random.Random(3)
    for t in ("a" * 100_000, " " * 100_000, "▁" * 999, "日本" * 20_000, "".join(g.choice("abcdefghijklmnopqrstuvwxyzAB+/") for _ in range(100_000)), "the end\n" * 20_000):
        assert TABLE.encode(t) == LIBRARY.encode(t)


def test_full_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(s, "UNITS", 3)
    monkeypatch.setattr(s, "PAIRS", 5)
    table = s.PrefixTable(s.model_path())
    for t in ("one two three one four five one six", "internationalisation of the neighbours " * 20):
        assert table.encode(t) == LIBRARY.encode(t)


def test_plain_merging_is_what_the_table_gives():
    g = random.Random(5)
    for _ in range(500):
        word = "".join(g.choice("▁theinrasol") for _ in range(g.randint(1, 20)))
        assert [TABLE.pieces[i] for i in TABLE._unit(word)] == s.merged(word, TABLE.score)


@pytest.mark.parametrize("changed", ["user", "charsmap", "unigram"])
def test_other_models_are_refused(tmp_path, changed):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(s.model_path(), "rb").read())
    if changed == "user":
        m.pieces[300].type = 4
    elif changed == "charsmap":
        m.normalizer_spec.precompiled_charsmap = b"x"
    else:
        m.trainer_spec.model_type = 1
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        s.PrefixTable(str(tmp_path / "m.model"))


@pytest.mark.parametrize("fallback", [True, False])
def test_smaller_vocabularies_with_and_without_bytes(tmp_path, fallback):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(s.model_path(), "rb").read())
    keep = [p for i, p in enumerate(m.pieces) if (i < 259 and (fallback or p.type != 6)) or (i >= 259 and i % 3 == 0)]
    del m.pieces[:]
    m.pieces.extend(keep)
    m.trainer_spec.byte_fallback = fallback
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    table, library = s.PrefixTable(str(tmp_path / "m.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    g = random.Random(7)
    for _ in range(800):
        t = "".join(g.choice("the in ▁ eraso日🎉\n12") for _ in range(g.randint(0, 30)))
        assert table.encode(t) == library.encode(t), t


def test_digest_of_whole_texts_nulls_empties_and_repeats(spark):
    texts = [None, "", " ", "the end", "the end", "a\tb\r\n  c ▁ d", "é🎉日" * 50, "word " * 5000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    want = []
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "")
        want.append((i if i != 3 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, s.digest(docs).collect()), key=str) == sorted(want, key=str)
    assert s.digest(docs.limit(0)).collect() == []


def test_encode_then_decode_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "one  two", [1, 2], "gone"), (2, None, None, "gone")], "doc_id long, text string, `a.b c` array<int>, decoded string")
    got = s.decode(s.encode(docs)).orderBy("doc_id").collect()
    assert got[0].asDict() == {"doc_id": 1, "text": "one  two", "a.b c": [1, 2], "ids": LIBRARY.encode("one  two"), "decoded": "one  two"}
    assert (got[1].ids, got[1].decoded) == ([], "")


def test_ids_are_decoded_from_the_encoders_lists():
    class Table:
        def encode(self, text):
            self.ids = [len(text or ""), 7] if text else []
            return self.ids

        def decode(self, ids):
            assert ids is self.ids
            return f"{ids}"

    ids, decoded = s._both(Table(), pa.array(["abc", None, "", "é"]))
    assert ids.type == pa.list_(pa.int32()) and ids.to_pylist() == [[3, 7], [], [], [1, 7]] and decoded.to_pylist() == ["[3, 7]", "[]", "[]", "[1, 7]"]
    assert [x.to_pylist() for x in s._both(Table(), pa.array([], pa.string()))] == [[], []]
