"""Recordings written and read back; a read touches only the bytes of the channels and samples asked for."""

import numpy as np
import pytest
from tidemark.functions import continuous
from tidemark.sources import recordings as r

NAMES = ["Fz", "Cz", "Pz"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two recordings, in chunks of 100 and 60 samples, written by several tasks."""
    r.register(spark)
    path, g = tmp_path_factory.mktemp("rec"), np.random.default_rng(0)
    data = {"a/1": g.normal(size=(3, 250)).astype(np.float32), "b ü": g.normal(size=(3, 60)).astype(np.float32)}
    rows = [(k, s, 250.0, NAMES, x[:, s : s + 100].tolist(), [(s + 5, 0, f"boundary {s}")] if s else None) for k, x in data.items() for s in range(0, x.shape[1], 100)]
    spark.createDataFrame(rows, r.WRITTEN).repartition(3).write.format("recording").mode("append").save(str(path))
    return path, data


def read(spark, path, **options):
    return spark.read.format("recording").options(**options).load(str(path))


def joined(df):
    out = {}
    for row in sorted(df.collect(), key=lambda v: v.start):
        out.setdefault((row.recording, row.channel), []).extend(row.x)
    return out


def test_written_and_read_back(spark, folder):
    path, data = folder
    got = joined(read(spark, path))
    assert {k: v for k, v in got.items()} == {(k, c): x[i].tolist() for k, x in data.items() for i, c in enumerate(NAMES)}
    assert {x.rate for x in read(spark, path).collect()} == {250.0}


def test_asked_channels_and_samples_in_pieces(spark, folder):
    path, data = folder
    got = read(spark, path, channels="Pz, Fz", **{"from": "90", "to": "215", "length": "7"})
    assert max(len(x.x) for x in got.collect()) == 7 and {x.recording for x in got.collect()} == {"a/1"}
    assert joined(got) == {("a/1", c): data["a/1"][i, 90:215].tolist() for i, c in ((2, "Pz"), (0, "Fz"))}


def test_only_the_bytes_asked_for_are_read(spark, tmp_path):
    body = r.packed(100.0, NAMES, [np.arange(50.0)] * 3)
    size = len(body) - 2 * 50 * 4  # header and the first channel
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "000-50.rec").write_bytes(body[:size])
    r.register(spark)
    assert joined(read(spark, tmp_path, channels="Fz")) == {("x", "Fz"): list(range(50))}
    with pytest.raises(Exception, match="cut short"):
        read(spark, tmp_path, channels="Cz").collect()
    taken = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            taken.append(n)
            return self.f.read(n)

    reader = r.Reader({"path": str(tmp_path), "channels": "Fz", "from": "10", "to": "20"}, False)
    real = r.place
    system = type("S", (), {"open_input_file": lambda self, p: Counted(real(str(tmp_path))[0].open_input_file(p))})()
    r.place = lambda p: (system, p)
    try:
        parts = [r.Range(str(tmp_path / "x" / "000-50.rec"), "x", 0, 50, 10, 20)]
        assert [b.column(4).to_pylist() for p in parts for b in reader.read(p)] == [[list(range(10, 20))]]
    finally:
        r.place = real
    assert taken == [8, size - 8 - 200, 40]


def test_filters_reach_the_source(spark, folder):
    path, data = folder
    reader = r.Reader({"path": str(path)}, False)
    left = list(reader.pushFilters([r.EqualTo(("recording",), "b ü"), r.In(("channel",), ("Fz", "Oz")), r.EqualTo(("start",), 0)]))
    assert len(left) == 1 and {p.recording for p in reader.partitions()} == {"b ü"} and reader.only["channel"] == {"Fz", "Oz"}
    df = read(spark, path).where("recording = 'a/1' and channel in ('Cz', 'Oz')")
    assert joined(df) == {("a/1", "Cz"): data["a/1"][1].tolist()}


def test_marks(spark, folder):
    path, _ = folder
    assert sorted(map(tuple, read(spark, path, content="marks").collect())) == [("a/1", 105, 0, "boundary 100"), ("a/1", 205, 0, "boundary 200")]


def test_unknown_channels_bad_chunks_and_empty_folders(spark, folder, tmp_path):
    path, _ = folder
    with pytest.raises(Exception, match="no channel Oz"):
        read(spark, path, channels="Oz").collect()
    with pytest.raises(ValueError, match="one length"):
        r.packed(1.0, ["a", "b"], [[1.0], [1.0, 2.0]])
    assert read(spark, tmp_path).collect() == []


def test_overwrite_replaces_and_repeats_are_one_file(spark, tmp_path):
    r.register(spark)
    write = lambda rows, mode: spark.createDataFrame(rows, r.WRITTEN).write.format("recording").mode(mode).save(str(tmp_path))
    write([("a", 0, 1.0, ["c"], [[1.0, 2.0]], None), ("b", 0, 1.0, ["c"], [[3.0]], None)], "append")
    write([("a", 0, 1.0, ["c"], [[1.0, 2.0]], None)], "append")
    assert joined(read(spark, tmp_path)) == {("a", "c"): [1.0, 2.0], ("b", "c"): [3.0]}
    write([("a", 0, 1.0, ["c"], [[5.0]], None)], "overwrite")
    assert joined(read(spark, tmp_path)) == {("a", "c"): [5.0]} and [p.name for p in tmp_path.rglob("*.rec*")] == ["000000000000000-1.rec"]


def test_a_recording_goes_into_the_chunked_filters(spark, folder):
    path, data = folder
    chunks = read(spark, path, channels="Fz", length=100).where("recording = 'a/1'").selectExpr("recording", "start div 100 as chunk", "transform(x, v -> cast(v as double)) as x")
    got = [v for row in sorted(continuous.resampled(chunks, 4, 5, 100).collect(), key=lambda v: v.chunk) for v in row.x]
    from tidemark.functions.signal import resample

    assert np.allclose(got, resample(data["a/1"][0].astype(float), 4, 5), atol=1e-6)
