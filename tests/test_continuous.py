"""Chunks give what the whole recording gives: the recurrence sample by sample, the resampling by direct sums."""

import numpy as np
import pytest
from tidemark.functions import continuous as c
from tidemark.functions.signal import butter_gain, resample


def plain(sections, x, state=None):
    """Section by section and sample by sample, from the rest of the first sample or from given states."""
    y = np.array(x, dtype=float)
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        if state is None:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            s2 = (b2 - a2 * gain) * y[0]
            s1 = (b1 - a1 * gain) * y[0] + s2
        else:
            s1, s2 = state[k]
        out = []
        for v in y:
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            out.append(o)
        y = np.array(out)
    return y


def zero_phase(sections, x, pad):
    n = min(pad, len(x) - 1)
    full = np.r_[2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]] if n else x
    y = plain(sections, plain(sections, full)[::-1])[::-1]
    return y[n : n + len(x)]


def frame_of(spark, recordings, size, parts=3):
    rows = [(r, i, float(v)) for r, x in recordings.items() for i, v in enumerate(x)]
    return c.chunked(spark.createDataFrame(rows, "recording string, i long, v double").repartition(parts), "recording", "i", "v", size)


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.recording, r.chunk)):
        out.setdefault(r.recording, []).extend(r.x)
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def recordings():
    g = np.random.default_rng(0)
    return {"long": g.normal(size=1000).cumsum(), "short": g.normal(size=37) + 5, "two": np.array([1.0, 4.0]), "one": np.array([2.0])}


def test_sections_are_a_butterworth_band_pass():
    f = np.linspace(0.5, 120, 400)
    for low, high in ((8.0, 13.0), (0.5, 4.0), (25.0, 45.0)):
        z = np.exp(-2j * np.pi * f / 250)
        h = np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in c.band_sections(low, high, 250)], axis=0)
        warp = lambda v: 250 / np.pi * np.tan(np.pi * np.asarray(v) / 250)
        assert np.allclose(np.abs(h) ** 2, butter_gain(warp(f), *warp([low, high])), atol=1e-9)


def test_system_equals_the_recurrence_from_any_state():
    g = np.random.default_rng(1)
    sections = c.band_sections(8, 13, 64)
    system = c.System.of(sections)
    for n in (1, 5, 63, 64, 65, 500):
        x, state = g.normal(size=n), g.normal(size=8)
        assert np.allclose(system.run(x, state)[0], plain(sections, x, state.reshape(4, 2)))
        assert np.allclose(system.run(x, system.rest() * x[0])[0], plain(sections, x))
    y1, mid = system.run(x[:123], state)
    assert np.allclose(np.r_[y1, system.run(x[123:], mid)[0]], system.run(x, state)[0])


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_band_pass_equals_the_plain_recurrence_at_every_chunk_size(spark, recordings, size):
    some = recordings if size > 1 else {k: v[:90] for k, v in recordings.items()}
    got = joined(c.band_pass(frame_of(spark, some, size), 8, 13, 64))
    sections = c.band_sections(8, 13, 64)
    assert set(got) == set(some)
    for k, x in some.items():
        assert np.allclose(got[k], zero_phase(sections, x, 64), atol=1e-8), k


@pytest.mark.parametrize("size", [3, 50, 5000])
@pytest.mark.parametrize(("up", "down"), [(4, 5), (1, 2), (3, 1), (1, 1)])
def test_resampling_equals_the_whole_recording(spark, recordings, size, up, down):
    some = {k: v[:200] for k, v in recordings.items()}
    got = joined(c.resampled(frame_of(spark, some, size), up, down, size))
    for k, x in some.items():
        want = resample(x, up, down) if up != down else x
        assert len(got.get(k, [])) == len(want) == -(-len(x) * up // down) and np.allclose(got.get(k, []), want, atol=1e-9), k


def test_a_sine_keeps_its_shape_at_another_rate(spark):
    x = np.sin(2 * np.pi * 10 * np.arange(2500) / 250)
    got = joined(c.resampled(frame_of(spark, {"s": x}, 300), 4, 5, 300))["s"]
    assert len(got) == 2000 and np.abs(got - np.sin(2 * np.pi * 10 * np.arange(2000) / 200))[50:-50].max() < 1e-2


def test_null_samples_raise_and_empty_tables_are_empty(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None)], "recording string, i long, v double")
    with pytest.raises(Exception, match="null sample"):
        c.chunked(df, "recording", "i", "v").collect()
    empty = c.chunked(df.limit(0), "recording", "i", "v")
    assert c.band_pass(empty, 8, 13, 64).collect() == [] == c.resampled(empty, 1, 2).collect()
