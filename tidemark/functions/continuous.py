"""Whole recordings in chunks: the Butterworth recurrence forwards and backwards, and rational resampling, without a task that needs a
recording whole.

A recording is rows (recording, chunk, x): chunks of a fixed size in order, the last one shorter. The recurrence is a linear system, so a
chunk's end state is its own end state from rest plus a power of the system's matrix times the state it starts from; a pass sums up each
chunk in a few numbers, combines these along the recording, and runs every chunk from its proper state. Resampling sends the ends of a
chunk to its neighbours, as far as the filter reaches.

Defined cases: null samples are not allowed (gaps have no filter) and raise; an empty recording has no rows; a recording of one sample
filters to itself less its constant part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.signal import BANDS
from tidemark.plans.portable import frame

#: Samples of a chunk, and samples that one matrix product advances.
CHUNK, STRIDE = 65_536, 64


def band_sections(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital Butterworth band-pass; each has a zero at 0 and one at half the rate."""
    w = 2 * np.tan(np.pi * np.array([low, high]) / rate)
    pole = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * (w[1] - w[0]) / 2
    both = np.concatenate([pole + np.sqrt(pole**2 - w[0] * w[1]), pole - np.sqrt(pole**2 - w[0] * w[1])])
    z = (2 + both) / (2 - both)
    gain = ((w[1] - w[0]) * 2) ** order / np.prod(2 - both).real
    upper = sorted((v for v in z if v.imag > 1e-12), key=lambda v: (abs(v), v.real))
    real = sorted((v.real for v in z if abs(v.imag) <= 1e-12))
    pairs = [(-2 * v.real, abs(v) ** 2) for v in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    g = gain ** (1 / len(pairs))
    return np.array([(g, 0.0, -g, a1, a2) for a1, a2 in pairs])


@dataclass(frozen=True)
class System:
    """State equations s' = a s + b x, y = c s + d x of sections one after another, and the products that advance STRIDE samples."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    power: np.ndarray
    reach: np.ndarray
    see: np.ndarray
    respond: np.ndarray

    @staticmethod
    def of(sections: np.ndarray) -> System:
        a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b0, b1, b2, a1, a2 in sections:
            own, into = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
            n = len(b)
            a = np.block([[a, np.zeros((n, 2))], [np.outer(into, c), own]]) if n else own
            b, c, d = np.concatenate([b, into * d]), np.concatenate([b0 * c, [1.0, 0.0]]), b0 * d
        powers = [np.eye(len(b))]
        for _ in range(STRIDE):
            powers.append(a @ powers[-1])
        impulse = np.array([d, *(c @ p @ b for p in powers[: STRIDE - 1])])
        lag = np.arange(STRIDE)[:, None] - np.arange(STRIDE)
        return System(a, b, c, d, powers[STRIDE], np.stack([p @ b for p in powers[:STRIDE][::-1]], axis=1), np.stack([c @ p for p in powers[:STRIDE]]), np.where(lag >= 0, impulse[np.abs(lag)], 0))

    def rest(self) -> np.ndarray:
        """The state that a constant 1 keeps."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and the end state."""
        whole = len(x) // STRIDE
        body = x[: whole * STRIDE].reshape(whole, STRIDE)
        pushed, states = body @ self.reach.T, np.empty((whole + 1, len(self.b)))
        states[0] = state
        for k in range(whole):
            states[k + 1] = self.power @ states[k] + pushed[k]
        tail, state = x[whole * STRIDE :], states[-1]
        n = len(tail)
        y = [(body @ self.respond.T + states[:-1] @ self.see.T).ravel(), self.respond[:n, :n] @ tail + self.see[:n] @ state]
        return np.concatenate(y), np.linalg.matrix_power(self.a, n) @ state + self.reach[:, STRIDE - n :] @ tail


def chunked(samples: DataFrame, recording: str, i: str, value: str, size: int = CHUNK) -> DataFrame:
    """recording, chunk, x of rows (recording, i from 0 without gaps, value)."""
    known = F.coalesce(F.col(value).cast("double"), F.raise_error(F.lit("a recording has a null sample")).cast("double"))
    rows = samples.select(F.col(recording).alias("recording"), F.col(i).cast("long").alias("i"), known.alias("v"))
    return rows.groupBy("recording", F.floor(F.col("i") / size).cast("long").alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *values])))


def _padded(chunks: DataFrame, pad: int) -> DataFrame:
    """chunks and, before and after them, a chunk of the recording turned about its end sample, pad samples long or one less than it has."""
    sized = chunks.select("recording", "chunk", F.size("x").alias("n"))
    # numbers of chunks, not samples, meet here
    place = sized.withColumn("end", F.expr("sum(n) over (partition by recording order by chunk)")).withColumn("all", F.expr("sum(n) over (partition by recording)"))
    near = chunks.join(place.where(f"end - n <= {pad} or all - end <= {pad}"), ["recording", "chunk"])
    ends = near.groupBy("recording").agg(F.max("all").alias("all"), *(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("chunk", "x")))), lambda s: s["x"])).alias(a) for a, c in (("head", F.expr(f"end - n <= {pad}")), ("tail", F.expr(f"all - end <= {pad}")))), F.max("chunk").alias("last"))
    p = F.least(F.lit(pad), F.col("all") - 1).cast("int")
    left = F.transform(F.reverse(F.slice("head", F.lit(2), p)), lambda v: 2 * F.element_at("head", 1) - v)
    size = F.size("tail")
    right = F.transform(F.reverse(F.slice("tail", size - p, p)), lambda v: 2 * F.element_at("tail", -1) - v)
    return chunks.select("recording", "chunk", "x").unionByName(ends.select("recording", F.lit(-1).cast("long").alias("chunk"), left.alias("x"))).unionByName(ends.select("recording", (F.col("last") + 1).alias("chunk"), right.alias("x"))).where("size(x) > 0")


def _pass(chunks: DataFrame, system: System, backwards: bool) -> DataFrame:
    """One run of the recurrence over all chunks in order, or all in the opposite order, from the rest of the first sample."""
    way = slice(None, None, -1 if backwards else 1)
    kind = chunks.schema["recording"].dataType.simpleString()
    n = len(system.b)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [v.values.to_numpy()[way] for v in batch.column(2)]
            ends = [system.run(x, np.zeros(n))[1] for x in xs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in xs], pa.int64()), pa.array([x[0] for x in xs], pa.float64()), _lists(ends)], names=["recording", "chunk", "n", "first", "end"])

    def starts(rows):
        """States at which the chunks of one recording start: a few numbers a chunk."""
        rows = rows.sort_values("chunk", ascending=not backwards)
        state, out = system.rest() * rows["first"].iloc[0], []
        for size, end in zip(rows["n"], rows["end"], strict=True):
            out.append(state.tolist())
            state = np.linalg.matrix_power(system.a, int(size)) @ state + np.asarray(end)
        return rows[["recording", "chunk"]].assign(state=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [system.run(x.values.to_numpy()[way], s.values.to_numpy())[0][way] for x, s in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(y)], names=["recording", "chunk", "x"])

    summed = chunks.mapInArrow(sums, f"recording {kind}, chunk long, n long, first double, end array<double>")
    states = summed.groupBy("recording").applyInPandas(starts, f"recording {kind}, chunk long, state array<double>")
    return chunks.join(states, ["recording", "chunk"]).select("recording", "chunk", "x", "state").mapInArrow(run, f"recording {kind}, chunk long, x array<double>")


def band_pass(chunks: DataFrame, low: float, high: float, rate: float, order: int = 4, pad_s: float = 1.0) -> DataFrame:
    """recording, chunk, x: the band, zero phase, with odd reflection of pad_s seconds at both ends."""
    system = System.of(band_sections(low, high, rate, order))
    padded = _padded(chunks, int(round(pad_s * rate)))
    both = _pass(_pass(padded, system, False), system, True)
    return both.join(chunks.select("recording", "chunk"), ["recording", "chunk"], "left_semi")


def low_pass(up: int, down: int, half: int = 10) -> np.ndarray:
    """Kaiser-windowed sinc (beta 5) for that change of rate, half slower samples to a side."""
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    h = np.sinc(t / wide) / wide * np.kaiser(len(t), 5.0)
    return h * up / h.sum()


def resampled(chunks: DataFrame, up: int, down: int, size: int = CHUNK, half: int = 10) -> DataFrame:
    """recording, chunk, x at up / down times the rate; chunks must be of that size but for the last. Samples outside the recording are zero.

    Output m stands at time m * down / up and belongs to the chunk that holds it. A chunk gets the samples next to it that its filter
    reaches, from as many neighbours as that takes; nothing else is shuffled but the chunks themselves.
    """
    g = gcd(up, down)
    up, down = up // g, down // g
    h, wide = low_pass(up, down, half), max(up, down)
    halo = half * wide // up + 1
    reach = -(-halo // size)
    kind = chunks.schema["recording"].dataType.simpleString()
    # the outermost neighbours get only the samples that count
    far = halo - (reach - 1) * size
    part = F.when(F.col("d") == reach, F.slice("x", F.greatest(F.size("x") - far + 1, F.lit(1)), far)).when(F.col("d") == -reach, F.slice("x", 1, far)).otherwise(F.col("x"))
    first = F.col("chunk") * size + F.when(F.col("d") == reach, F.greatest(F.size("x") - far, F.lit(0))).otherwise(0)
    sent = chunks.select("recording", "chunk", "x", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d"))
    met = sent.select("recording", (F.col("chunk") + F.col("d")).alias("chunk"), F.struct(first.alias("at"), part.alias("x"), (F.col("d") == 0).alias("own")).alias("part")).groupBy("recording", "chunk").agg(F.collect_list("part").alias("parts")).where(F.exists("parts", lambda p: p["own"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                own = next(p for p in parts if p["own"])
                start, stop = own["at"], own["at"] + len(own["x"])
                x = np.zeros(stop - start + 2 * halo)
                for p in parts:
                    at = p["at"] - (start - halo)
                    v = np.asarray(p["x"])[max(0, -at) : max(0, len(x) - at)]
                    x[max(0, at) : max(0, at) + len(v)] = v
                m = np.arange(-(-start * up // down), -(-stop * up // down))
                k = (m * down // up)[:, None] + np.arange(-halo, halo + 1)
                tap = m[:, None] * down - k * up + half * wide
                fits = (tap >= 0) & (tap < len(h))
                out.append((np.where(fits, h[np.clip(tap, 0, len(h) - 1)], 0) * x[k - (start - halo)]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out)], names=["recording", "chunk", "x"])

    return met.mapInArrow(run, f"recording {kind}, chunk long, x array<double>")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(frame(spark, sf_dir, "samples"), "user_id", "i", "value")


def recording_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, chunk, x: each user's events as a recording at 64 Hz, its alpha band by the recurrence."""
    return band_pass(_users(spark, sf_dir), *BANDS["alpha"], 64).withColumnRenamed("recording", "user_id")


def recording_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, chunk, x: each user's events at four fifths of the rate."""
    return resampled(_users(spark, sf_dir), 4, 5).withColumnRenamed("recording", "user_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"recording_bands": recording_bands, "recording_resampled": recording_resampled}
