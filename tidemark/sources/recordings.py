"""Recordings as a Spark data source: chunk files of several channels, of which a read takes only the bytes asked for.

A folder holds a folder for each recording and in it a file for each chunk, `<first sample>-<samples>.rec`: eight bytes with the length of
a JSON header (rate, channels, marks), the header, then each channel's samples one after another as little-endian 32-bit floats. Names
tell where a chunk lies, so planning lists files and opens none; a task seeks to each asked channel and range.

    register(spark)
    spark.read.format("recording").option("channels", "Fz,Cz").option("from", 0).option("to", 2500).load(folder)
    rows.write.format("recording").mode("append").save(folder)   # recording, start, rate, channels, x (a list a channel), marks

Read options: channels (all; one that a chunk lacks is an error), from and to (samples, to exclusive), length (most samples of a row, and of
the range that a task reads of a chunk). With content "marks" rows are recording, onset, duration, text. Equality and IN on recording and
channel are pushed down.

Writing is by task and at most once a file: a file appears whole under its name, a repeated task writes the same one; mode overwrite removes
the other files once all tasks are done. Any file system that pyarrow.fs opens by its address works.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SAMPLES = "recording string, channel string, start long, rate double, x array<float>"
MARKS = "recording string, onset long, duration long, text string"
WRITTEN = "recording string, start long, rate double, channels array<string>, x array<array<float>>, marks array<struct<onset long, duration long, text string>>"
_NAME = re.compile(r"(\d+)-(\d+)\.rec")


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def packed(rate: float, channels: Sequence[str], x: Sequence[np.ndarray], marks: Sequence[tuple[int, int, str]] = ()) -> bytes:
    """A chunk file's bytes."""
    if len(channels) != len(x) or len({len(v) for v in x}) != 1 or len(set(channels)) != len(channels):
        raise ValueError("a chunk needs one list of samples a channel, all of one length, and names that differ")
    head = json.dumps({"rate": rate, "channels": list(channels), "marks": [list(m) for m in marks]}).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(np.asarray(v, "<f4").tobytes() for v in x)


@dataclass
class Range(InputPartition):
    """Samples [first, stop) of the recording, within the chunk [start, start + n) of a file."""

    file: str
    recording: str
    start: int
    n: int
    first: int
    stop: int


def header(f) -> tuple[dict, int]:
    size = int.from_bytes(f.read(8), "little")
    return json.loads(f.read(size)), 8 + size


class Reader(DataSourceReader):
    def __init__(self, options: dict, marks: bool) -> None:
        self.path, self.marks = options["path"], marks
        asked = options.get("channels", "")
        self.channels = [c.strip() for c in asked.split(",") if c.strip()]
        self.first, self.stop = int(options.get("from", 0)), int(options.get("to", 2**62))
        self.length = int(options.get("length", 65_536))
        if self.length < 1:
            raise ValueError("length is at least 1")
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("recording",), ("channel",)) and not self.marks:
                name = f.attribute[0]
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[Range]:
        system, root = place(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            recording, name = info.path.rsplit("/", 2)[-2:]
            if info.type != fs.FileType.File or not (m := _NAME.fullmatch(name)):
                continue
            recording, start, n = unquote(recording), int(m[1]), int(m[2])
            if recording not in self.only.get("recording", {recording}):
                continue
            a, b = (start, start + n) if self.marks else (max(start, self.first), min(start + n, self.stop))
            step = n if self.marks else self.length
            out += [Range(info.path, recording, start, n, at, min(at + step, b)) for at in range(a, b, max(step, 1))]
        return sorted(out, key=lambda r: (r.recording, r.first)) or [Range("", "", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        system, _ = place(self.path)
        with system.open_input_file(part.file) as f:
            head, at = header(f)
            if self.marks:
                if head["marks"]:
                    onset, duration, text = zip(*head["marks"], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([part.recording] * len(onset)), pa.array(onset, pa.int64()), pa.array(duration, pa.int64()), pa.array(text, pa.string())], names=["recording", "onset", "duration", "text"])
                return
            known = {c: i for i, c in enumerate(head["channels"])}
            if lacking := [c for c in self.channels if c not in known]:
                raise ValueError(f"{part.file} has no channel {lacking[0]}")
            for c in self.channels or head["channels"]:
                if c in self.only.get("channel", {c}):
                    f.seek(at + 4 * (known[c] * part.n + part.first - part.start))
                    size = part.stop - part.first
                    x = np.frombuffer(f.read(4 * size), "<f4")
                    if len(x) != size:
                        raise ValueError(f"{part.file} is cut short")
                    yield pa.RecordBatch.from_arrays([pa.array([part.recording]), pa.array([c]), pa.array([part.first]), pa.array([float(head["rate"])]), pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(x))], names=["recording", "channel", "start", "rate", "x"])


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        from pyspark import TaskContext

        system, root = place(self.path)
        done = []
        attempt = TaskContext.get().taskAttemptId()
        for batch in iterator:
            for row in batch.to_pylist():
                if row["recording"] is None or row["start"] is None or row["x"] is None:
                    raise ValueError("a chunk needs a recording, a start and samples")
                body = packed(row["rate"], row["channels"], row["x"], [(m["onset"], m["duration"], m["text"]) for m in row.get("marks") or []])
                folder = f"{root}/{quote(row['recording'], safe='')}"
                name = f"{folder}/{row['start']:015d}-{len(row['x'][0]) if row['x'] else 0}.rec"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{name}.{attempt}") as f:
                    f.write(body)
                system.move(f"{name}.{attempt}", name)
                done.append(name)
        return Files(done)

    def commit(self, messages: list[Files | None]) -> None:
        if self.overwrite:
            system, root = place(self.path)
            new = {n for m in messages if m for n in m.names}
            for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path.endswith(".rec") and info.path not in new:
                    system.delete_file(info.path)

    def abort(self, messages: list[Files | None]) -> None:
        """Whole files of finished tasks go; what was there before an append with other names stays."""
        system, _ = place(self.path)
        for n in (n for m in messages if m for n in m.names):
            system.delete_file(n)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return MARKS if self.options.get("content") == "marks" else SAMPLES

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), self.options.get("content") == "marks")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it take filters."""
    spark.dataSource.register(Recordings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
