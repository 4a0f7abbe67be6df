"""WAVE files: two readers, and a partitioned sink.

`read` gives a row a file with its samples and loop, with Spark's binaryFile, for
files that are samples of a bank. `read_frames` gives a row a frame of recordings
of any length: the driver walks chunk headers, and each task reads a range of
frames, a batch at a time, from a folder that all executors share. `write` writes a signal
(pos, l, r) without gathering it: rows are range-partitioned by position, each
task writes its part as raw samples, and the commit puts a header before the
parts laid end to end.

Defined cases: a file cut short, or longer than its header can say, has the
frames that are there, an incomplete last one left out; a mono file stands in
both channels, channels beyond two are passed over; what isn't RIFF/WAVE, has no data or format chunk, or holds an
unsupported encoding fails; chunks of other kinds are passed over; a size
beyond 4 GiB is written as the largest the header holds.
"""

from __future__ import annotations

import itertools
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .midi import matching

SCHEMA = "path string, sample_rate int, channels int, loop_start long, loop_end long, root_key int, fine_tune double, samples array<float>"
#: Format tags.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def chunks(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    view = memoryview(data)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(view):
        size = struct.unpack_from("<I", view, at + 4)[0]
        yield bytes(view[at : at + 4]), view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def samples_of(body: memoryview, tag: int, bits: int) -> np.ndarray:
    """Samples in -1..1 as 32-bit floats."""
    if (tag, bits) == (PCM, 8):
        return ((np.frombuffer(body, np.uint8).astype(np.float32)) - 128) / 128
    if (tag, bits) == (PCM, 24):
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 1:] = raw
        return ((wide.view("<i4").ravel() >> 8) / 8_388_608).astype(np.float32)
    kinds = {(PCM, 16): ("<i2", 32_768), (PCM, 32): ("<i4", 2_147_483_648), (FLOAT, 32): ("<f4", 1), (FLOAT, 64): ("<f8", 1)}
    if (tag, bits) not in kinds:
        raise ValueError(f"unsupported format tag {tag} of {bits} bits")
    dtype, full = kinds[tag, bits]
    whole = len(body) // np.dtype(dtype).itemsize * np.dtype(dtype).itemsize
    return (np.frombuffer(body[:whole], dtype) / full).astype(np.float32)


def decode(data: bytes) -> dict:
    out = {"loop_start": None, "loop_end": None, "root_key": None, "fine_tune": 0.0}
    form = body = None
    for tag, chunk in chunks(data):
        if tag == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", chunk)
            if kind == EXTENSIBLE and len(chunk) >= 40:
                kind = struct.unpack_from("<H", chunk, 24)[0]
            form = kind, bits
            out |= {"sample_rate": rate, "channels": channels}
        elif tag == b"data":
            body = chunk
        elif tag == b"smpl" and len(chunk) >= 36:
            note, fraction, loops = struct.unpack_from("<20xIxxxx", chunk)[0], struct.unpack_from("<I", chunk, 16)[0], struct.unpack_from("<I", chunk, 28)[0]
            note, fraction = struct.unpack_from("<II", chunk, 12)
            out |= {"root_key": note if note < 128 else None, "fine_tune": fraction / 2**32 * 100}
            if loops and len(chunk) >= 60:
                out["loop_start"], out["loop_end"] = struct.unpack_from("<II", chunk, 44)
    if form is None or body is None:
        raise ValueError("no fmt or data chunk")
    return out | {"samples": samples_of(body, *form)}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each WAVE file under path; files are read by the executors."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [{"path": p} | decode(bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"loop_start": "Int64", "loop_end": "Int64", "root_key": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return files.select("path", "content").mapInPandas(parse, SCHEMA)


def frames(files: DataFrame) -> DataFrame:
    """(path, pos, l, r): a row a frame; a mono file stands in both channels."""
    rows = files.select("path", "channels", F.posexplode("samples").alias("i", "v"))
    at = rows.withColumns({"pos": F.expr("i div channels").cast("long"), "c": F.expr("i % channels")}).filter("c < 2")
    both = at.groupBy("path", "pos").agg(F.max(F.when(F.col("c") == 0, F.col("v"))).alias("l"), F.max(F.when(F.col("c") == 1, F.col("v"))).alias("r"))
    return both.select("path", "pos", "l", F.coalesce("r", "l").alias("r"))


#: Frames that one task reads, and that it holds at a time.
RANGE, BATCH = 1 << 22, 1 << 16
FRAME = "path string, pos long, l float, r float"


@dataclass
class _Range(InputPartition):
    path: str
    at: int  # of the range's first byte
    first: int  # and frame
    frames: int
    form: tuple[int, int, int]  # format tag, bits, channels


def body_of(path: str) -> tuple[tuple[int, int, int], int, int]:
    """((format tag, bits, channels), offset and bytes of the samples), from the
    chunks' headers alone. A size of all ones is what a header holds at most, and
    reaches to the file's end."""
    size, form, at = os.path.getsize(path), None, 12
    with open(path, "rb") as f:
        head = f.read(12)
        if head[:4] != b"RIFF" or head[8:] != b"WAVE":
            raise ValueError(f"{path}: not a WAVE file")
        while at + 8 <= size:
            f.seek(at)
            tag, n = struct.unpack("<4sI", f.read(8))
            if tag == b"fmt ":
                chunk = f.read(min(n, 40))
                kind, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", chunk)
                form = struct.unpack_from("<H", chunk, 24)[0] if kind == EXTENSIBLE and len(chunk) >= 40 else kind, bits, channels
            elif tag == b"data" and form:
                left = size - at - 8
                return form, at + 8, left if n == 0xFFFFFFFF else min(n, left)
            at += 8 + n + (n & 1)
    raise ValueError(f"{path}: no fmt or data chunk")


class _FrameReader(DataSourceReader):
    def __init__(self, path: str, frames: int):
        self.path, self.frames = path, frames

    def partitions(self) -> list[_Range]:
        out = []
        for path in matching(self.path, (".wav",)):
            form, at, n_bytes = body_of(path)
            width = form[1] // 8 * form[2]
            n = n_bytes // width if width else 0
            out += [_Range(path, at + i * width, i, min(self.frames, n - i), form) for i in range(0, n, self.frames)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        tag, bits, channels = part.form
        width = bits // 8 * channels
        with open(part.path, "rb") as f:
            f.seek(part.at)
            for i in range(0, part.frames, BATCH):
                n = min(BATCH, part.frames - i)
                v = samples_of(memoryview(f.read(n * width)), tag, bits).reshape(-1, channels)
                pos = np.arange(part.first + i, part.first + i + len(v), dtype=np.int64)
                columns = [pa.array([part.path] * len(v)), pa.array(pos), pa.array(v[:, 0].copy()), pa.array(v[:, min(channels, 2) - 1].copy())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "pos", "l", "r"])


class WavFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader(self.options["path"], int(self.options.get("frames", RANGE)))


def read_frames(spark: SparkSession, path: str, frames: int = RANGE) -> DataFrame:
    """(path, pos, l, r) of the WAVE file, glob or folder; a partition for each
    ``frames`` frames of a file."""
    spark.dataSource.register(WavFrames)
    return spark.read.format("wav_frames").option("frames", frames).load(path)


def header(n_bytes: int, rate: int, channels: int, kind: str) -> bytes:
    tag, bits = (FLOAT, 32) if kind == "float32" else (PCM, 16)
    width, top = channels * bits // 8, 0xFFFFFFFF
    return b"RIFF" + struct.pack("<I", min(36 + n_bytes, top)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, channels, rate, rate * width, width, bits) + b"data" + struct.pack("<I", min(n_bytes, top))


@dataclass
class _Part(WriterCommitMessage):
    start: int | None
    path: str | None
    size: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, rate: int, kind: str):
        self.path, self.rate, self.kind = path.removeprefix("file://"), rate, kind

    def write(self, rows: Iterator) -> _Part:
        first = next(rows, None)
        if first is None:
            return _Part(None, None, 0)
        part, size, rows = f"{self.path}.{uuid.uuid4().hex}.part", 0, itertools.chain([first], rows)
        with open(part, "wb") as f:
            while batch := [(r["l"], r["r"]) for r in itertools.islice(rows, BATCH)]:
                size += f.write(self._bytes(np.array(batch)))
        return _Part(first["pos"], part, size)

    def _bytes(self, v: np.ndarray) -> bytes:
        if self.kind != "pcm16":
            return v.astype("<f4").tobytes()
        scaled = np.clip(v, -1, 1) * 32_767
        return (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype("<i2").tobytes()

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m and m.path), key=lambda m: m.start)
        with open(self.path, "wb") as out:
            out.write(header(sum(m.size for m in parts), self.rate, 2, self.kind))
            for m in parts:
                with open(m.path, "rb") as f:
                    shutil.copyfileobj(f, out)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class WavSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "pos long, l double, r double"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("rate", 48_000)), self.options.get("kind", "float32"))


def write(signal: DataFrame, path: str, rate: int = 48_000, kind: str = "float32") -> None:
    """A stereo file of signal (pos, l, r) in order of pos; kind is float32 or
    pcm16. The path must be one that all executors share."""
    signal.sparkSession.dataSource.register(WavSink)
    dealt = signal.select("pos", F.col("l").cast("double").alias("l"), F.col("r").cast("double").alias("r")).repartitionByRange("pos").sortWithinPartitions("pos")
    dealt.write.format("wav").mode("append").option("rate", rate).option("kind", kind).save(path)
