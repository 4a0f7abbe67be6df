"""Standard MIDI files as a Spark data source.

``spark.read.format("smf").load(path)`` gives one row an event, and each track
chunk of each file is an input partition of its own: the driver walks the
chunk headers only, and a task reads its chunk. ``path`` is a file, a glob or a
folder. Rows within a track keep the file's order in ``seq``; `merged` orders a
file's tracks by tick, ties by track.

`write` writes one file of rows (track, tick, seq, kind, ...), a track for each
``track``. Rows are range-partitioned in the file's order, and each task encodes
its own, row by row, into a part of raw bytes; a track may span many parts. The
commit only puts headers, the first delta of each piece and the pieces' bytes
end to end. The bare sink, ``df.write.format("smf")``, fails on rows that don't
come in that order.

`stream` follows logs that grow, by whole track chunks at their end or by new
files. An offset says how many chunks of each file are read, so a restart reads
none twice; a chunk that isn't all there yet waits, and so does a file without
its header. The driver walks headers, a task reads a chunk.

Defined cases: a file without MThd fails; unknown chunks are passed over, but
one of length zero ends the walk (padding); a chunk is cut at the end of the
file; a truncated track ends where its last whole event does.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, division int, track int, seq long, tick long, kind string, ch int, key int, vel int, num int, val int, us_per_qn int"
TRACKS = "file string, format int, declared int, division int, track int, offset long, length long"
_NAMES = ("ch", "key", "vel", "num", "val", "us_per_qn")


def matching(path: str, endings: tuple[str, ...]) -> list[str]:
    """The files of a folder with one of the endings, of a glob, or the one."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith(endings))
    return sorted(glob.glob(path)) or [path]


def files_of(path: str) -> list[str]:
    return matching(path, (".mid", ".midi", ".smf"))


def track_chunks(path: str) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(format, declared tracks, division, track, offset, length) per track."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(14)
        if head[:4] != b"MThd" or len(head) < 14:
            raise ValueError(f"{path}: not a standard MIDI file")
        header, fmt, declared, division = struct.unpack(">IHHH", head[4:14])
        at, track = 8 + header, 0
        while at + 8 <= size:
            f.seek(at)
            tag, length = struct.unpack(">4sI", f.read(8))
            if tag != b"MTrk" and length == 0:
                return
            if tag == b"MTrk":
                yield fmt, declared, division, track, at + 8, min(length, size - at - 8)
                track += 1
            at += 8 + length


class _Cursor:
    """Bytes of a chunk; reading past its end raises EOFError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise EOFError
        self.at += 1
        return self.data[self.at - 1]

    def varlen(self) -> int:
        v = 0
        for _ in range(8):
            b = self.byte()
            v = v << 7 | b & 0x7F
            if b < 0x80:
                return v
        raise EOFError

    def skip(self, n: int) -> None:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n


def _channel_event(status: int, first: int, more) -> tuple:
    """(kind, ch, key, vel, num, val) of a channel message."""
    ch, first = status & 15, first & 127
    group = status >> 4
    if group in (8, 9):
        vel = more() & 0xFF
        if group == 9 and vel:
            return "note_on", ch, first, vel & 127, None, None
        return "note_off", ch, first, None, None, None
    if group == 11:
        return "controller", ch, None, None, first, more() & 127
    if group == 12:
        return "program", ch, None, None, None, first
    if group == 14:
        return "pitch_bend", ch, None, None, None, ((more() & 127) << 7 | first) - 8192
    if group == 10:
        more()
    return "other", None, None, None, None, None


def decode(data: bytes) -> Iterator[tuple]:
    """(tick, kind, ch, key, vel, num, val, us_per_qn) of a track chunk."""
    c, tick, running = _Cursor(data), 0, 0
    try:
        while True:
            tick += c.varlen()
            status = c.byte()
            if status < 0x80:
                if not running:
                    return
                yield tick, *_channel_event(running, status, c.byte), None
            elif status < 0xF0:
                running = status
                yield tick, *_channel_event(status, c.byte(), c.byte), None
            elif status == 0xFF:
                running, meta = 0, c.byte()
                length = c.varlen()
                body = c.at
                c.skip(length)
                if meta == 0x51 and length == 3:
                    yield tick, "tempo", None, None, None, None, None, int.from_bytes(data[body : body + 3], "big")
                else:
                    yield tick, "other", None, None, None, None, None, None
                if meta == 0x2F:
                    return
            elif status in (0xF0, 0xF7):
                c.skip(c.varlen())
                yield tick, "other", None, None, None, None, None, None
            else:  # other system messages: real-time ones have no data byte
                if status < 0xF8:
                    c.byte()
                yield tick, "other", None, None, None, None, None, None
    except EOFError:
        return


@dataclass
class _Chunk(InputPartition):
    file: str
    division: int
    track: int
    offset: int
    length: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Chunk]:
        return [_Chunk(f, div, track, off, n) for f in files_of(self.path) for _, _, div, track, off, n in track_chunks(f)]

    def read(self, chunk: _Chunk) -> Iterator[tuple]:
        return rows_of(chunk)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {f: len(whole_chunks(f)) for f in files_of(self.path) if os.path.exists(f)}

    def partitions(self, start: dict, end: dict) -> list[_Chunk]:
        return [c for f, n in end.items() for c in whole_chunks(f)[start.get(f, 0) : n]]

    def read(self, chunk: _Chunk) -> Iterator[tuple]:
        return rows_of(chunk)


def rows_of(chunk: _Chunk) -> Iterator[tuple]:
    with open(chunk.file, "rb") as f:
        f.seek(chunk.offset)
        data = f.read(chunk.length)
    for seq, (tick, *rest) in enumerate(decode(data)):
        yield chunk.file, chunk.division, chunk.track, seq, tick, *rest


def whole_chunks(path: str) -> list[_Chunk]:
    """The track chunks of a file that are all there."""
    if os.path.getsize(path) < 14:
        return []
    out = []
    with open(path, "rb") as f:
        for _, _, division, track, offset, length in track_chunks(path):
            f.seek(offset - 4)
            if struct.unpack(">I", f.read(4))[0] <= length:
                out.append(_Chunk(path, division, track, offset, length))
    return out


def varlen(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def message(r) -> bytes | None:
    """An event's bytes behind its delta; None for kinds that aren't written."""
    kind, ch = r["kind"], r["ch"] or 0
    body = {
        "note_on": lambda: bytes([0x90 | ch, r["key"], r["vel"]]),
        "note_off": lambda: bytes([0x80 | ch, r["key"], 64]),
        "controller": lambda: bytes([0xB0 | ch, r["num"], r["val"]]),
        "program": lambda: bytes([0xC0 | ch, r["val"]]),
        "pitch_bend": lambda: bytes([0xE0 | ch, (r["val"] + 8192) & 127, (r["val"] + 8192) >> 7]),
        "tempo": lambda: b"\xff\x51\x03" + r["us_per_qn"].to_bytes(3, "big"),
    }.get(kind)
    return body() if body else None


@dataclass
class _Piece:
    """A part's bytes of one track, without the delta of the first event."""

    track: int
    first: tuple[int, int]  # (tick, seq) of the first and last row
    last: tuple[int, int]
    start: int | None = None  # ticks of the first and last event written
    end: int | None = None
    size: int = 0


@dataclass
class _Part(WriterCommitMessage):
    path: str | None
    pieces: list[_Piece]


class _Writer(DataSourceWriter):
    """Each task leaves its bytes beside the target; the commit joins them."""

    def __init__(self, path: str, division: int):
        self.path, self.division = path.removeprefix("file://"), division

    def write(self, rows: Iterator) -> _Part:
        import uuid

        part, pieces = f"{self.path}.{uuid.uuid4().hex}.part", []
        try:
            with open(part, "wb") as f:
                for r in rows:
                    at = (r["tick"], r["seq"])
                    if not pieces or pieces[-1].track != r["track"]:
                        if pieces and pieces[-1].track > r["track"]:
                            raise ValueError("rows aren't in order of track, tick and seq; use midi.write")
                        pieces.append(_Piece(r["track"], at, at))
                    p = pieces[-1]
                    if at < p.last:
                        raise ValueError("rows aren't in order of track, tick and seq; use midi.write")
                    p.last, body = at, message(r)
                    if body is None:
                        continue
                    if p.start is None:
                        p.start = r["tick"]
                    else:
                        body = varlen(r["tick"] - p.end) + body
                    p.end = r["tick"]
                    p.size += f.write(body)
        except BaseException:
            os.remove(part)
            raise
        return _Part(part, pieces)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m and m.pieces), key=lambda m: (m.pieces[0].track, m.pieces[0].first, m.pieces[-1].track, m.pieces[-1].last))
        track = None
        with open(self.path, "wb") as out:

            def end_track() -> None:
                if track is not None:
                    out.write(b"\x00\xff\x2f\x00")
                    stop = out.tell()
                    out.seek(begin - 4)
                    out.write(struct.pack(">I", stop - begin))
                    out.seek(stop)

            n_tracks = len({p.track for m in parts for p in m.pieces})
            out.write(b"MThd" + struct.pack(">IHHH", 6, 1, n_tracks, self.division))
            for m in parts:
                with open(m.path, "rb") as f:
                    for p in m.pieces:
                        if track is not None and (track, last) > (p.track, p.first):
                            raise ValueError("parts overlap; use midi.write")
                        if p.track != track:
                            end_track()
                            out.write(b"MTrk" + bytes(4))
                            track, now, begin = p.track, 0, out.tell()
                        last = p.last
                        if p.start is not None:
                            out.write(varlen(p.start - now))
                            _copy(f, out, p.size)
                            now = p.end
            end_track()
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


def _copy(src, dst, size: int, step: int = 1 << 20) -> None:
    while size:
        got = src.read(min(size, step))
        if not got:
            raise EOFError(f"{src.name}: shorter than its pieces")
        size -= dst.write(got)


class SmfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "smf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("division", 960)))


def stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SmfSource)
    return spark.readStream.format("smf").load(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SmfSource)
    return spark.read.format("smf").load(path)


def write(events: DataFrame, path: str, division: int = 960) -> None:
    events.sparkSession.dataSource.register(SmfSource)
    order = ("track", "tick", "seq")
    dealt = events.select("track", "seq", "tick", "kind", *_NAMES).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.format("smf").mode("append").option("division", division).save(path)


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, format, declared, division, track, offset, length): what the
    headers say; few rows, made on the driver."""
    rows = [(f, fmt, n, div, t, off, size) for f in files_of(path) for fmt, n, div, t, off, size in track_chunks(f)]
    return spark.createDataFrame(rows, TRACKS)


def merged(events: DataFrame) -> DataFrame:
    """All tracks of each file in one order: by tick, then track, then seq."""
    return events.orderBy("file", "tick", "track", "seq")


def ticks_per_second(division: int, us_per_qn: int = 500_000) -> float:
    """From a header's division: ticks a quarter, or frames and ticks a frame."""
    if division & 0x8000:
        return (256 - (division >> 8)) * (division & 0xFF)
    return division * 1e6 / us_per_qn


def kinds(events: DataFrame) -> DataFrame:
    """(kind, n) over all files."""
    return events.groupBy("kind").agg(F.count("*").alias("n"))
