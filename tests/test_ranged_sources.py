"""WAVE files read by ranges of frames, and MIDI logs that grow."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.sources import fixtures, midi, soundfont, wav


def save(path, data, channels=2, bits=16, tag=1, before=b""):
    width = channels * bits // 8
    head = b"fmt " + struct.pack("<IHHIIHH", 16, tag, channels, 48_000, 48_000 * width, width, bits) + before + b"data" + struct.pack("<I", len(data))
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(head) + len(data)) + b"WAVE" + head + data)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.orderBy("path", "pos").select("pos", "l", "r").collect()]


@pytest.mark.parametrize(("bits", "tag", "dtype"), [(8, 1, "u1"), (16, 1, "<i2"), (24, 1, None), (32, 1, "<i4"), (32, 3, "<f4"), (64, 3, "<f8")])
@pytest.mark.parametrize("channels", [1, 2])
def test_ranges_equal_the_whole(spark, tmp_path, bits, tag, dtype, channels):
    rng = np.random.default_rng(bits + tag)
    n = 1000 * channels
    data = rng.integers(0, 256, n * 3, np.uint8).tobytes() if dtype is None else (rng.uniform(-1, 1, n) if tag == 3 else rng.integers(0, 250, n)).astype(dtype).tobytes()
    path = save(tmp_path / "a.wav", data, channels, bits, tag, before=b"LIST\x03\x00\x00\x00abc\x00")
    got = wav.read_frames(spark, path, 300)
    assert got.rdd.getNumPartitions() == 4
    assert rows(got) == rows(wav.frames(wav.read(spark, path))) and got.count() == 1000


def test_a_folder_and_files_cut_short(spark, tmp_path):
    a = save(tmp_path / "a.wav", np.arange(20, dtype="<i2").tobytes())
    save(tmp_path / "b.WAV", b"")
    with open(a, "r+b") as f:
        f.truncate(os.path.getsize(a) - 3)  # a frame and three fourths of one are gone
    (tmp_path / "c.txt").write_text("no")
    got = rows(wav.read_frames(spark, str(tmp_path)))
    assert [r[0] for r in got] == list(range(9)) and got[8][1] == pytest.approx(16 / 32_768)
    (tmp_path / "c.wav").write_bytes(b"RIFF....WAVX")
    with pytest.raises(Exception, match="not a WAVE file"):
        wav.read_frames(spark, str(tmp_path)).count()


def test_a_channel_more_and_every_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wav, "BATCH", 7)
    path = save(tmp_path / "a.wav", np.arange(300, dtype="<i2").tobytes(), channels=3)
    reader = wav._FrameReader(path, 40)
    parts = reader.partitions()
    assert [(p.first, p.frames) for p in parts] == [(0, 40), (40, 40), (80, 20)]
    batches = [b for p in parts for b in reader.read(p)]
    assert max(b.num_rows for b in batches) == 7
    assert [v for b in batches for v in b["pos"].to_pylist()] == list(range(100))
    assert [v for b in batches for v in b["r"].to_pylist()] == [(3 * i + 1) / 32_768 for i in range(100)]


def test_beyond_what_a_row_or_a_header_holds(spark, tmp_path):
    """Five gibibytes, of which only the ends are on disk."""
    path, n = tmp_path / "long.wav", (5 << 30) // 4
    save(path, b"")
    with open(path, "r+b") as f:
        f.seek(40)
        f.write(b"\xff" * 4 + struct.pack("<hh", 100, -100))
        f.seek(44 + (n - 1) * 4)
        f.write(struct.pack("<hh", 200, -200))
    reader = wav._FrameReader(str(path), wav.RANGE)
    parts = reader.partitions()
    assert len(parts) == -(-n // wav.RANGE) and sum(p.frames for p in parts) == n
    first, last = next(iter(reader.read(parts[0]))), list(reader.read(parts[-1]))[-1]
    assert [first[c][0].as_py() for c in ("pos", "l", "r")] == [0, 100 / 32_768, -100 / 32_768]
    assert [last[c][-1].as_py() for c in ("pos", "l", "r")] == [n - 1, 200 / 32_768, -200 / 32_768]


def follow(spark, path, out):
    q = midi.stream(spark, path).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(midi.SCHEMA).parquet(f"{out}/rows")


def test_a_log_that_grows_is_read_once(spark, tmp_path):
    whole = tmp_path / "whole.mid"
    midi.write(fixtures.scatter(spark, 200, 4, tracks=4), str(whole))
    data = whole.read_bytes()
    ends = [c.offset + c.length for c in midi.whole_chunks(str(whole))]
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    log = logs / "a.mid"
    log.write_bytes(data[:9])  # not even the header
    assert follow(spark, str(logs), out).count() == 0
    counts = []
    for n in (ends[1], ends[3] - 1, ends[3], ends[4]):  # the second cuts its last chunk
        log.write_bytes(data[:n])
        got = follow(spark, str(logs), out)
        counts.append(got.select("track").distinct().count())
    assert counts == [2, 3, 4, 5]
    (logs / "b.mid").write_bytes(data)
    got = follow(spark, str(logs), out)
    want = midi.read(spark, str(whole)).count()
    assert sorted(r["count"] for r in got.groupBy("file").count().collect()) == [want, want]
    assert got.select("file", "track", "seq").distinct().count() == got.count() == 2 * want
    key = ["track", "seq", "tick", "kind", "key"]
    assert sorted(map(str, got.filter(F.col("file").endswith("a.mid")).select(key).collect())) == sorted(map(str, midi.read(spark, str(whole)).select(key).collect()))


def test_a_restart_without_news_reads_nothing(spark, tmp_path):
    midi.write(fixtures.scatter(spark, 50, 2), str(tmp_path / "a.mid"))
    out = str(tmp_path / "out")
    first = follow(spark, str(tmp_path / "a.mid"), out).count()
    assert follow(spark, str(tmp_path / "a.mid"), out).count() == first > 100


def test_a_big_font_has_a_sample_a_key(spark, tmp_path):
    path = str(tmp_path / "big.sf2")
    fixtures.big_soundfont(path, 1.5)
    assert 1.5 * 2**20 - 200 <= os.path.getsize(path) < 1.6 * 2**20
    recs = soundfont.records(spark, path)
    got = soundfont.regions(recs).orderBy("key_lo").select("key_lo", "key_hi", "sample", "loop_mode").collect()
    assert [tuple(r) for r in got] == [(k, k, k - 21, "continuous") for k in range(21, 109)]
    n = int(1.5 * 2**20) // 2 // 88
    rows = soundfont.samples(recs).orderBy("sample").collect()
    assert [(r["root_key"], r["start"], r["end"], r["loop_start"]) for r in rows] == [(k, i * n, i * n + n, i * n + n // 2) for i, k in enumerate(range(21, 109))]
    pcm = {r["sample"]: tuple(r["pcm"]) for r in soundfont.fetch(recs).collect()}
    assert len(pcm) == len(set(pcm.values())) == 88
