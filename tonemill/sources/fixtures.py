"""Generated event logs, waveforms and instruments with known shapes.

Event logs are rows of the SMF schema made from spark.range, so they can be as
long as wanted; `midi.write` turns them into files.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import midi, soundfont

DIVISION, TICKS = 960, 1920
_EVENT = "track int, seq long, tick long, kind string, ch int, key int, vel int, num int, val int, us_per_qn int"


def _with_tempo(rows: DataFrame, us_per_qn: int = 500_000) -> DataFrame:
    """rows behind a first track that sets the tempo."""
    names = [c.split(" ")[0] for c in _EVENT.split(", ")]
    filled = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(c.split(" ")[1]).alias(n) for n, c in zip(names, _EVENT.split(", "), strict=True)])
    tempo = rows.sparkSession.createDataFrame([(0, 0, 0, "tempo", None, None, None, None, None, us_per_qn)], _EVENT)
    return tempo.unionByName(filled)


def _notes(numbered: DataFrame, on: Column, off: Column, ch: Column, key: Column, vel: Column) -> DataFrame:
    """Two rows a note of numbered (n, track), tracks from 1."""
    ends = F.array(F.struct(F.lit("note_on").alias("kind"), on.cast("long").alias("tick"), vel.cast("int").alias("vel")), F.struct(F.lit("note_off").alias("kind"), off.cast("long").alias("tick"), F.lit(None).cast("int").alias("vel")))
    each = numbered.select("track", "n", ch.cast("int").alias("ch"), key.cast("int").alias("key"), F.posexplode(ends).alias("i", "e"))
    return _with_tempo(each.select((F.col("track") + 1).cast("int").alias("track"), (F.col("n") * 2 + F.col("i")).alias("seq"), "e.tick", "e.kind", "ch", "key", "e.vel"))


def scatter(spark: SparkSession, notes: int, seconds: float, tracks: int = 1, key_lo: int = 36, key_hi: int = 84) -> DataFrame:
    """Notes spread evenly, of seven lengths, cycling through keys."""
    per, total = -(-notes // max(tracks, 1)), int(seconds * TICKS)
    n = F.col("n")
    numbered = spark.range(notes).select(F.col("id").alias("n"), F.floor(F.col("id") / per).alias("track"))
    on = F.floor(n * total / max(notes, 1))
    return _notes(numbered, on, on + TICKS // 10 + n % 7 * 40, F.col("track") % 16, key_lo + n % (key_hi - key_lo + 1), 40 + n % 80)


def simultaneous(spark: SparkSession, notes: int, hold: float, per_track: int = 65_536) -> DataFrame:
    """All notes begin at tick 1."""
    n = F.col("n")
    numbered = spark.range(notes).select(F.col("id").alias("n"), F.floor(F.col("id") / per_track).alias("track"))
    return _notes(numbered, F.lit(1), F.lit(1 + int(hold * TICKS)), n % 16, 21 + n % 88, F.lit(100))


def sustained(spark: SparkSession, notes: int, seconds: float, per_track: int = 100_000) -> DataFrame:
    """Notes spread evenly, none released before the end."""
    total, n = int(seconds * TICKS), F.col("n")
    numbered = spark.range(notes).select(F.col("id").alias("n"), F.floor(F.col("id") / per_track).alias("track"))
    return _notes(numbered, F.floor(n * total / max(notes, 1)), F.lit(total + 1), n % 16, 21 + n % 88, F.lit(90))


def bend_range(spark: SparkSession, semitones: int, ch: int = 0) -> DataFrame:
    """The three controllers that set a channel's bend range."""
    rows = [(1, i, 0, "controller", ch, None, None, num, val, None) for i, (num, val) in enumerate(((101, 0), (100, 0), (6, semitones)))]
    return _with_tempo(spark.createDataFrame(rows, _EVENT))


def sine(cycles: int, per_cycle: int, amp: float = 1.0) -> np.ndarray:
    return np.round(np.sin(np.arange(cycles * per_cycle) * 2 * math.pi / per_cycle) * amp * 32_767).clip(-32_767, 32_767).astype(np.int16)


def ramp(n: int) -> np.ndarray:
    """From one end to the other, no two samples alike."""
    return np.round(np.linspace(-1, 1, n) * 32_767).astype(np.int16)


def noise(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(-8192, 8192, n).astype(np.int16)


def simple_soundfont(path: str, rate: int = 44_100) -> None:
    """One looped tone over all keys."""
    pcm = sine(8, 100)
    instrument = [[("modes", 1), ("sample", 0)]]
    soundfont.write_file(path, [("Simple", 0, 0, [[("instrument", 0)]])], [("Tone", instrument)], [("tone", 0, len(pcm), 100, 700, rate, 69, 0, 0, 1)], pcm)


def rich_soundfont(path: str) -> None:
    """Three zones by key over two presets, the second quieter."""
    parts = [sine(8, 100), ramp(600), noise(500, 7)]
    starts = np.cumsum([0, *[len(p) + 46 for p in parts]])
    pcm = np.concatenate([x for p in parts for x in (p, np.zeros(46, np.int16))])
    span = lambda lo, hi: lo + 256 * hi
    zones = [
        [("attack", 0), ("release", -1200)],
        [("key_range", span(0, 59)), ("attack", -1200), ("decay", 1200), ("sustain", 200), ("pan", -500), ("modes", 1), ("sample", 0)],
        [("key_range", span(60, 71)), ("filter_fc", 9000), ("filter_q", 60), ("sample", 1)],
        [("key_range", span(72, 127)), ("attenuation", 100), ("pan", 500), ("sample", 2)],
    ]
    rows = [(f"s{i}", int(s), int(s) + len(p), int(s) + 100, int(s) + len(p) - 100, 22_050 if i == 2 else 44_100, 60, 0, 0, 1) for i, (s, p) in enumerate(zip(starts, parts, strict=False))]
    rows.append(("unused", 0, 10, 0, 0, 44_100, 60, 0, 0, 1))
    presets = [("Loud", 0, 0, [[("instrument", 0)]]), ("Quiet", 0, 1, [[("attenuation", 200), ("key_range", span(0, 100)), ("instrument", 0)]])]
    soundfont.write_file(path, presets, [("Rich", zones)], rows, pcm)


def big_soundfont(path: str, megabytes: float, rate: int = 44_100) -> None:
    """A looped sample of its own for each of a piano's keys, ``megabytes`` in
    all: a slowly beating pair and an octave, so that no two are alike."""
    keys = range(21, 109)
    n = max(int(megabytes * 2**20) // 2 // len(keys), 1024)
    turns = np.arange(n) * (2 * math.pi / rate)

    def tone(key: int) -> np.ndarray:
        w = turns * (440 * 2 ** ((key - 69) / 12))
        return np.round((np.sin(w) / 2 + np.sin(w * 1.003) * 0.3 + np.sin(w * 2) * 0.15) * 20_000).astype(np.int16)

    zones = [[("key_range", k + 256 * k), ("attack", -8000), ("decay", 1200), ("sustain", 100), ("release", -1200), ("modes", 1), ("sample", i)] for i, k in enumerate(keys)]
    rows = [(f"key {k}", i * n, (i + 1) * n, i * n + n // 2, (i + 1) * n, rate, k, 0, 0, 1) for i, k in enumerate(keys)]
    soundfont.write_file(path, [("Big", 0, 0, [[("instrument", 0)]])], [("Big", zones)], rows, np.concatenate([tone(k) for k in keys]))


def write_all(spark: SparkSession, folder: str) -> dict[str, str]:
    """Small files of every kind, for trying things out."""
    logs = {"scatter": scatter(spark, 1000, 10, 4), "simultaneous": simultaneous(spark, 2000, 4), "sustained": sustained(spark, 1000, 10)}
    out = {}
    for name, rows in logs.items():
        out[name] = f"{folder}/{name}.mid"
        midi.write(rows, out[name], DIVISION)
    out |= {"simple": f"{folder}/simple.sf2", "rich": f"{folder}/rich.sf2"}
    simple_soundfont(out["simple"])
    rich_soundfont(out["rich"])
    return out
