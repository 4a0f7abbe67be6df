"""Queries over binary files, renders, folds and streams."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, render, reports, signal
from ..sources import events as event_source
from ..sources import fixtures, midi, shared, soundfont, wav
from ..sources.events import BLOCK, events, read
from ..sources.shared import fresh_path
from ..streaming import live, metrics, stateful
from .registry import EV, query

#: Ticks of a generated file count seconds from 2024 on.
_EPOCH = 1_704_067_200
_ROWS = f"{EV}, m as (select dense_rank() over (order by ch) - 1 as track, row_number() over (partition by ch order by seq) - 1 as seq, sec - {_EPOCH} as tick, kind, ch, note, vel, k from ev)"


def _as_file(spark: SparkSession, sf_dir: str) -> str:
    """The table events as one MIDI file, a track for each channel."""
    ev = event_source.events(spark, sf_dir)
    note = F.col("kind") != "controller"
    rows = ev.select(
        F.col("ch").cast("int").alias("track"),
        "seq",
        (F.col("sec") - _EPOCH).alias("tick"),
        "kind",
        F.col("ch").cast("int").alias("ch"),
        F.when(note, F.col("note")).cast("int").alias("key"),
        F.when(F.col("kind") == "note_on", F.col("vel")).cast("int").alias("vel"),
        F.when(~note, F.lit(64)).cast("int").alias("num"),
        F.when(~note, F.col("k")).cast("int").alias("val"),
        F.lit(None).cast("int").alias("us_per_qn"),
    )
    path = fresh_path(spark, "events.mid")
    midi.write(rows, path)
    return path


@query(f"with {_ROWS} select cast(track as integer) as track, cast(seq as bigint) as seq, tick, kind, cast(ch as integer) as ch, cast(case when kind <> 'controller' then note end as integer) as key, cast(case when kind = 'note_on' then vel end as integer) as vel, cast(case when kind = 'controller' then 64 end as integer) as num, cast(case when kind = 'controller' then k end as integer) as val from m")
def midi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a MIDI file and read back, a task a track."""
    return midi.read(spark, _as_file(spark, sf_dir)).filter("kind <> 'other'").select("track", "seq", "tick", "kind", "ch", "key", "vel", "num", "val")


@query(f"with {_ROWS}, n as (select count(distinct ch) as n from ev) select cast(track as integer) as track, cast(any_value(n) as integer) as declared, cast(960 as integer) as division from m, n group by track")
def midi_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return midi.tracks(spark, _as_file(spark, sf_dir)).select("track", "declared", "division")


@query("select event_id as pos, round(cast(round(least(greatest(value / 100 - 1, -1), 1) * 32767) as double) / 32768, 6) as l, round(cast(round(least(greatest(1 - value / 100, -1), 1) * 32767) as double) / 32768, 6) as r from events")
def wav_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal written as 16-bit WAVE by range-partitioned tasks, read back in
    the largest ranges."""
    path = fresh_path(spark, "signal.wav")
    wav.write(read(spark, sf_dir, "events").selectExpr("event_id as pos", "value / 100 - 1 as l", "1 - value / 100 as r"), path, kind="pcm16")
    rows = wav.read_frames(spark, path)
    return rows.select("pos", F.round(F.col("l").cast("double"), 6).alias("l"), F.round(F.col("r").cast("double"), 6).alias("r"))


@query("select event_id as pos, round(cast(round(least(greatest(value / 100 - 1, -1), 1) * 32767) as double) / 32768, 6) as l, round(cast(round(least(greatest(1 - value / 100, -1), 1) * 32767) as double) / 32768, 6) as r from events")
def wav_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal written as WAVE and read back by ranges of frames."""
    path = fresh_path(spark, "signal.wav")
    wav.write(read(spark, sf_dir, "events").selectExpr("event_id as pos", "value / 100 - 1 as l", "1 - value / 100 as r"), path, kind="pcm16")
    rows = wav.read_frames(spark, path, 1 << 14)
    return rows.select("pos", F.round(F.col("l").cast("double"), 6).alias("l"), F.round(F.col("r").cast("double"), 6).alias("r"))


@query(f"with {_ROWS} select cast(track as integer) as track, cast(seq as bigint) as seq, tick, kind, cast(ch as integer) as ch, cast(case when kind <> 'controller' then note end as integer) as key from m")
def stream_midi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A MIDI file followed as a stream."""
    rows = midi.stream(spark, _as_file(spark, sf_dir)).filter("kind <> 'other'")
    return live.collected(rows.select("track", "seq", "tick", "kind", "ch", "key"), "append")


#: Parts that are the zones of one instrument file.
_ZONES = 200


def _font(rows: pd.DataFrame, folder: str) -> int:
    """One instrument file of parts (p_partkey, p_size); a zone for each."""
    number = int(rows["p_partkey"].iloc[0]) // _ZONES
    common = [("attack", -1200), ("pan", 100)]
    zones = [[("key_range", size + 256 * (size + 8)), ("attenuation", size * 4), *([("attack", size * 20)] if size % 2 else []), ("sustain", size * 3), ("modes", size % 4), ("filter_fc", 6000 + size * 100), ("sample", size % 3)] for size in map(int, rows["p_size"])]
    pcm = np.concatenate([fixtures.ramp(200)] * 3)
    samples = [(f"s{i}", i * 200, i * 200 + 150, i * 200 + 10, i * 200 + 140, 44_100, 60, 0, 0, 1) for i in range(3)]
    preset = (f"Parts {number}", number % 3, number % 128, [[("attenuation", 10 * (number % 5)), ("key_range", 10 + 256 * 50), ("instrument", 0)]])
    soundfont.write_file(f"{folder}/{number}.sf2", [preset], [("Parts", [common, *zones])], samples, pcm)
    return number


@query(
    f"with t as (select p_partkey // {_ZONES} as font, row_number() over (partition by p_partkey // {_ZONES} order by p_partkey) as zone, p_size as s from part)"
    " select cast(font as bigint) as font, 'Parts ' || font as preset_name, cast(font % 3 as bigint) as bank, cast(font % 128 as bigint) as program, cast(zone as bigint) as zone, cast(s % 3 as bigint) as sample, cast(greatest(s, 10) as bigint) as key_lo, cast(least(s + 8, 50) as bigint) as key_hi,"
    " cast(s * 4 + 10 * (font % 5) as double) as attenuation_cb, 0.2::double as pan, case s % 4 when 1 then 'continuous' when 3 then 'until_release' else 'none' end as loop_mode, round(pow(2, case when s % 2 = 1 then s * 20 else -1200 end / 1200.0::double), 6) as attack, round(pow(10, -s * 3 / 200.0::double), 6) as sustain, cast(6000 + s * 100 as double) as filter_fc_cents from t where s <= 50 and s + 8 >= 10"
)
def sf2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as zones of instrument files, which tasks write, read back."""
    folder = os.path.dirname(fresh_path(spark, "fonts"))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"font": [_font(rows.sort_values("p_partkey"), folder)]})

    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(f"p_partkey div {_ZONES}").alias("font"))
    parts.groupBy("font").applyInPandas(write, "font long").write.format("noop").mode("overwrite").save()
    # Seven tables are made of the records: files are parsed once.
    got = soundfont.regions(shared.written(soundfont.records(spark, folder), "sf2-records"))
    font = F.regexp_extract("path", r"([0-9]+)\.sf2$", 1).cast("long")
    return got.select(font.alias("font"), "preset_name", F.col("bank").cast("long").alias("bank"), F.col("program").cast("long").alias("program"), F.col("i_zone").cast("long").alias("zone"), F.col("sample").cast("long").alias("sample"), F.col("key_lo").cast("long").alias("key_lo"), F.col("key_hi").cast("long").alias("key_hi"), "attenuation_cb", "pan", "loop_mode", F.round("attack", 6).alias("attack"), F.round("sustain", 6).alias("sustain"), "filter_fc_cents")


def _voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcm = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("pcm"))
    fixed = {"step": 1.0, "attack_rate": 1.0, "attack_end": 1.0, "decay_coef": 0.99, "sustain": 0.5, "release_coef": 0.9}
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("voice"), (F.col("p_partkey") * 3).alias("start"), F.col("p_size").cast("long").alias("held"), (F.col("p_partkey") % 500).alias("vec_id"), (F.col("p_size") / 50).alias("gain_l"), (1 - F.col("p_size") / 100).alias("gain_r"))
    none = {n: F.lit(None).cast("double") for n in ("loop_start", "loop_end", "b0", "b1", "a1", "a2")}
    return parts.join(pcm, "vec_id").withColumns({n: F.lit(v) for n, v in fixed.items()} | none)


_MIX = """with v as (select p_partkey * 3 as start, p_size as held, embedding as e, p_size / 50 as gl, 1 - p_size / 100 as gr from part join embeddings on vec_id = p_partkey % 500),
 y as (select start + i as frame, e[i + 1]::double * case when i + 1 <= held then pow(0.99::double, i) else pow(0.99::double, held - 1) * pow(0.9::double, i + 1 - held) end as y, gl, gr from (select *, unnest(range(0, 64)) as i from v))
 select frame, round(sum(y * gl), 4) + 0.0 as l, round(sum(y * gr), 4) + 0.0 as r from y where y <> 0 group by frame"""


def _rounded(mix: DataFrame) -> DataFrame:
    return mix.select("frame", (F.round("l", 4) + 0.0).alias("l"), (F.round("r", 4) + 0.0).alias("r"))


@query(_MIX)
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(render.by_plan(_voices(spark, sf_dir)))


@query(_MIX)
def render_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(render.by_kernel(_voices(spark, sf_dir)))


@query()
def pool_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saturated pool per shard, where each block depends on the one before;
    the tests compare it with a loop."""
    ev = event_source.events(spark, sf_dir).filter("kind = 'note_on'")
    cand = ev.selectExpr("ch as shard", "block", "seq as idx", "seq as id", "value / 100 as gain", "block + k % 4 as ends")
    return folds.pool_fold(cand, cap=4)


@query()
def block_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a run's report, from one pool and a signal behind a limiter
    without attack; the tests compare it with a loop."""
    ev = read(spark, sf_dir, "events")
    on = ev.filter("event_type in ('click', 'view')")
    cand = on.selectExpr("0L as shard", "event_id div 64 as block", "event_id as idx", "event_id as id", "value / 100 as gain", "event_id div 64 + user_id % 4 as ends")
    pos, x = F.col("event_id").alias("pos"), F.col("value") / 100 - 1
    held = x * signal.needed_gain(F.abs(x), 0.5)
    out = reports.block_rows(folds.pool_fold(cand, cap=24), ev.select(pos, held.alias("l"), (-held).alias("r")), 64, 48_000.0)
    return out.withColumns({c: F.round(c, 6) for c in ("t", "rms", "peak")})


@query()
def loudness_follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feedback follower, row after row; the tests compare it with a loop."""
    rows = read(spark, sf_dir, "events").selectExpr("user_id % 16 as id", "event_id as pos", "value / 50 - 1 as l", "1 - value / 50 as r")
    return folds.follow(rows, 10.0, 100.0).select("id", "pos", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"))


@query()
def limiter_sustain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-stage release; the tests compare it with a loop."""
    rows = read(spark, sf_dir, "events").selectExpr("user_id % 16 as id", "event_id as pos", "case when value > 50 then 50 / value else 1.0D end as ma")
    return folds.two_stage_release(rows, 0.1, 0.01, 0.001).withColumn("gain", F.round("gain", 6))


@query(f"with {EV} select block, count(*) as n from ev where kind = 'note_on' group by block")
def stream_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note-ons per block of a stream with a watermark."""
    return live.collected(live.density(live.events(spark, sf_dir)), "update", ["block"])


@query(
    f"with {EV}, x as (select slot, seq, sum(case kind when 'note_on' then 1 when 'note_off' then -1 else 0 end) over w as x, count(*) filter (where kind = 'note_on') over w as ons from ev window w as (partition by slot order by seq)),"
    " m as (select *, x - least(0, min(x) over (partition by slot order by seq)) as sounding from x) select slot, seq, ons, cast(ons - sounding as bigint) as offs, cast(sounding as bigint) as sounding from m"
)
def stream_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate counters carried from batch to batch in a table, per slot."""
    return live.collected(live.gates(live.events(spark, sf_dir)), "append")


@query()
def stream_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of bounded pools over a stream in four batches, closed by timers, a
    pool for each fourth of the slots; the tests compare it with the batch."""
    rows = pool_rows(spark, sf_dir)
    path = f"{shared.shared_dir(spark)}/pool-stream-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min("time"), F.max("time")).first()
    span = (high - low) / 4 if low is not None else None
    for i in range(4):  # files in order of time, read one batch after the other
        part = rows.limit(0) if span is None else rows.filter((F.col("time") >= F.lit(low + span * i)) & (F.lit(i == 3) | (F.col("time") < F.lit(low + span * (i + 1)))))
        part.repartition(1).write.mode("append").parquet(path)  # read in parallel, one file
    # A shard ends with its last event; the rows that say so come behind all others.
    ends = rows.groupBy("shard").agg(F.max("time").alias("time"), F.max("own").alias("block")).withColumn("time", F.lit(high) + F.expr("interval 30 days"))
    last = ends.select("shard", "time", F.lit("end").alias("kind"), "block", *[F.lit(0).cast("long").alias(c) for c in ("idx", "id")], F.lit(0.0).alias("gain"), F.lit(0).cast("long").alias("ends"), F.col("block").alias("own"))
    last.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return live.collected(stateful.pool(stream, 40, BLOCK, release=1, tail=4), "append")


def pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note-ons as candidates of a pool a shard; one in eight waits a block."""
    on = events(spark, sf_dir).filter("kind = 'note_on'")
    return on.select((F.col("slot") % 4).alias("shard"), F.timestamp_micros("micros").alias("time"), F.lit("voice").alias("kind"), F.expr("block + if(k % 8 = 0, 1, 0)").alias("block"), F.col("seq").alias("idx"), F.col("seq").alias("id"), (F.col("value") / 100).alias("gain"), F.expr("block + 1 + k % 3").alias("ends"), F.col("block").alias("own"))


@query("with b as (select event_id, value, event_type, least((event_id - lo) * 4 // greatest(hi - lo + 1, 1), 3) as batch from events, (select min(event_id) as lo, max(event_id) as hi from events)) select cast(batch as bigint) as batch, count(*) as rows, count(*) filter (where event_type in ('click', 'view')) as ons, round(max(value), 6) as peak, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total from b group by 1")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener records of a stream that is started four times from its
    checkpoint, each time with a fourth of the events."""
    rows = read(spark, sf_dir, "events")
    path = f"{shared.shared_dir(spark)}/metrics-stream-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    at = F.least(F.floor((F.col("event_id") - F.lit(low)) * 4 / F.greatest(F.lit(high) - F.lit(low) + 1, F.lit(1))), F.lit(3))
    got = spark.createDataFrame([], metrics.SCHEMA)
    for i in range(4):
        rows.filter(at == i).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        seen = metrics.observe(stream, "events", ons=F.count_if(F.col("event_type").isin("click", "view")), peak=F.max("value"), total=F.sum(F.round(F.col("value") * 100).cast("long")))
        got = got.unionByName(metrics.run(seen, f"{path}/checkpoint", f"{path}/out"))
    of = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    return got.groupBy("batch").agg(*[of(n).cast("long").alias(n) for n in ("rows", "ons", "total")], F.round(of("peak"), 6).alias("peak"))
