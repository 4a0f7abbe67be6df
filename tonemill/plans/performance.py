"""Events and embeddings as a performance, from clock to limiter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import controls, performance, reports
from ..sources.events import events, read
from .registry import query

CONFIG = Config(sample_rate=8000, block_frames=4096, gate_frames=128, steal_fade_frames=96, max_voices=400, limiter_lookahead_ms=2.0, limiter_release_ms=20.0)
#: The controllers that events stand for, by their k.
_NUMBERS = [7, 11, 10, 1, 64, 66, 67, 71, 72, 73, 74, 75, 76, 77, 92, 39, 43, 33]


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as (channel, seq, frame, kind, a, b): event numbers are
    ticks, and a tempo event for each thousandth of them sets the clock."""
    ev = events(spark, sf_dir)
    tempo = ev.filter("seq % 1000 = 500").selectExpr("seq as tick", "400000 + k * 2000 as us_per_qn")
    clock = controls.tempo_segments(tempo, 2000, 8000)
    spread = ev.withColumn("tick", F.col("seq"))
    kind = F.when(F.col("kind") != "controller", F.col("kind")).when(F.col("k") % 20 == 0, "bend").when(F.col("k") % 20 == 1, "program").otherwise("controller")
    number = F.element_at(F.array(*map(F.lit, _NUMBERS)), (F.col("k") % len(_NUMBERS) + 1).cast("int"))
    a = F.when(kind == "bend", F.col("vel") * 128 - 8192).when(kind == "program", F.col("vel") % 8).when(kind == "controller", number).otherwise(F.col("note"))
    placed = controls.frames(spread, clock).withColumn("frame", F.floor("frame").cast("long"))
    return placed.select(F.col("ch").cast("long").alias("channel"), "seq", "frame", kind.alias("kind"), a.cast("long").alias("a"), F.col("vel").cast("long").alias("b"))


def bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, presets and samples, an embedding each."""
    e = read(spark, sf_dir, "embeddings").filter("vec_id is not null")
    samples = e.select(F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("pcm"))
    regions = e.selectExpr(
        "vec_id % 8 as preset", "vec_id as region", "vec_id % 16 * 8 as key_lo", "vec_id % 16 * 8 + 23 as key_hi", "vec_id % 3 * 20 as vel_lo", "127L as vel_hi",
        "vec_id as sample", "cast(size(embedding) as bigint) as frames", "60L as root", "100D as cents_a_key", "vec_id % 100 - 50D as tune", "vec_id % 60 + 60D as attenuation",
        "100D as vel_track", "vec_id % 21 / 10D - 1 as pan", "if(vec_id % 50 = 7, 0.05D, 0D) as delay", "vec_id % 5 / 1000D as attack", "0D as hold", "0.05D + vec_id % 7 / 50D as decay",
        "vec_id % 4 / 5D as sustain", "0.01D + vec_id % 9 / 200D as release", "if(vec_id % 3 = 0, 9000D, 13500D) as cutoff", "vec_id % 30 * 2D as resonance", "8L as loop_start", "56L as loop_end",
        "element_at(array('continuous', 'until_release', 'none'), cast(vec_id % 3 + 1 as int)) as loop",
    )
    presets = spark.range(9).selectExpr("if(id = 8, 128L, 0L) as bank", "id % 8 as program", "id % 8 as preset")
    return regions, presets, samples


@query()
def render_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the whole performance, limited; the tests compare the mix with
    a sequential loop."""
    done = performance.perform(timed(spark, sf_dir), *bank(spark, sf_dir), CONFIG)
    return performance.brickwall(done["mix"], CONFIG).select("frame", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"))


@query()
def render_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run ends with: notes, voices, the most that live at once, stolen and
    dropped ones, those that outlast the tail, the mix's peak and the share of it
    that would clip."""
    ev = timed(spark, sf_dir)
    return reports.run_totals(ev, performance.perform(ev, *bank(spark, sf_dir), CONFIG)).withColumn("peak", F.round("peak", 6))
