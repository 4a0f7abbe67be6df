"""Clocks, as-of state and controller curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Stretches of ticks that a tempo map is joined by.
BUCKETS = 4096


def tempo_segments(tempo: DataFrame, ticks_per_quarter: int, rate: int, default_us: int = 500_000) -> DataFrame:
    """(tick, base, per_tick): at and after tick, frame = base + (t - tick) *
    per_tick. ``tempo`` is (tick, us_per_qn), one row a tick; a tempo map is
    small, and a first segment at tick 0 holds the default."""
    per = lambda us: us * (rate / 1e6 / ticks_per_quarter)
    start = tempo.sparkSession.range(1).select(F.lit(0).cast("long").alias("tick"), F.lit(default_us).cast("long").alias("us_per_qn"), F.lit(0).alias("_o"))
    both = start.unionByName(tempo.select("tick", "us_per_qn", F.lit(1).alias("_o")))
    w = Window.orderBy("tick", "_o")
    span = both.withColumn("_d", F.coalesce((F.col("tick") - F.lag("tick").over(w)) * per(F.lag("us_per_qn").over(w)), F.lit(0.0)))
    return span.select("tick", F.sum("_d").over(w).alias("base"), per(F.col("us_per_qn")).alias("per_tick"), F.lead("tick").over(w).alias("until"))


def smpte_frames(ev: DataFrame, fps: int, ticks_per_frame: int, rate: int) -> DataFrame:
    """ev (tick) with ``frame`` where a file counts in film frames: ticks have a
    fixed length, and tempo changes none."""
    return ev.withColumn("frame", F.col("tick") * (rate / fps / ticks_per_frame))


def frames(ev: DataFrame, segments: DataFrame) -> DataFrame:
    """ev (tick) with ``frame``, by the segment its tick lies in. Both sides are
    cut into stretches of ticks, some BUCKETS up to the last change of tempo, and
    joined equally by stretch; an event meets the segments of its own only."""
    last = segments.agg(F.max("tick")).first()[0] or 0
    width = max(1, -(-last // BUCKETS))
    at = lambda tick: F.greatest(F.lit(0), F.least(F.floor(tick / width), F.lit(last // width)))
    s = segments.withColumnRenamed("tick", "_at").filter("until is null or until > _at")
    # A segment reaches the stretch in which the next one starts; the last one goes on in the last.
    s = s.withColumn("_stretch", F.explode(F.sequence(at(F.col("_at")), at(F.coalesce("until", F.lit(last))))))
    inside = (F.col("tick") >= F.col("_at")) & (F.col("until").isNull() | (F.col("tick") < F.col("until")))
    met = ev.withColumn("_stretch", at(F.col("tick"))).join(s, "_stretch").filter(inside)
    return met.withColumn("frame", F.col("base") + (F.col("tick") - F.col("_at")) * F.col("per_tick")).drop("_at", "until", "base", "per_tick", "_stretch")


def in_force(ev: DataFrame, value: Column, name: str, by: str = "ch") -> DataFrame:
    """ev with the last non-null value of its channel so far."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ev.withColumn(name, F.last(value, ignorenulls=True).over(w))


def tile_grid(ev: DataFrame, value: Column, name: str) -> DataFrame:
    """(tile, ch, name) for every tile of the span and every channel: the value
    in force when the tile starts, which is the last from before it."""
    lasts = ev.filter(value.isNotNull()).groupBy("ch", "tile").agg(F.max_by(value, "seq").alias("_v"))
    spine = ev.agg(F.min("tile").alias("a"), F.max("tile").alias("b")).select(F.explode(F.sequence("a", "b")).alias("tile")).join(F.broadcast(ev.select("ch").distinct()))
    w = Window.partitionBy("ch").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    return spine.join(lasts, ["ch", "tile"], "left").select("tile", "ch", F.last("_v", ignorenulls=True).over(w).alias(name))


def lfo(ev: DataFrame, rate: Column) -> DataFrame:
    """ev with ``phase`` in 0..1 at each event of a channel: the rate in force
    from one event to the next, summed over the seconds between."""
    w = Window.partitionBy("ch").orderBy("seq")
    turned = ev.withColumn("_r", rate).withColumn("_d", F.coalesce(F.lag("_r").over(w) * (F.col("sec") - F.lag("sec").over(w)), F.lit(0.0)))
    return turned.withColumn("phase", F.pmod(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_r", "_d")
