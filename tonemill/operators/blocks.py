"""Tumbling blocks: density, concurrency, levels and scans over them.

Nothing here puts all events into one window. A scan over the whole order is
two-level: sums per block, a window over blocks (one row each), and a window
inside each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, value: Column, order: list[str], name: str, block: str = "block") -> DataFrame:
    """df with ``name``: the sum of value up to and with each row, by block
    and then by ``order``."""
    held = df.withColumn("_v", value)
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy(block).agg(F.sum("_v").alias("_s")).select(block, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("_in", F.sum("_v").over(inside)).join(starts, block).withColumn(name, F.col("_in") + F.col("_start")).drop("_v", "_in", "_start")


def density(ev: DataFrame) -> DataFrame:
    """(block, n): note-ons of every block from the first to the last event's,
    those without any included."""
    counts = ev.groupBy("block").agg(F.count_if(F.col("kind") == "note_on").alias("n"))
    spine = counts.agg(F.min("block").alias("a"), F.max("block").alias("b")).select(F.explode(F.sequence("a", "b")).alias("block"))
    return spine.join(counts, "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("n"))


def busiest(per_block: DataFrame) -> DataFrame:
    """The block of most note-ons; of equal ones the later."""
    return per_block.agg(F.max(F.struct("n", "block")).alias("m")).select("m.n", "m.block")


def peak_concurrency(per_block: DataFrame, width: int) -> DataFrame:
    """(voices, block): the most note-ons in ``width`` blocks on end, and the
    first block of the first such span; spans lie inside the blocks there are,
    unless there are fewer."""
    w = Window.orderBy("block")
    spans = per_block.select("block", F.sum("n").over(w.rowsBetween(0, width - 1)).alias("voices"), F.count("*").over(w.rowsBetween(0, width - 1)).alias("inside"), F.row_number().over(w).alias("at"))
    whole = spans.filter((F.col("inside") == width) | (F.col("at") == 1))
    return whole.agg(F.max(F.struct("voices", -F.col("block"))).alias("m")).select(F.col("m.voices").alias("voices"), (-F.col("m.col2")).alias("block"))


def memory_projection(per_block: DataFrame, layers: int) -> DataFrame:
    """What holding the busiest block's candidates takes: 24 bytes a layer and
    12 a note-on."""
    return busiest(per_block).select("n", "block", (F.col("n") * (24 * layers + 12)).alias("bytes"))


def levels(signal: DataFrame, block: int) -> DataFrame:
    """(block, rms, peak) of a stereo signal (pos, l, r)."""
    both = signal.selectExpr(f"pos div {block} as block", "l * l + r * r as power", "greatest(abs(l), abs(r)) as top")
    return both.groupBy("block").agg(F.sqrt(F.sum("power") / (2 * F.count("*"))).alias("rms"), F.max("top").alias("peak"))


def null_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compares signals (pos, v) over the positions both have: peak and rms of
    the difference, peak of a, the first position of the worst difference, and
    whether all are identical."""
    both = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), "pos").selectExpr("pos", "x", "abs(x - y) as d")
    worst = F.max(F.struct("d", -F.col("pos")))
    return both.agg(F.max("d").alias("peak_diff"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms_diff"), F.max(F.abs("x")).alias("ref_peak"), (-worst["col2"]).alias("worst_at"), F.bool_and(F.col("d") == 0).alias("identical"))


def finite_guard(signal: DataFrame, value: str = "v") -> DataFrame:
    """(bad, first): how many values aren't finite, and the first position."""
    odd = F.isnan(value) | F.col(value).isin(float("inf"), float("-inf"))
    return signal.agg(F.count_if(odd).alias("bad"), F.min(F.when(odd, F.col("pos"))).alias("first"))


def rate_fit(samples: DataFrame, top: int, budget: int, guard: int = 4, floor: int = 8000) -> DataFrame:
    """The largest of top, top/2, ... at which samples (frames, rate) fit the
    budget of bytes at two a frame, or the first at or below floor."""
    rates = [top]
    while rates[-1] > floor:
        rates.append(rates[-1] // 2)
    tried = samples.select("frames", "rate", F.explode(F.array(*map(F.lit, rates))).alias("pool_rate"))
    need = tried.groupBy("pool_rate").agg((F.sum(F.expr("floor(frames * pool_rate / greatest(rate, 1))") + guard) * 2).cast("long").alias("bytes"))
    return need.filter((F.col("bytes") <= budget) | (F.col("pool_rate") <= floor)).agg(F.max(F.struct("pool_rate", "bytes")).alias("m")).select(F.col("m.pool_rate").cast("long").alias("pool_rate"), F.col("m.bytes").alias("bytes"))
