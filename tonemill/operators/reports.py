"""Reports over files and runs: what a render will take, whether two agree.

Defined cases: reports of empty tables have one row of zeros and nulls; signals
of different lengths are compared as far as both reach; a difference of zero is
minus infinity decibels, which is below any threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numbers import decibels
from . import blocks

#: Bytes a candidate layer and a note-on hold, the block below
#: which none is advised, and the bytes from which a narrower one is.
SPAN = 1024  # blocks that one task sums
LAYER_BYTES, NOTE_BYTES, LEAST_BLOCK, COMFORTABLE = 24, 12, 128, 2 << 30


def null_report(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """`blocks.null_diff` of signals (pos, v), and in decibels, with how many
    positions were compared and whether the peak of the difference is at or
    below the threshold."""
    both = a.select("pos").join(b.select("pos"), "pos").agg(F.count("*").alias("compared"))
    found = blocks.null_diff(a, b).crossJoin(both)  # one row each
    db = {c.replace("_diff", "_db"): decibels(F.col(c)) for c in ("peak_diff", "rms_diff", "ref_peak")}
    out = found.withColumns({"peak_db": db["peak_db"], "rms_db": db["rms_db"], "ref_db": decibels(F.col("ref_peak"))})
    return out.withColumn("passed", F.col("peak_db") <= threshold)


def narrower_block(notes: Column, block: int, layers: int, comfortable: int = COMFORTABLE) -> tuple[Column, Column]:
    """(block, bytes): the widest of block, block / 2, ... whose busiest block's
    notes, taken to thin out evenly, stay comfortable in memory, or the least."""
    need = notes * (LAYER_BYTES * layers + NOTE_BYTES)
    halves = [block]
    while halves[-1] > LEAST_BLOCK:
        halves.append(halves[-1] // 2)
    fitting = F.filter(F.array(*map(F.lit, halves)), lambda h: F.floor(need / F.floor(F.lit(block) / h)) <= comfortable)
    chosen = F.coalesce(F.get(fitting, F.lit(0)), F.lit(halves[-1]))
    return chosen.cast("long"), F.floor(need / F.floor(F.lit(block) / chosen)).cast("long")


def file_report(ev: DataFrame, block: int, layers: int, width: int, rate: float) -> DataFrame:
    """One row on an event log (kind, block): events of each kind, the busiest
    block with its start in seconds and what holding it takes, the narrower
    block that is advised, and the most voices in ``width`` blocks on end."""
    per = blocks.density(ev)
    kinds = ev.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("note_on", "note_off", "controller")])
    busy = blocks.busiest(per).select(F.col("n").alias("busiest"), (F.col("block") * block / rate).alias("busiest_at"))
    chosen, held = narrower_block(F.col("busiest"), block, layers)
    busy = busy.withColumns({"bytes": F.col("busiest") * (LAYER_BYTES * layers + NOTE_BYTES), "advised": chosen, "advised_bytes": held})
    peak = blocks.peak_concurrency(per, width).select((F.col("voices") * layers).alias("voices"), (F.col("block") * block / rate).alias("voices_at"))
    return kinds.crossJoin(busy).crossJoin(peak)  # one row each


def block_rows(pool: DataFrame, signal: DataFrame, frames: int, rate: float) -> DataFrame:
    """A row for each block of a run: block (from 1), t (seconds rendered by its
    end), live, want, take, stolen, dropped (so far), rms, peak, want_e, take_e.
    ``pool`` is one shard of `folds.pool_fold`, ``signal`` (pos, l, r) what
    leaves the limiter; blocks without candidates count as such."""
    level = blocks.levels(signal, frames)
    idle = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = level.join(pool, "block", "left").select("block", "rms", "peak", F.expr(f"block div {SPAN}").alias("span"), *map(idle, ("alive", "want", "take", "stolen", "dropped", "want_e", "take_e")))
    summed = blocks.running(both, F.col("dropped"), ["block"], "so_far", "span")
    return summed.select((F.col("block") + 1).alias("block"), ((F.col("block") + 1) * (frames / rate)).alias("t"), F.col("alive").alias("live"), "want", "take", "stolen", F.col("so_far").alias("dropped"), "rms", "peak", "want_e", "take_e")


def run_totals(ev: DataFrame, done: dict[str, DataFrame], ceiling: float = 1.0) -> DataFrame:
    """One row on a run of `performance.perform`: notes, voices (queued), taken,
    peak_live (at a block's end), stolen, dropped, cut (alive behind the tail),
    frames, peak, and clipped_percent, the share of samples above ``ceiling``."""
    notes = ev.agg(F.count_if(F.col("kind") == "note_on").alias("notes"))
    pool = done["blocks"].agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("want", "voices"), ("take", "taken"), ("stolen", "stolen"))], F.coalesce(F.max("alive"), F.lit(0)).alias("peak_live"))
    loud = [F.greatest(F.abs("l"), F.abs("r")), F.count_if(F.abs("l") > ceiling) + F.count_if(F.abs("r") > ceiling)]
    mix = done["mix"].agg(F.count("*").alias("frames"), F.coalesce(F.max(loud[0]), F.lit(0.0)).alias("peak"), F.coalesce(loud[1] * 50.0 / F.count("*"), F.lit(0.0)).alias("clipped_percent"))
    cut = done["tail"].agg(F.count("*").alias("cut"))
    both = notes.crossJoin(pool).crossJoin(mix).crossJoin(cut)  # one row each
    return both.withColumn("dropped", F.col("voices") - F.col("taken"))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds its number of rows and ``metrics`` once
    an action has run; a listener gets them in streams, too, after each batch."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]), seen
