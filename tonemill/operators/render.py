"""Voices to signal, by two strategies that must agree.

A voice is a row: voice, start (frame), held (frames until its release), step
(source frames a frame), gain_l, gain_r, attack_rate, attack_end, decay_coef,
sustain, release_coef, loop_start, loop_end (no loop if loop_end is null), pcm
(its sample, in -1..1), and b0, b1, a1, a2 of its filter (null b0: none).

While the pool isn't full, voices don't depend on each other. `by_plan` works
out each voice's frames in closed form with array functions and sums them per
frame; it has no filter, which is a recurrence. `by_kernel` steps through
frames in numpy with all voices of a chunk side by side, filter included, and
emits each chunk's sums per block, which Spark adds up.

Defined cases: an empty sample gives silence; a voice without a loop ends with
its sample; a voice that is never released (null held) sounds until its end of
sample or, looped, for ``limit`` frames, which bound no voice that has an end of
its own; a sustain at or below the floor ends with its
decay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-5
LIMIT = 1 << 20
FIELDS = ("start", "held", "step", "gain_l", "gain_r", "attack_rate", "attack_end", "decay_coef", "sustain", "release_coef", "loop_start", "loop_end", "b0", "b1", "a1", "a2")
_CELLS = 2_000_000


def level(n: Column, held: Column) -> Column:
    """The envelope after its n-th advance, n from 1."""
    attack = F.ceil(F.col("attack_end") / F.col("attack_rate"))
    target = F.greatest("sustain", F.lit(FLOOR))
    decay = F.when(target >= 1, F.lit(1)).otherwise(F.ceil(F.log(target) / F.log("decay_coef")))

    def before(m: Column) -> Column:
        falling = F.pow("decay_coef", m - attack)
        return F.when(m < attack, F.least(m * F.col("attack_rate"), F.lit(1.0))).when(m < attack + decay, falling).when(F.col("sustain") <= FLOOR, 0.0).otherwise(F.col("sustain"))

    return F.when(held.isNull() | (n <= held), before(n)).otherwise(F.when(held <= 0, 0.0).otherwise(before(held)) * F.pow("release_coef", n - held))


def frames_of(limit: int) -> Column:
    """Frames that a voice can sound at the most: its own end, or the limit."""
    size = F.size("pcm")
    to_end = F.when(F.col("loop_end").isNull(), F.ceil(F.lit(1.0) * size / F.col("step")))
    released = F.col("held") + F.ceil(F.log(F.lit(FLOOR)) / F.log("release_coef"))
    return F.when(size == 0, 0).otherwise(F.coalesce(F.least(to_end, released), F.lit(limit))).cast("int")


def read_at(place: Column) -> Column:
    """The sample at a place, between neighbours, the loop closed."""
    i = F.floor(place).cast("int")
    after = F.when(F.col("loop_end").isNotNull() & (i + 1 >= F.col("loop_end")), F.col("loop_start")).otherwise(i + 1).cast("int")
    x = lambda k: F.get("pcm", F.least(k, F.size("pcm") - 1))
    return x(i) + (x(after) - x(i)) * (place - i)


def _dealt(voices: DataFrame, frames: int) -> DataFrame:
    """voices in order of start, those that begin within ``frames`` in one task:
    a task's sums then cover its own frames, not all there are."""
    return voices.repartition(F.expr(f"start div {frames}")).sortWithinPartitions("start")


def by_plan(voices: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(frame, l, r) of the mix, in built-in functions only."""
    span = F.col("loop_end") - F.col("loop_start")

    def value(n: Column) -> Column:
        straight = F.col("step") * n
        place = F.when(F.col("loop_end").isNull() | (straight < F.col("loop_end")), straight).otherwise(F.col("loop_start") + F.pmod(straight - F.col("loop_start"), span))
        return read_at(place) * level(n + 1, F.col("held"))

    # Frames are spelled out and worked out in one generated stage, in which the
    # sample isn't copied; as a function over an array they would be interpreted.
    counted = _dealt(voices.withColumn("_n", frames_of(limit)).filter("_n > 0"), 1 << 14).withColumn("pcm", F.col("pcm").cast("array<double>"))
    each = counted.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("y", value(F.col("n"))).filter("y <> 0")
    return each.groupBy((F.col("start") + F.col("n")).alias("frame")).agg(F.sum(F.col("y") * F.col("gain_l")).alias("l"), F.sum(F.col("y") * F.col("gain_r")).alias("r"))


def _chunk(v: pd.DataFrame, limit: int) -> np.ndarray:
    """Outputs before gain of a chunk's voices, a row each."""
    get = lambda n, idle=0.0: v[n].astype(float).fillna(idle).to_numpy()
    sizes = v["pcm"].map(len).to_numpy()
    n_frames = v["_n"].to_numpy()
    pcm = np.zeros((len(v), int(sizes.max()) + 2))
    for row, p in zip(pcm, v["pcm"], strict=True):
        row[: len(p)] = p
        row[len(p) :] = p[-1] if len(p) else 0.0
    held, looped = get("held", np.inf), v["loop_end"].notna().to_numpy()
    loop_start, loop_end = get("loop_start"), get("loop_end", np.inf)
    filtered = v["b0"].notna().to_numpy()
    b0, b1, a1, a2 = get("b0", 1.0), get("b1"), get("a1"), get("a2")
    rate, top, fall, rest, let, step = (get(n) for n in ("attack_rate", "attack_end", "decay_coef", "sustain", "release_coef", "step"))
    everyone = np.arange(len(v))
    amp, stage, place = np.zeros(len(v)), np.zeros(len(v), int), np.zeros(len(v))
    z1, z2 = np.zeros(len(v)), np.zeros(len(v))
    out = np.zeros((len(v), int(n_frames.max())))
    for n in range(out.shape[1]):
        letting = (n + 1 > held) & (stage < 3)
        stage[letting], amp[letting] = 3, np.minimum(amp[letting], 1.0)
        stage[(n >= n_frames) | (~looped & (place >= sizes))] = 4
        up, down, off = stage == 0, stage == 1, stage == 3
        amp[up] += rate[up]
        done = up & (amp >= top)
        stage[done], amp[done] = 1, 1.0
        amp[down] *= fall[down]
        settled = down & (amp <= np.maximum(rest, FLOOR))
        stage[settled] = np.where(rest[settled] <= FLOOR, 4, 2)
        amp[settled] = np.where(rest[settled] <= FLOOR, 0.0, rest[settled])
        amp[off] *= let[off]
        gone = (stage == 4) | (off & (amp <= FLOOR))
        stage[gone], amp[gone] = 4, 0.0
        if gone.all():
            break
        i = np.minimum(place.astype(int), pcm.shape[1] - 2)
        after = np.where(looped & (i + 1 >= loop_end), loop_start, i + 1).astype(int)
        x = pcm[everyone, i]
        x = (x + (pcm[everyone, after] - x) * (place - i)) * np.minimum(amp, 1.0)
        y = b0 * x + z1
        z1, z2 = np.where(filtered, b1 * x - a1 * y + z2, 0), np.where(filtered, b0 * x - a2 * y, 0)
        out[:, n] = np.where(stage == 4, 0.0, np.where(filtered, y, x))
        place = place + step
        over = looped & (place >= loop_end)
        place[over] = loop_start[over] + np.mod(place[over] - loop_start[over], np.maximum(loop_end[over] - loop_start[over], 1))
    return out


def by_kernel(voices: DataFrame, block: int = 4096, limit: int = LIMIT) -> DataFrame:
    """(frame, l, r) of the mix, filters included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("_n", kind="stable").reset_index(drop=True)
            lo = 0
            while lo < len(b):
                hi = lo + 1
                while hi < len(b) and (hi + 1 - lo) * b["_n"].iloc[hi] <= _CELLS:
                    hi += 1
                part = b.iloc[lo:hi]
                sums: dict[int, np.ndarray] = {}
                for y, start, left, right in zip(_chunk(part, limit), part["start"], part["gain_l"], part["gain_r"], strict=True):
                    n = 0
                    while n < len(y):
                        at, inside = divmod(int(start) + n, block)
                        piece = y[n : n + block - inside]
                        mix = sums.setdefault(at, np.zeros((2, block)))
                        mix[0, inside : inside + len(piece)] += piece * left
                        mix[1, inside : inside + len(piece)] += piece * right
                        n += len(piece)
                yield pd.DataFrame({"block": list(sums), "ls": [m[0] for m in sums.values()], "rs": [m[1] for m in sums.values()]})
                lo = hi

    rows = voices.withColumn("_n", frames_of(limit)).filter("_n > 0").select("_n", "pcm", *FIELDS)
    parts = _dealt(rows, 4 * block).mapInPandas(run, "block long, ls array<double>, rs array<double>")
    each = parts.select("block", F.posexplode(F.arrays_zip("ls", "rs")).alias("i", "v")).filter("v.ls <> 0 or v.rs <> 0")
    return each.groupBy((F.col("block") * block + F.col("i")).alias("frame")).agg(F.sum("v.ls").alias("l"), F.sum("v.rs").alias("r"))
