"""Signals as rows (pos, ...) and as arrays.

Windows over a long signal are cut into shards of positions: each shard also
gets the rows before it that its frames reach back to, however many shards that
is, so no window spans the whole signal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 65_536


def sharded(signal: DataFrame, back: int, shard: int = SHARD) -> DataFrame:
    """signal with ``shard`` and ``own``: rows also go to each later shard of
    which a row reaches back to them (own is false there)."""
    to = F.sequence(F.floor(F.col("pos") / shard), F.floor((F.col("pos") + back) / shard))
    return signal.withColumn("shard", F.explode(to)).withColumn("own", F.col("shard") == F.floor(F.col("pos") / shard))


def over_back(value: Column, back: int, how, shard: int = SHARD):
    """A window function of a row and the ``back`` rows before it."""
    return how(value).over(Window.partitionBy("shard").orderBy("pos").rowsBetween(-back, 0))


def over_frames(signal: DataFrame, values: dict[str, Column], back: int, how) -> DataFrame:
    """(pos, *values): each value over a row and the ``back`` rows before it, by
    ``how`` (F.max or F.sum), in the same work a row however long ``back`` is.

    Positions are cut into stretches of back + 1 from the first. A frame is the head of one
    stretch, up to its row, and the tail of the one before, from its first row
    on; both are running values, and the tail of a row is sent ``back``
    positions ahead, where it meets the head. Positions follow each other
    without gaps."""
    start = signal.agg(F.min("pos")).first()[0] or 0
    at = F.col("pos") - start
    stretch = F.floor(at / (back + 1))
    held = signal.select("pos", stretch.alias("_s"), *[v.alias(k) for k, v in values.items()])
    w = Window.partitionBy("_s")
    head = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tail = w.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    both = held.select("pos", *[how(k).over(head).alias(f"h_{k}") for k in values], *[how(k).over(tail).alias(f"t_{k}") for k in values])
    # The head of a stretch's last row is the whole frame.
    sent = F.when(at % (back + 1) != 0, F.struct((F.col("pos") + back).alias("pos"), F.lit(False).alias("own"), *[F.col(f"t_{k}").alias(k) for k in values]))
    own = F.struct("pos", F.lit(True).alias("own"), *[F.col(f"h_{k}").alias(k) for k in values])
    each = both.select(F.explode(F.array_compact(F.array(own, sent))).alias("e")).select("e.*")
    met = each.groupBy("pos").agg(F.bool_or("own").alias("own"), *[how(k).alias(k) for k in values])
    return met.filter("own").drop("own")


def sliding_max(signal: DataFrame, back: int) -> DataFrame:
    return over_frames(signal, {"top": F.abs("v")}, back, F.max)


def needed_gain(level: Column, ceiling: float) -> Column:
    return F.when(level > ceiling, F.lit(ceiling) / level).otherwise(1.0)


def moving_gain(signal: DataFrame, back: int, ceiling: float) -> DataFrame:
    """Mean of the needed gain over a row and those before; what lies before
    the signal needs none, a gain of one."""
    sums = over_frames(signal, {"g": needed_gain(F.abs("v"), ceiling), "n": F.lit(1)}, back, F.sum)
    return sums.select("pos", ((F.col("g") + (back + 1 - F.col("n"))) / (back + 1)).alias("gain"))


def delayed(signal: DataFrame, by: int) -> DataFrame:
    """The signal ``by`` positions late, zeros first: a shift of positions, cut
    at the old end."""
    end = signal.agg(F.max("pos").alias("_end"), F.min("pos").alias("_start"))
    moved = signal.select((F.col("pos") + by).alias("pos"), "v").join(F.broadcast(end.select("_end"))).filter("pos <= _end").select("pos", "v")
    zeros = end.select(F.explode(F.expr(f"sequence(_start, least(_start + {by} - 1, _end))")).alias("pos"), F.lit(0.0).alias("v"))
    return moved.unionByName(zeros)


def polyphase(taps: int = 8, phases: int = 4) -> list[list[float]]:
    """Windowed-sinc interpolator for the values between samples, each phase
    normalised to unity gain."""
    out = []
    for p in range(phases):
        row = []
        for t in range(taps):
            x, k, n = t - (taps / 2 - 1) - p / phases, t * phases + p, taps * phases - 1
            window = 0.42 - 0.5 * math.cos(2 * math.pi * k / n) + 0.08 * math.cos(4 * math.pi * k / n)
            row.append(window * (math.sin(math.pi * x) / (math.pi * x) if abs(x) > 1e-12 else 1.0))
        out.append([c / sum(row) for c in row])
    return out


def true_peak(signal: DataFrame, taps: int = 8) -> DataFrame:
    """(pos, peak): the largest magnitude at and between samples."""
    rows = sharded(signal, taps - 1)
    w = Window.partitionBy("shard").orderBy("pos")
    past = [F.coalesce(F.lag("v", i).over(w), F.lit(0.0)) for i in range(taps)]
    lagged = rows.select("pos", "own", *[c.alias(f"_{i}") for i, c in enumerate(past)])
    phases = [F.abs(sum((F.col(f"_{i}") * c for i, c in enumerate(row)), F.lit(0.0))) for row in polyphase(taps)]
    return lagged.filter("own").select("pos", F.greatest(*phases).alias("peak"))


def _through(rows: DataFrame, by: str, order: str, columns: list[str], step: Callable[[float, tuple], float], out: str) -> DataFrame:
    """rows (by, order, g, *columns) with a state from row to row of each
    ``by``, which starts at the g that its rows carry: (by, order, was, g), the
    state before and after each row. Rows are dealt by ``by`` and sorted; a task
    holds a batch and one number."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, g = None, 0.0
        for b in batches:
            was, now = np.empty(len(b)), np.empty(len(b))
            for i, (key, start, *row) in enumerate(zip(*(b[c].tolist() for c in (by, "g", *columns)), strict=True)):
                if key != last:
                    last, g = key, start
                was[i] = g
                now[i] = g = step(g, row)
            yield pd.DataFrame({by: b[by], order: b[order], "was": was, "g": now})

    return rows.repartition(by).sortWithinPartitions(by, order).select(by, order, "g", *columns).mapInPandas(fold, out)


def release(signal: DataFrame, coef: float, block: int = 4096, run: int = 1000) -> DataFrame:
    """(pos, gain): follows ``req`` down at once and up by a share ``coef`` of
    what is missing. A step is g -> min(r, (1 - coef) g + coef r), and such maps
    g -> min(R, A g + B) are closed under composition, so each block's map is
    folded by itself. The maps of ``run`` blocks are composed to one, those of
    ``run`` such runs to one again, until so few are left that one task goes
    through them; start gains are then handed down level by level, and each
    block is gone through from its own. Every row is visited twice."""
    a = 1 - coef
    blocks = signal.select("pos", "req", F.expr(f"pos div {block}").alias("block"))
    one = F.struct(F.lit(float("inf")).alias("r"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    fold = lambda m, r: F.struct(F.least(r, m["r"] * a + r * coef).alias("r"), (m["a"] * a).alias("a"), (m["b"] * a + r * coef).alias("b"))
    then = lambda m, n: F.struct(F.least(n["r"], n["a"] * m["r"] + n["b"]).alias("r"), (n["a"] * m["a"]).alias("a"), (n["a"] * m["b"] + n["b"]).alias("b"))
    arrays = blocks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "req"))).alias("xs"))
    levels = [arrays.select("block", F.aggregate("xs", one, lambda m, x: fold(m, x["req"])).alias("m"))]
    low, high = signal.agg(F.min("pos"), F.max("pos")).first()
    width = block
    while low is not None and high // width - low // width >= run:
        runs = levels[-1].groupBy(F.expr(f"block div {run}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("ms"))
        levels.append(runs.select("block", F.aggregate("ms", one, lambda m, x: then(m, x["m"])).alias("m")))
        width *= run
    starts = None
    for maps in reversed(levels):
        each = maps.select("block", "m.*").withColumn("run", F.lit(0).cast("long") if starts is None else F.expr(f"block div {run}"))
        entered = each.withColumn("g", F.lit(1.0)) if starts is None else each.join(starts.select(F.col("block").alias("run"), "g"), "run")
        done = _through(entered, "run", "block", ["r", "a", "b"], lambda g, m: min(m[0], m[1] * g + m[2]), "run long, block long, was double, g double")
        starts = done.select("block", F.col("was").alias("g"))
    done = _through(blocks.join(starts, "block"), "block", "pos", ["req"], lambda g, x: min(x[0], a * g + coef * x[0]), "block long, pos long, was double, g double")
    return done.select("pos", F.col("g").alias("gain"))


def interpolate(buffer: Column, at: Column, loop: tuple[Column, Column] | None = None) -> tuple[Column, Column, Column]:
    """Nearest, linear and cubic reading of an array at a fractional index, its
    ends held; with a loop (start, end), what lies at its end or behind is read
    from its start on."""
    i, last = F.floor(at).cast("int"), F.size(buffer)

    def x(k: int) -> Column:
        place = i + k
        if loop is not None:
            start, end = loop
            place = F.when(place >= end, start + F.pmod(place - start, F.greatest(end - start, F.lit(1)))).otherwise(place)
        return F.element_at(buffer, F.greatest(F.least(place + 1, last), F.lit(1)).cast("int")).cast("double")

    t = at - i
    linear = x(0) + (x(1) - x(0)) * t
    c1, c2, c3 = (x(1) - x(-1)) * 0.5, x(-1) - x(0) * 2.5 + x(1) * 2 - x(2) * 0.5, (x(2) - x(-1)) * 0.5 + (x(0) - x(1)) * 1.5
    return x(0), linear, x(0) + t * (c1 + t * (c2 + t * c3))


#: Samples of an array that are filtered by one product.
_SPAN = 256


def biquad_maps(b0: float, b1: float, a1: float, a2: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What n samples x make of the state z of a two-pole low-pass, as matrices:
    outputs y = T x + G z, and the state after them M z + N x."""
    step = np.array([[-a1, 1.0], [-a2, 0.0]])  # z after a sample of 0
    enter = np.array([b1 - a1 * b0, b0 - a2 * b0])  # what a sample adds to it
    powers = np.empty((n + 1, 2, 2))
    powers[0] = np.eye(2)
    for i in range(n):
        powers[i + 1] = step @ powers[i]
    answer = np.r_[b0, powers[: n - 1, 0] @ enter] if n else np.zeros(0)
    lag = np.arange(n)[:, None] - np.arange(n)[None, :]
    t = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0) if n else np.zeros((0, 0))
    return t, powers[:n, 0], powers[n], (powers[:n][::-1] @ enter).T


def biquad_run(x: np.ndarray, coefs: tuple[float, float, float, float], z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(outputs, state after) of x from state z: spans are filtered from rest all
    at once, then the states between them are handed on."""
    whole = len(x) // _SPAN * _SPAN
    y = np.empty(len(x))
    t, g, m, n = biquad_maps(*coefs, _SPAN)
    spans = x[:whole].reshape(-1, _SPAN)
    added = spans @ n.T
    starts = np.empty((len(spans), 2))
    for i, a in enumerate(added):
        starts[i] = z
        z = m @ z + a
    y[:whole] = (spans @ t.T + starts @ g.T).ravel()
    t, g, m, n = biquad_maps(*coefs, len(x) - whole)
    rest = x[whole:]
    y[whole:] = t @ rest + g @ z
    return y, m @ z + n @ rest


def biquad(buffer: Column, b0: float, b1: float, a1: float, a2: float) -> Column:
    """An array through a two-pole low-pass (b2 is b0), from rest, in time
    linear in its length; null stays null, a null entry counts as 0."""

    @F.pandas_udf("array<double>")
    def filtered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for buffers in batches:
            yield pd.Series([None if b is None else biquad_run(np.nan_to_num(np.asarray(b, float)), (b0, b1, a1, a2), np.zeros(2))[0] for b in buffers], dtype=object)

    return filtered(buffer.cast("array<double>"))


def biquad_rows(signal: DataFrame, coefs: tuple[float, float, float, float], block: int = 4096) -> DataFrame:
    """(pos, v) of a signal of any length through the same filter. A block's
    effect on the two numbers of state is an affine map whose matrix depends on
    its length alone; what it adds is worked out by each block from rest, one row
    a block is gone through in order, and every block is filtered from its own
    start. Positions follow each other without gaps."""
    rows = signal.select(F.expr(f"pos div {block}").alias("block"), "pos", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    arrays = rows.groupBy("block").agg(F.min("pos").alias("pos"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("xs"))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [biquad_run(np.asarray(x), coefs, np.zeros(2))[1] for x in b["xs"]]
            yield pd.DataFrame({"block": b["block"], "n": b["xs"].map(len), "z1": [z[0] for z in ends], "z2": [z[1] for z in ends]})

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, by_length = np.zeros(2), {}
        for b in batches:
            starts = np.empty((len(b), 2))
            for i, (n, *end) in enumerate(zip(b["n"], b["z1"], b["z2"], strict=True)):
                starts[i] = z
                if n not in by_length:
                    by_length[n] = np.linalg.matrix_power(np.array([[-coefs[2], 1.0], [-coefs[3], 0.0]]), n)
                z = by_length[n] @ z + end
            yield pd.DataFrame({"block": b["block"], "z1": starts[:, 0], "z2": starts[:, 1]})

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"pos": b["pos"], "ys": [biquad_run(np.asarray(x), coefs, np.array([p, q]))[0] for x, p, q in zip(b["xs"], b["z1"], b["z2"], strict=True)]})

    ends = arrays.select("block", "xs").mapInPandas(added, "block long, n long, z1 double, z2 double")
    starts = ends.repartition(1).sortWithinPartitions("block").mapInPandas(states, "block long, z1 double, z2 double")
    out = arrays.join(starts, "block").select("pos", "xs", "z1", "z2").mapInPandas(filtered, "pos long, ys array<double>")
    return out.select("pos", F.posexplode("ys").alias("i", "v")).select((F.col("pos") + F.col("i")).alias("pos"), "v")


def resampled(buffer: Column, ratio: float) -> Column:
    """An array at ``ratio`` times its rate, read linearly, ends held."""
    n = F.round(F.size(buffer) * ratio).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: interpolate(buffer, i / ratio)[1])


#: The sinc bank.
TAPS, PHASES = 32, 512


def sinc_bank(ratio: float) -> np.ndarray:
    """PHASES x TAPS coefficients: Blackman-windowed sinc, each phase of unity
    gain at DC; below a ratio of 1 the cutoff moves down with it."""
    cutoff = min(ratio, 1.0) * 0.95
    frac, k = np.arange(PHASES)[:, None] / PHASES, np.arange(TAPS)[None, :]
    t = np.clip((k - frac + 1) / TAPS, 0, 1)
    window = 0.42 - 0.5 * np.cos(2 * np.pi * t) + 0.08 * np.cos(4 * np.pi * t)
    v = np.sinc((k - TAPS / 2 + 1 - frac) * cutoff) * cutoff * window
    return v.astype(np.float32) * (1 / v.sum(1, keepdims=True)).astype(np.float32)


def sinc_resample(samples: np.ndarray, ratio: float, bank: np.ndarray) -> np.ndarray:
    """16-bit samples at ``ratio`` times their rate, in 32-bit sums, truncated."""
    n = len(samples)
    if not n or abs(ratio - 1) < 1e-12:
        return samples.astype(np.int16)
    t = np.arange(max(math.floor(n * ratio + 0.5), 1)) * (1 / ratio)
    i = np.floor(t).astype(np.int64)
    phase = np.minimum(((t - i) * PHASES).astype(np.int64), PHASES - 1)
    total, x = np.zeros(len(t), np.float32), samples.astype(np.float32)
    for k in range(TAPS):
        total += bank[phase, k] * x[np.clip(i - TAPS // 2 + 1 + k, 0, n - 1)]
    return np.clip(total, -32768, 32767).astype(np.int16)


def sinc_resampled(buffer: Column, ratio: float) -> Column:
    """An array of 16-bit samples at ``ratio`` times its rate through the sinc
    bank, which low-passes on the way down; its ends are held, null stays."""

    @F.pandas_udf("array<smallint>")
    def resample(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bank = sinc_bank(ratio)
        for buffers in batches:
            yield pd.Series([None if b is None else sinc_resample(np.asarray(b), ratio, bank) for b in buffers], dtype=object)

    return resample(buffer.cast("array<smallint>"))


def phase_at(step: Column, frames: Column, loop_start: Column, loop_end: Column) -> Column:
    """Where a voice reads after ``frames`` at a constant step, wrapped into its
    loop: no frame needs the one before."""
    to = step * frames
    return F.when(to < loop_end, to).otherwise(loop_start + F.pmod(to - loop_start, loop_end - loop_start))


def lifetime(attack_rate: Column, attack_end: Column, decay_coef: Column, target: Column, release_coef: Column, held: Column, floor: float) -> Column:
    """Frames a voice sounds if it is held for ``held`` frames: attack, decay to
    the target, sustain, then release down to the floor, in closed form."""
    attack = F.ceil(attack_end / attack_rate)
    decay = F.ceil(F.log(target) / F.log(decay_coef))
    level = F.when(held <= attack, F.least(held * attack_rate, F.lit(1.0))).when(held >= attack + decay, target).otherwise(F.pow(decay_coef, held - attack))
    return (held + F.greatest(F.ceil(F.log(F.lit(floor) / level) / F.log(release_coef)), F.lit(0))).cast("long")


def mixdown(voices: DataFrame) -> DataFrame:
    """(frame, l, r): sums over voices (frame, l, r), in whole millionths, which
    no order of adding changes."""
    micro = lambda c: F.sum(F.round(F.col(c) * 1_000_000).cast("long")) / 1_000_000
    return voices.groupBy("frame").agg(micro("l").alias("l"), micro("r").alias("r"))
