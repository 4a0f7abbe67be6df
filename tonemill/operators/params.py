"""The grid of a bank's envelope and filter constants.

A region's constants vary by key only if an envelope time follows the key, by
velocity only if the cutoff does, and by variant, a channel's five sound
controllers in 64 steps each (`performance.variant_of`). `layout` gives each
region a block of the grid with either dimension collapsed to one entry where
nothing varies along it; blocks are the same in all variants, so that a place
in the grid holds whatever the channel's controllers do. `grid` makes the
entries of the pairs of region and variant that are asked for, never their
whole product; `place` is a hit's entry, without a lookup.

Defined cases: a region whose velocities are none has one entry; velocities
outside a region's go to its nearest entry; regions that nothing asks for take
their places, but no entries; null controllers, keys or velocities have none;
an empty table has an empty grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import numbers
from .blocks import running

#: Keys of a keyboard, the key that stands for all, and what one
#: step of the cutoff and resonance controllers adds in cents and centibels.
KEYS, MIDDLE = 128, 60
CUTOFF_CENTS, RESONANCE_CB = 75.0, 240.0 / 63
#: The controllers of a variant, six bits each from the lowest.
SOUND = ("resonance", "release", "attack", "cutoff", "decay")
#: Regions that one task numbers.
SPAN = 4096


def variant(values: dict[str, Column]) -> Column:
    """One number of the five controllers (0..127, by the names of SOUND)."""
    out = F.lit(0).cast("long")
    for i, name in enumerate(SOUND):
        out = out + F.shiftleft(F.shiftright(values[name].cast("long"), 1), 6 * i)
    return out


def controllers(number: Column) -> dict[str, Column]:
    """The five controllers of a variant, in even steps."""
    return {name: F.shiftright(number, 6 * i).bitwiseAND(63) * 2 for i, name in enumerate(SOUND)}


def layout(regions: DataFrame) -> DataFrame:
    """regions (region, vel_lo, vel_hi, vel_track, key_to_hold, key_to_decay, ...)
    with ``base``, the first place of each one's block, ``vels`` and ``keys``,
    its extents. Places are summed by spans of regions, so none is gathered."""
    by_key = (F.col("key_to_hold") != 0) | (F.col("key_to_decay") != 0)
    span = F.least(F.greatest(F.col("vel_hi") - F.col("vel_lo"), F.lit(0)) + 1, F.lit(128))
    sized = regions.withColumns({
        "keys": F.when(by_key, KEYS).otherwise(1).cast("long"),
        "vels": F.when(F.col("vel_track") != 0, span).otherwise(1).cast("long"),
        "_span": F.floor(F.col("region") / SPAN),
    })
    summed = running(sized, F.col("keys") * F.col("vels"), ["region"], "_end", "_span")
    return summed.withColumn("base", F.col("_end") - F.col("keys") * F.col("vels")).drop("_end", "_span")


def place(key: Column, vel: Column) -> Column:
    """A hit's place, beside the columns of `layout`."""
    vi = F.least(F.greatest(vel - F.col("vel_lo"), F.lit(0)), F.col("vels") - 1)
    ki = F.when(F.col("keys") > 1, key).otherwise(F.when(key.isNotNull(), 0))
    return (F.col("base") + vi * F.col("keys") + ki).cast("long")


def grid(laid: DataFrame, asked: DataFrame, cfg: Config | None = None) -> DataFrame:
    """The entries of the pairs ``asked`` (region, variant): place, region,
    variant, and the constants of envelope and filter per frame. Beside the
    columns that `layout` reads, laid has attack, hold, decay and release in
    seconds, sustain, cutoff in cents and resonance in centibels."""
    cfg = cfg or Config()
    pairs = asked.select("region", "variant").dropna().distinct()
    steps = laid.join(pairs, "region").withColumn("_vi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vels") - 1)))
    cells = steps.withColumn("_ki", F.explode(F.sequence(F.lit(0).cast("long"), F.col("keys") - 1)))
    key = F.when(F.col("keys") > 1, F.col("_ki")).otherwise(MIDDLE)
    vel = F.least(F.col("vel_lo") + F.col("_vi"), F.lit(127))
    cc = controllers(F.col("variant"))
    hold = numbers.key_scaled(F.col("hold"), F.col("key_to_hold"), key)
    base = (numbers.key_scaled(F.col("decay"), F.col("key_to_decay"), key), F.col("release"))
    timed = [numbers.time_controller(t, cc[n]) for t, n in zip((F.col("attack"), *base), ("attack", "decay", "release"), strict=True)]
    even = (cfg.decay_curve == "linear", cfg.release_curve == "linear")
    shape = numbers.envelope(timed[0], hold, timed[1], timed[2], float(cfg.sample_rate), base, even)
    # Without a filter a cutoff stands for it that asks for none.
    cents = F.col("cutoff") + F.col("vel_track") * (vel / 127) + (cc["cutoff"] - 64) * CUTOFF_CENTS if cfg.filter_enabled else F.lit(13_500.0)
    tone = numbers.lowpass(cents, F.col("resonance") + F.greatest(cc["resonance"] - 64, F.lit(0)) * RESONANCE_CB, float(cfg.sample_rate))
    sustain = numbers.clamp(F.col("sustain"), 0.0, 1.0)
    out = shape | {"decay_target": F.greatest(sustain, F.lit(cfg.env_floor)), "sustain": sustain} | tone | {"filtered": tone["b1"] > 0}
    return cells.select((F.col("base") + F.col("_vi") * F.col("keys") + F.col("_ki")).alias("place"), "region", "variant", *[c.alias(n) for n, c in out.items()])


def resolve(hits: DataFrame, laid: DataFrame, cfg: Config | None = None) -> DataFrame:
    """hits (region, variant, key, vel, ...) with their place and constants."""
    entries = grid(laid, hits, cfg)
    placed = hits.join(laid.select("region", "base", "vels", "keys", "vel_lo"), "region").withColumn("place", place(F.col("key"), F.col("vel")))
    return placed.drop("base", "vels", "keys", "vel_lo").join(entries, ["region", "variant", "place"])
