"""Zone dimensions: banded lookups, fallbacks, inheritance and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(zones: DataFrame) -> DataFrame:
    """A row per key of each zone's band (at most 128), so that a band lookup is
    an equal join."""
    low, high = F.greatest("key_lo", F.lit(0)), F.least("key_hi", F.lit(127))
    return zones.filter(low <= high).withColumn("key", F.explode(F.sequence(low, high)))


def lookup(hits: DataFrame, zones: DataFrame, order: str, layers: int, hit_key: list[str]) -> DataFrame:
    """The first ``layers`` zones by ``order`` that hold each hit's preset, key
    and velocity. Hits that ask alike are looked up once. Zones of one band hold
    the same hits, so only the first ``layers`` of each are spelled out by key;
    the size of what is spelled out can't be foreseen, so it is never broadcast."""
    asked = hits.select("preset", "key", "vel").distinct()
    band = Window.partitionBy("preset", "key_lo", "key_hi", "vel_lo", "vel_hi").orderBy(order)
    first_of = zones.withColumn("_n", F.row_number().over(band)).filter(F.col("_n") <= layers).drop("_n")
    found = asked.join(by_key(first_of).hint("merge"), ["preset", "key"]).filter(F.col("vel").between(F.col("vel_lo"), F.col("vel_hi")))
    w = Window.partitionBy("preset", "key", "vel").orderBy(order)
    first = found.withColumn("layer", F.row_number().over(w)).filter(F.col("layer") <= layers).select("preset", "key", "vel", order, "layer")
    return hits.join(first, ["preset", "key", "vel"]).select(*hit_key, order, "layer")


def with_fallback(hits: DataFrame, presets: DataFrame, drum_bank: int = 128) -> DataFrame:
    """hits (bank, program) with ``preset``: the exact one, else bank 0's of that
    program, else the drum bank's first if drums were asked for, else the first
    of all. presets is (bank, program, preset). Only what the number of programs
    bounds is marked for broadcast."""
    exact = presets.groupBy("bank", "program").agg(F.min("preset").alias("_exact"))
    common = F.broadcast(presets.filter("bank = 0").groupBy("program").agg(F.min("preset").alias("_common")))
    lone = F.broadcast(presets.agg(F.min(F.when(F.col("bank") == drum_bank, F.col("preset"))).alias("_drum"), F.min("preset").alias("_first")))
    all_ = hits.join(exact, ["bank", "program"], "left").join(common, "program", "left").join(lone)
    found = F.coalesce("_exact", "_common", F.when(F.col("bank") == drum_bank, F.col("_drum")), "_first")
    return all_.withColumn("preset", found).drop("_exact", "_common", "_drum", "_first")


def intersect(lo: Column, hi: Column, lo2: Column, hi2: Column) -> tuple[Column, Column]:
    """Overlap of two ranges given in either order; empty if low > high."""
    a, b, c, d = F.least(lo, hi), F.greatest(lo, hi), F.least(lo2, hi2), F.greatest(lo2, hi2)
    return F.greatest(a, c), F.least(b, d)


#: Zones of one band that are kept in one row.
CHUNK = 512


def _banded(zones: DataFrame, name: str) -> DataFrame:
    """(instrument, key_lo, key_hi, name): the other columns of up to CHUNK zones
    of a band as an array."""
    band = ["instrument", "key_lo", "key_hi"]
    place = F.row_number().over(Window.partitionBy(*band).orderBy(F.lit(0)))
    numbered = zones.withColumn("_n", place).withColumn("_part", F.expr(f"(_n - 1) div {CHUNK}"))
    return numbered.groupBy(*band, "_part").agg(F.collect_list(F.struct(*[c for c in zones.columns if c not in band])).alias(name)).drop("_part")


def flatten(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Preset zones joined to their instrument's zones where their key ranges
    meet; both have instrument, key_lo and key_hi. Bands meet first, a part of
    their zones a row; pairs of zones are spelled out last, as there may be as
    many as the product of an instrument's zones."""
    o = _banded(outer, "_outer")
    i = _banded(inner.select("instrument", "zone", "key_lo", "key_hi"), "_inner").withColumnsRenamed({"key_lo": "_lo", "key_hi": "_hi"})
    lo, hi = intersect(F.col("key_lo"), F.col("key_hi"), F.col("_lo"), F.col("_hi"))
    met = o.join(i, "instrument").withColumns({"low": lo, "high": hi}).filter("low <= high")
    # Instruments are few and may be large; pairs of bands spread evenly.
    spread = met.repartition("instrument", "key_lo", "key_hi", "_lo", "_hi")
    each = spread.withColumn("_o", F.explode("_outer")).withColumn("_i", F.explode("_inner"))
    return each.select(*[F.col(c) if c in ("instrument", "key_lo", "key_hi") else F.col(f"_o.{c}") for c in outer.columns], "_i.zone", "low", "high")


def layered(default: Column, overrides: list[Column], offset: Column, bits: int = 16) -> Column:
    """The last override that is set, else the default, plus an offset that
    saturates at the signed range."""
    base = F.coalesce(*reversed(overrides), default)
    top = (1 << bits - 1) - 1
    return F.least(F.greatest(base + F.coalesce(offset, F.lit(0)), F.lit(-top - 1)), F.lit(top))


def sounds(length: Column, ratio: Column) -> Column:
    """Whether a region's voice exists: its sample has frames and its step is a
    positive number."""
    return F.coalesce((length > 0) & (ratio > 0) & ~F.isnan(ratio) & (ratio < float("inf")), F.lit(False))


def addressed(length: Column, loop: tuple[Column, Column], offsets: tuple[Column, Column, Column, Column], ratio: Column) -> dict[str, Column]:
    """Where a region reads its sample of ``length`` frames: offsets of start,
    end, loop start and loop end are in frames of the source, of which the held
    sample has ``ratio`` times as many; all are held inside what is left."""
    move = lambda v: F.round(v * ratio).cast("long")
    held = lambda v, low, high: F.greatest(F.lit(low), F.least(v, high)).cast("long")
    start, end, loop_start, loop_end = map(move, offsets)
    last = held(length + end, 1, length)
    return {"start": held(start, 0, length - 1), "length": last, "loop_start": held(loop[0] + loop_start, 0, last - 1), "loop_end": held(loop[1] + loop_end, 0, last)}


def inherit(rows: DataFrame, opcodes: list[str]) -> DataFrame:
    """Region rows with each opcode from the nearest header that sets it. rows
    is (file, line, header, one column per opcode): a global header ends master
    and group, a master ends group, and a header replaces all of its level."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    level = {"global": ("global",), "master": ("global", "master"), "group": ("global", "master", "group")}
    out = rows
    for name, enders in level.items():
        start = F.last(F.when(F.col("header").isin(*enders), F.struct("line", "header", *opcodes)), ignorenulls=True).over(w)
        out = out.withColumn(f"_{name}", start)
    pick = lambda op: F.coalesce(F.col(op), *[F.when(F.col(f"_{lv}.header") == lv, F.col(f"_{lv}.{op}")) for lv in ("group", "master", "global")])
    return out.filter("header = 'region'").select("file", "line", *[pick(op).alias(op) for op in opcodes])


NOTES = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}


def note_number(name: Column) -> Column:
    """c4 is 60, c-1 is 0; sharps, flats and plain numbers are read, else null."""
    text = F.lower(F.trim(name))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv]), F.regexp_extract(text, "^([a-g])", 1))
    sign = F.regexp_extract(text, "^[a-g]([#b]?)-?[0-9]+$", 1)
    octave = F.regexp_extract(text, "^[a-g][#b]?(-?[0-9]+)$", 1)
    named = base + F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0) + (octave.try_cast("int") + 1) * 12
    plain = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.coalesce(F.when(text.rlike("^[a-g][#b]?-?[0-9]+$"), named), plain).cast("long")


def key_values(text: Column) -> Column:
    """Array of (name, value) of ``name=value`` pairs; a value may hold spaces
    and ends where the next name begins; // begins a comment."""
    plain = F.regexp_replace(text, "(?m)//.*$", "")
    pairs = F.regexp_extract_all(plain, F.lit("[A-Za-z_0-9]+=.*?(?=\\s+[A-Za-z_0-9]+=|\\s*$)"), 0)
    return F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("name"), F.trim(p.substr(F.instr(p, "=") + 1, F.length(p))).alias("value")))
