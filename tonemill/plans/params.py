"""The grid of envelope and filter constants, over supplier and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import params
from ..sources.events import read
from .registry import query

# Regions of which a fourth follows velocity and a third the key; seven variants.
_REGION = (
    "s_suppkey as region", "s_suppkey % 100 as vel_lo", "s_suppkey % 100 + s_nationkey as vel_hi", "case when s_suppkey % 4 = 1 then s_nationkey * 100 else 0 end as vel_track",
    "case when s_suppkey % 6 = 0 then s_nationkey - 12 else 0 end as key_to_hold", "case when s_suppkey % 5 = 0 then 25 else 0 end as key_to_decay", "s_nationkey / 16.0e0 as attack", "s_suppkey % 7 / 16.0e0 as hold",
    "s_suppkey % 90 / 16.0e0 as decay", "s_suppkey % 11 / 16.0e0 as sustain", "s_nationkey / 16.0e0 as release", "6000 + s_suppkey % 80 * 100 as cutoff", "s_suppkey % 30 * 10 as resonance",
)
_SOUND = {"resonance": "60 + l_linenumber * 2", "release": "56 + l_linenumber * 2", "attack": "70 - l_linenumber * 2", "cutoff": "62 + l_linenumber % 3 * 2", "decay": "58 + l_linenumber * 2"}
_CC = ", ".join(f"{v} as c_{k}" for k, v in _SOUND.items())
_NUMBER = " + ".join(f"({v}) // 2 * {1 << 6 * i}" for i, v in enumerate(_SOUND.values()))
_TIMED = "{t} * case when c_{c} <= 64 then pow(2, (c_{c} - 64) / 8.0::double) else 1 end + case when c_{c} > 64 then 6e-5 * pow(c_{c} - 64, 3) else 0 end"
_GRID = f"""r as (select {", ".join(_REGION)} from supplier),
 z as (select *, case when key_to_hold <> 0 or key_to_decay <> 0 then 128 else 1 end as keys, case when vel_track <> 0 then least(vel_hi - vel_lo + 1, 128) else 1 end as vels from r),
 y as (select *, sum(keys * vels) over (order by region) - keys * vels as base from z),
 a as (select distinct l_suppkey as region, l_linenumber from lineitem),
 v as (select region, {_NUMBER} as variant, {_CC} from a),
 x as (select *, unnest(range(0, vels)) as vi from y join v using (region)),
 w as (select *, unnest(range(0, keys)) as ki from x),
 k as (select *, case when keys > 1 then ki else 60 end as key, least(vel_lo + vi, 127) as vel from w),
 s as (select *, hold * pow(2, key_to_hold * (60 - key) / 1200.0::double) as h, decay * pow(2, key_to_decay * (60 - key) / 1200.0::double) as d0 from k),
 t as (select *, {_TIMED.format(t="attack", c="attack")} as ta, greatest({_TIMED.format(t="d0", c="decay")}, least(d0, 0.004)) * 48000 as td, greatest({_TIMED.format(t="release", c="release")}, least(release, 0.004)) * 48000 as tr,
 cutoff + vel_track * (vel / 127.0::double) + (c_cutoff - 64) * 75.0::double as cents, greatest(pow(10, ((resonance + greatest(c_resonance - 64, 0) * 240.0::double / 63) / 10 - 3.01) / 20), 0.001) as q from s),
 u as (select *, case when ta * 48000 < 1 then 1 else 1 / (ta * 48000) end as up, 8.176 * pow(2, cents / 1200) as hz from t),
 f as (select *, cents < 13500 and hz > 20 and hz < 48000 * 0.49 as filtered, least(greatest(hz / 48000, 1e-5), 0.49) * 2 * pi() as om from u),
 g as (select cast(base + vi * keys + ki as bigint) as place, region, cast(variant as bigint) as variant, round(up, 9) as attack_rate, round(1 + h * 48000 * up, 6) as attack_end, round(pow(10, -5 / greatest(td, 1)), 9) as decay_coef, round(pow(10, -5 / greatest(tr, 1)), 9) as release_coef,
 round(greatest(least(sustain, 1), 1e-5), 9) as decay_target, round(case when filtered then sqrt(sqrt(0.5) / q) * (1 - cos(om)) / 2 / (1 + sin(om) / (2 * q)) else 1 end, 6) as b0, round(case when filtered then -2 * cos(om) / (1 + sin(om) / (2 * q)) else 0 end, 6) as a1, filtered from f)"""
_DIGITS = {"attack_rate": 9, "attack_end": 6, "decay_coef": 9, "release_coef": 9, "decay_target": 9, "b0": 6, "a1": 6}


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.layout(read(spark, sf_dir, "supplier").selectExpr(*_REGION))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    number = params.variant({k: F.expr(v) for k, v in _SOUND.items()})
    return lines.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("region"), number.alias("variant"), (F.col("l_orderkey") % 128).alias("key"), F.col("l_quantity").cast("int").alias("vel"))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, n).alias(c) for c, n in _DIGITS.items()], "filtered")


@query(f"with {_GRID} select * from g")
def params_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry that some hit's region and variant have."""
    return _rounded(params.grid(_laid(spark, sf_dir), _hits(spark, sf_dir)), "place", "region", "variant")


@query(
    f"with {_GRID}, hit as (select l_orderkey, l_linenumber, l_suppkey as region, {_NUMBER} as variant, l_orderkey % 128 as key, cast(l_quantity as integer) as vel from lineitem),"
    " p as (select l_orderkey, l_linenumber, region, variant, base + least(greatest(vel - vel_lo, 0), vels - 1) * keys + case when keys > 1 then key else 0 end as place from hit join y using (region))"
    " select l_orderkey, l_linenumber, p.place::bigint as place, attack_rate, attack_end, decay_coef, release_coef, decay_target, b0, a1, filtered from p join g on p.region = g.region and p.variant = g.variant and p.place = g.place"
)
def params_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its place in the grid and what stands there."""
    return _rounded(params.resolve(_hits(spark, sf_dir), _laid(spark, sf_dir)), "l_orderkey", "l_linenumber", "place")
