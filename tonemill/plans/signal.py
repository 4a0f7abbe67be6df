"""Limiter, interpolation, filters and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signal
from ..sources.events import read
from .registry import query

_S = "s as (select event_id as pos, value / 100 - 1 as v from events)"
_GR = "case when abs(v) > 0.5 then 0.5 / abs(v) else 1 end"


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id as pos", "value / 100 - 1 as v")


@query(f"with {_S} select pos, max(abs(v)) over (order by pos rows 240 preceding) as top from s")
def sliding_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.sliding_max(_signal(spark, sf_dir), 240)


@query(f"with {_S}, g as (select pos, {_GR} as g from s) select pos, round((sum(g) over w + 65 - count(*) over w) / 65, 6) as gain from g window w as (order by pos rows 64 preceding)")
def moving_avg_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.moving_gain(_signal(spark, sf_dir), 64, 0.5).withColumn("gain", F.round("gain", 6))


@query(f"with {_S} select pos, lag(v, 67, 0.0) over (order by pos) as v from s")
def delay_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.delayed(_signal(spark, sf_dir), 67)


_PEAK = ", ".join("abs(" + " + ".join(f"({c!r})::double * coalesce(lag(v, {i}) over (order by pos), 0)" for i, c in enumerate(row)) + ")" for row in signal.polyphase())


@query(f"with {_S} select pos, round(greatest({_PEAK}), 6) as peak from s")
def true_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.true_peak(_signal(spark, sf_dir)).withColumn("peak", F.round("peak", 6))


@query()
def limiter_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has it as a recursion over all positions only; the tests compare it
    with a loop."""
    req = _signal(spark, sf_dir).select("pos", signal.needed_gain(F.abs("v"), 0.5).alias("req"))
    return signal.release(req, 0.1).withColumn("gain", F.round("gain", 6))


@query("with s as (select event_id as pos, value / 50 - 1 as v from events) select count(*) filter (where abs(v) > 0.9) as clipped, round(max(abs(least(greatest(v, -0.9), 0.9))), 6) as peak from s")
def clamp_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") / 50 - 1
    held = F.abs(F.least(F.greatest(v, F.lit(-0.9)), F.lit(0.9)))
    return read(spark, sf_dir, "events").agg(F.count_if(F.abs(v) > 0.9).alias("clipped"), F.round(F.max(held), 6).alias("peak"))


_AT = "(vec_id % 60) + 0.37"


@query("with t as (select vec_id, embedding as e, cast(vec_id % 60 as integer) as i, 0.37::double as t from embeddings), x as (select vec_id, t, e[greatest(i, 1)]::double as p, e[i + 1]::double as a, e[least(i + 2, 64)]::double as b, e[least(i + 3, 64)]::double as c from t) select vec_id, round(a, 6) as nearest, round(a + (b - a) * t, 6) as linear, round(a + t * ((b - p) * 0.5 + t * (p - a * 2.5 + b * 2 - c * 0.5 + t * ((c - p) * 0.5 + (a - b) * 1.5))), 6) as cubic from x")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nearest, linear, cubic = signal.interpolate(F.col("embedding"), F.col("vec_id") % 60 + F.lit(0.37))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(nearest, 6).alias("nearest"), F.round(linear, 6).alias("linear"), F.round(cubic, 6).alias("cubic"))


@query("with t as (select vec_id, embedding as e, cast(vec_id % 60 as integer) as i, 0.37::double as t, vec_id % 20 as a, vec_id % 20 + 3 + vec_id % 40 as b from embeddings), w as (select *, case when i + 1 >= b then a + (i + 1 - a) % (b - a) else i + 1 end as i1, case when i + 2 >= b then a + (i + 2 - a) % (b - a) else i + 2 end as i2, case when i >= b then a + (i - a) % (b - a) else i end as i0, case when i - 1 >= b then a + (i - 1 - a) % (b - a) else i - 1 end as im from t), x as (select vec_id, t, e[greatest(im + 1, 1)]::double as p, e[i0 + 1]::double as a, e[least(i1 + 1, 64)]::double as b, e[least(i2 + 1, 64)]::double as c from w) select vec_id, round(a, 6) as nearest, round(a + (b - a) * t, 6) as linear, round(a + t * ((b - p) * 0.5 + t * (p - a * 2.5 + b * 2 - c * 0.5 + t * ((c - p) * 0.5 + (a - b) * 1.5))), 6) as cubic from x")
def interpolate_looped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies behind a loop's end is read from its start on."""
    loop = (F.col("vec_id") % 20, F.col("vec_id") % 20 + 3 + F.col("vec_id") % 40)
    nearest, linear, cubic = signal.interpolate(F.col("embedding"), F.col("vec_id") % 60 + F.lit(0.37), loop)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(nearest, 6).alias("nearest"), F.round(linear, 6).alias("linear"), F.round(cubic, 6).alias("cubic"))


@query("with recursive p as (select vec_id, embedding as e, 1 as i, 0.2 * embedding[1]::double as y, 0.4 * embedding[1]::double - (-0.5) * (0.2 * embedding[1]::double) as z1, 0.2 * embedding[1]::double - 0.3 * (0.2 * embedding[1]::double) as z2 from embeddings union all select vec_id, e, i + 1, 0.2 * e[i + 1]::double + z1, 0.4 * e[i + 1]::double + 0.5 * (0.2 * e[i + 1]::double + z1) + z2, 0.2 * e[i + 1]::double - 0.3 * (0.2 * e[i + 1]::double + z1) from p where i < 64) select vec_id, round(sum(y * y), 6) as energy, round(max(case when i = 64 then y end), 6) as last from p group by vec_id")
def biquad_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "embeddings").select("vec_id", signal.biquad(F.col("embedding"), 0.2, 0.4, -0.5, 0.3).alias("y"))
    return out.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v * v), 6).alias("energy"), F.round(F.element_at("y", -1), 6).alias("last"))


@query()
def biquad_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as one signal through a low-pass, block by block; the
    tests compare it with a loop."""
    return signal.biquad_rows(_signal(spark, sf_dir), (0.2, 0.4, -0.5, 0.3)).withColumn("v", F.round("v", 6))


@query("with t as (select vec_id, embedding as e, unnest(range(0, 96)) as i from embeddings), x as (select *, i / 1.5::double as place, cast(floor(i / 1.5::double) as integer) as k from t) select vec_id, cast(i as integer) as i, round(e[k + 1]::double + (e[least(k + 2, 64)]::double - e[k + 1]::double) * (place - k), 6) as v from x")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.resampled(F.col("embedding"), 1.5)).alias("i", "v"))
    return out.withColumn("v", F.round("v", 6))


@query()
def resample_sinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sinc bank, up by 3/2; the tests compare it with loops."""
    pcm = F.transform("embedding", lambda v: F.greatest(F.least(v * 32_767, F.lit(32_767)), F.lit(-32_767)).cast("smallint"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.sinc_resampled(pcm, 1.5)).alias("i", "v"))


@query("with t as (select vec_id, embedding as e, unnest(range(0, 64)) as i from embeddings) select vec_id, cast(i // 2 as integer) as pos, max(case when i % 2 = 0 then e[i + 1] end) as l, max(case when i % 2 = 1 then e[i + 1] end) as r from t group by vec_id, i // 2")
def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even values to the left channel, odd ones to the right."""
    e = read(spark, sf_dir, "embeddings")
    pairs = F.transform(F.sequence(F.lit(0), F.expr("cast(size(embedding) div 2 - 1 as int)")), lambda i: F.struct(i.alias("pos"), F.element_at("embedding", i * 2 + 1).alias("l"), F.element_at("embedding", i * 2 + 2).alias("r")))
    return e.select("vec_id", F.explode(pairs).alias("p")).select("vec_id", "p.pos", "p.l", "p.r")


@query("with t as (select p_partkey as id, p_retailprice as st, p_size * 7 as n, 1000.0::double as a, 1000.0 + p_size * 10.0::double as b from part) select id, round(case when st * n < b then st * n else a + (st * n - a) - floor((st * n - a) / (b - a)) * (b - a) end, 4) as phase from t")
def phase_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "part")
    phase = signal.phase_at(F.col("p_retailprice"), F.col("p_size") * 7, F.lit(1000.0), F.lit(1000.0) + F.col("p_size") * 10.0)
    return t.select(F.col("p_partkey").alias("id"), F.round(phase, 4).alias("phase"))


@query("with t as (select p_partkey as id, 1.0::double / (p_size * 3) as ar, 1.0::double as ae, 0.999::double as dc, 0.05 + p_size / 100.0::double as tg, 0.998::double as rc, p_partkey % 5000 + 1 as h from part), a as (select *, ceil(ae / ar) as att, ceil(ln(tg) / ln(dc)) as d from t), l as (select *, case when h <= att then least(h * ar, 1) when h >= att + d then tg else pow(dc, h - att) end as lv from a) select id, cast(h + greatest(ceil(ln(0.00001 / case when lv <= 0 then 1 else lv end) / ln(rc)), 0) as bigint) as frames from l")
def voice_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "part")
    size = F.col("p_size")
    frames = signal.lifetime(F.lit(1.0) / (size * 3), F.lit(1.0), F.lit(0.999), size / 100 + 0.05, F.lit(0.998), F.col("p_partkey") % 5000 + 1, 0.00001)
    return t.select(F.col("p_partkey").alias("id"), frames.alias("frames"))


@query("with v as (select epoch_us(l_shipdate) // 86400000000 as frame, l_extendedprice / 100000 * l_discount as l, l_extendedprice / 100000 * (1 - l_discount) as r from lineitem) select frame, sum(cast(round(l * 1000000) as bigint))::bigint / 1000000 as l, sum(cast(round(r * 1000000) as bigint))::bigint / 1000000 as r from v group by frame")
def mixdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz)) div 86400000000")
    v = read(spark, sf_dir, "lineitem").select(day.alias("frame"), F.expr("l_extendedprice / 100000 * l_discount").alias("l"), F.expr("l_extendedprice / 100000 * (1 - l_discount)").alias("r"))
    return signal.mixdown(v)


@query("with s as (select event_id as pos, value / 100 - 1 as l, 1 - value / 100 as r, event_id // 256 as block from events), v as (select event_id // 256 as block, count(*) filter (where event_type in ('click', 'view')) as want, count(*) filter (where event_type = 'error') as stolen from events group by 1), m as (select block, round(sqrt(sum(l * l + r * r) / (2 * count(*))), 6) as rms, round(max(greatest(abs(l), abs(r))), 6) as peak from s group by 1) select v.block + 1 as block, want, least(want, 100) as take, stolen, cast(sum(greatest(want - 100, 0)) over (order by v.block) as bigint) as dropped, rms, peak from v join m on v.block = m.block")
def block_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-block metrics, blocks from 1, dropped adding up."""
    from ..operators import blocks

    e = read(spark, sf_dir, "events")
    v = e.groupBy(F.expr("event_id div 256").alias("block")).agg(F.count_if(F.col("event_type").isin("click", "view")).alias("want"), F.count_if(F.col("event_type") == "error").alias("stolen"))
    m = blocks.levels(e.selectExpr("event_id as pos", "value / 100 - 1 as l", "1 - value / 100 as r"), 256)
    both = v.join(m, "block")
    # Two levels: no window holds all blocks.
    both = blocks.running(both.withColumn("span", F.expr("block div 1024")), F.greatest(F.col("want") - 100, F.lit(0)), ["block"], "dropped", "span")
    return both.select((F.col("block") + 1).alias("block"), "want", F.least("want", F.lit(100)).alias("take"), "stolen", "dropped", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))
