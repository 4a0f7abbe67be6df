"""Scalar functions over table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as n
from ..sources.events import events, read
from .registry import CAND, EV, query


def _r(**cols) -> list:
    return [F.round(c, 6).alias(k) for k, c in cols.items()]


@query(f"with {EV}, t as (select seq, k * 200.0 - 15000 as tc, k * 130.0 as cents, k * 9.0 as cb from ev) select seq, round(case when tc <= -12000 then 0 else pow(2, tc / 1200) end, 6) as seconds, round(8.176 * pow(2, cents / 1200), 6) as hz, round(pow(10, -cb / 200), 6) as gain from t")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).selectExpr("seq", "k * 200.0D - 15000 as tc", "k * 130.0D as cents", "k * 9.0D as cb")
    return t.select("seq", *_r(seconds=n.timecents_to_seconds(F.col("tc")), hz=n.cents_to_hz(F.col("cents")), gain=n.centibels_to_gain(F.col("cb"))))


@query(f"with {EV}, t as (select seq, greatest(vel, 1) / 127.0::double as v, least(greatest(k * 3.0::double - 150, -100), 100) / 100 as t from ev), g as (select seq, case when t >= 0 then 1 - t * (1 - v * v) else 1 + t * v * v end as g from t) select seq, round(case when g <= 0 then 960 else least(greatest(-200 * log10(case when g <= 0 then 1 else g end), 0), 960) end, 6) + 0.0 as cb from g")
def velocity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", *_r(cb=n.velocity_attenuation(F.col("vel"), F.col("k") * 3.0 - 150)))


@query(f"with {EV} select seq, round(pow(2, ((note - 60) * 100 + k - 50) / 1200.0::double) * 44100 / 48000, 6) as ratio from ev")
def pitch_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", *_r(ratio=n.pitch_ratio(F.col("note"), F.lit(60), F.lit(100), F.col("k") - 50, 44100 / 48000)))


_FINE = "t as (select *, slot % 3 * 40 as lv, slot % 5 * 25 as le, case when k = 64 then slot % 2 else slot % 7 * 18 end as lp from ev), c as (select seq, k, lp, case when lv = 0 then vel / 127.0::double else (vel * 128 + lv) / 16383.0::double end as v, case when le = 0 then note / 127.0::double else (note * 128 + le) / 16383.0::double end as e, case when lp = 0 then k / 127.0::double else (k * 128 + lp) / 16383.0::double end as p, ch * 8 / 254.0::double as s from t)"


@query(f"with {EV}, {_FINE} select seq, round(v * v * e * e * (1 - s) * case when k = 64 and lp = 0 then 1 else cos(p * pi() / 2) * sqrt(2) end, 6) as l, round(v * v * e * e * (1 - s) * case when k = 64 and lp = 0 then 1 else sin(p * pi() / 2) * sqrt(2) end, 6) as r from c")
def channel_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse values with fine halves, which are 0 for some."""
    fine = (F.col("slot") % 3 * 40, F.col("slot") % 5 * 25, F.when(F.col("k") == 64, F.col("slot") % 2).otherwise(F.col("slot") % 7 * 18))
    left, right = n.channel_gains(F.col("vel"), F.col("note"), F.col("k"), F.col("ch") * 8, fine)
    return events(spark, sf_dir).select("seq", *_r(l=left, r=right))


@query(f"with {EV} select seq, cast(greatest(round(least(pow(2, (k * 160 - 8000) / 8192.0::double * (seq % 128) / 12) * 16777216, 4294967295)), 1) as bigint) as factor from ev")
def bend_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", n.bend_factor(F.col("k") * 160 - 8000, F.col("seq") % 128).alias("factor"))


# Ratios of -8 to 2^40, each a sixteenth of a whole number, so that both sides cut alike.
_RATIO = "(k - 8) / 16.0::double * case when seq % 5 = 0 then 4294967296.0::double else 1 end"


@query(f"with {EV}, r as (select seq, {_RATIO} as ratio, vel / 16.0::double as step from ev), f as (select seq, case when ratio <= 0 then 0 when ratio * 4294967296 >= 18446744073709551616 then 18446744073709551615::hugeint else cast(floor(ratio * 4294967296) as hugeint) end as a, cast(floor(step * 4294967296) as hugeint) as b from r) select seq, cast(a // 4294967296 as bigint) as whole, cast(a % 4294967296 as bigint) as part, cast(((a + b) % 18446744073709551616::hugeint) // 4294967296 as bigint) as next_whole from f")
def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = (F.col("k") - 8) / 16 * F.when(F.col("seq") % 5 == 0, float(1 << 32)).otherwise(1.0)
    a, b = n.fixed(ratio), n.fixed(F.col("vel") / 16)
    whole, part = n.fixed_parts(a)
    return events(spark, sf_dir).select("seq", whole.alias("whole"), part.alias("part"), n.fixed_parts(n.fixed_add(a, b))[0].alias("next_whole"))


@query(f"with {EV} select seq, round(k / 127.0::double * vel / 64.0::double * 50 * sin(2 * pi() * (slot % 16 / 16.0::double)), 6) + 0.0 as cents, round(1 - vel / 127.0::double * 0.25 + vel / 127.0::double * 0.25 * sin(2 * pi() * (slot % 16 / 16.0::double)), 6) as gain, round(5 * pow(2, (vel - 64) / 32.0::double), 6) as rate from ev")
def modulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.col("slot") % 16 / 16
    out = events(spark, sf_dir).select("seq", *_r(cents=n.vibrato(F.col("k") / 127, F.col("vel"), phase), gain=n.tremolo(F.col("vel"), phase), rate=n.lfo_rate(F.col("vel"))))
    return out.withColumn("cents", F.col("cents") + 0.0)


@query(f"with {EV} select seq, cast((cast(micros as hugeint) * (16777216 + k * 99991)) // 16777216 as bigint) as scaled from ev")
def fixed_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", n.fixed_scale(F.col("micros"), F.col("k") * 99991 + (1 << 24)).alias("scaled"))


_RANK = "case when g > 0 then cast((e + 127) * 128 + floor((g / pow(2, e) - 1) * 128) as bigint) else 0 end"
_EXP = "floor(log2(g)) + case when pow(2, floor(log2(g)) + 1) <= g then 1 when pow(2, floor(log2(g))) > g then -1 else 0 end"


@query(f"with e as (select event_id as seq, value as g from events where value > 0), t as (select *, {_EXP} as e from e) select seq, {_RANK} as rank from t union all select event_id, 0 from events where value <= 0")
def gain_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", n.gain_rank(F.col("value")).alias("rank"))


_MIX = f"a as (select *, cast(((cast(xor(z, z >> 24) as hugeint)) * {0x9E37_79B9_7F4B}) % {1 << 48} as bigint) as z1 from t), b as (select *, cast(((cast(xor(z1, z1 >> 23) as hugeint)) * {0xBF58_476D_1CE5}) % {1 << 48} as bigint) as z2 from a)"


@query(f"with {EV}, t as (select seq, seq * 1000003 as z from ev), {_MIX} select seq, xor(z2, z2 >> 25) as mixed from b")
def mix48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", n.mix48(F.col("seq") * 1000003).alias("mixed"))


@query(f"with {CAND}, g as (select *, gain as g, idx as z from cand where gain > 0), t as (select *, {_EXP} as e from g), {_MIX}, r as (select seq, block, {_RANK} as rank, xor(z2, z2 >> 25) as tie from b) select seq, block, rank, tie, row_number() over (partition by block order by rank desc, tie desc) as place from r")
def admit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each candidate by gain rank, ties broken without pattern."""
    from ..sources.events import candidates

    keyed = candidates(events(spark, sf_dir)).filter("gain > 0").select("seq", "block", n.gain_rank(F.col("gain")).alias("rank"), n.mix48(F.col("idx").cast("long")).alias("tie"))
    return keyed.selectExpr("*", "cast(row_number() over (partition by block order by rank desc, tie desc) as bigint) as place")


# Decay and release as regions have them, by key, and after a controller of which 64 is neutral.
_TIMES = "b as (select p_partkey as region, p_size / 100.0::double as a, p_size / 500.0::double as h0, (p_retailprice - 900) / 100000 as d0, p_retailprice / 3000 as r0, p_partkey % 128 as key, p_size - 25 as tc, p_size * 2 + 20 as cc from part), s as (select *, h0 * pow(2, tc * (60 - key) / 1200.0::double) as h, d0 * pow(2, tc * (60 - key) / 1200.0::double) as db from b), m as (select *, case when cc <= 64 then pow(2, (cc - 64) / 8.0::double) else 1 end as f, case when cc > 64 then 6e-5 * pow(cc - 64, 3) else 0 end as up from s), t as (select *, greatest(db * f + up, least(db, 0.004)) as d, greatest(r0 * f + up, least(r0, 0.004)) as r from m)"


@query(f"with {_TIMES} select region, round(case when a * 48000 < 1 then 1 else 1 / (a * 48000) end, 9) as attack_rate, round(1 + h * 48000 * case when a * 48000 < 1 then 1 else 1 / (a * 48000) end, 6) as attack_end, round(pow(10, -5 / greatest(d * 48000, 1)), 9) as decay_coef, round(pow(10, -5 / greatest(r * 48000, 1)), 9) as release_coef, round(1 / greatest(d * 48000, 1), 9) as decay_step from t")
def envelope_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "part").selectExpr("p_partkey as region", "p_size / 100.0D as a", "p_size / 500.0D as h", "(p_retailprice - 900) / 100000 as d", "p_retailprice / 3000 as r", "p_partkey % 128 as key", "p_size - 25 as tc", "p_size * 2 + 20 as cc")
    scaled = lambda c: n.key_scaled(F.col(c), F.col("tc"), F.col("key"))
    hold, base = scaled("h"), (scaled("d"), F.col("r"))
    times = [n.time_controller(x, F.col("cc")) for x in base]
    e = n.envelope(F.col("a"), hold, *times, 48_000.0, base)
    e["decay_step"] = n.envelope(F.col("a"), hold, *times, 48_000.0, base, (True, True))["decay_coef"]
    digits = {"attack_end": 6}
    return t.select("region", *[F.round(c, digits.get(k, 9)).alias(k) for k, c in e.items()])


@query("with t as (select p_partkey as region, p_size * 290 as cents, 8.176 * pow(2, p_size * 290 / 1200.0::double) as hz, greatest(pow(10, ((p_retailprice - 900) / 10 / 10 - 3.01) / 20), 0.001) as q from part), w as (select *, least(greatest(hz / 48000, 1e-5), 0.49) * 2 * pi() as w from t), a as (select *, sin(w) / (2 * q) as al, sqrt(sqrt(0.5) / q) as lv, cents < 13500 and hz > 20 and hz < 48000 * 0.49 as u from w) select region, round(case when u then lv * (1 - cos(w)) / 2 / (1 + al) else 1 end, 6) as b0, round(case when u then lv * (1 - cos(w)) / (1 + al) else 0 end, 6) as b1, round(case when u then -2 * cos(w) / (1 + al) else 0 end, 6) as a1, round(case when u then (1 - al) / (1 + al) else 0 end, 6) as a2 from a")
def biquad_coeffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = n.lowpass(F.col("p_size") * 290, (F.col("p_retailprice") - 900) / 10, 48_000.0)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("region"), *_r(**c))


@query(f"with {EV} select seq, round((k - 64) * 75.0::double, 6) as cutoff_cents, round(greatest(k - 64, 0) * 240.0::double / 63, 6) as q_cb, round(case when vel <= 64 then 0.5 * pow(2, (vel - 64) / 8.0::double) else 0.5 + 6e-5 * pow(vel - 64, 3) end, 6) as attack from ev where kind = 'controller'")
def controller_mods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events(spark, sf_dir).filter("kind = 'controller'")
    return c.select("seq", *_r(cutoff_cents=(F.col("k") - 64) * 75.0, q_cb=F.greatest(F.col("k") - 64, F.lit(0)) * (240.0 / 63), attack=n.time_controller(F.lit(0.5), F.col("vel"))))


@query("with t as (select event_id as pos, least(greatest(value / 50 - 1, -1), 1) as v from events) select pos, cast(round(v * 32767) as bigint) as pcm from t")
def pcm_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), n.to_pcm16(F.col("value") / 50 - 1).alias("pcm"))


@query("with t as (select o_orderkey as id, o_orderkey * o_orderkey * 7 as n from orders) select id, case when n >= 1099511627776 then printf('%.2f TiB', n / 1099511627776.0::double) when n >= 1073741824 then printf('%.2f GiB', n / 1073741824.0::double) when n >= 1048576 then printf('%.2f MiB', n / 1048576.0::double) when n >= 1024 then printf('%.2f KiB', n / 1024.0::double) else n || ' B' end as text from t")
def fmt_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), n.bytes_text(F.col("o_orderkey") * F.col("o_orderkey") * 7).alias("text"))


@query(f"with {EV}, p as (select seq, (ch << 36) | (note << 28) | (vel << 20) | (k << 8) | 5 as word, ch, note, vel from ev) select seq, word, (word >> 36) & 15 as ch, (word >> 28) & 255 as note, (word >> 20) & 255 as vel from p")
def pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir).selectExpr("seq", "shiftleft(ch, 36) | shiftleft(note, 28) | shiftleft(vel, 20) | shiftleft(k, 8) | 5L as word")
    return p.selectExpr("seq", "word", "shiftright(word, 36) & 15 as ch", "shiftright(word, 28) & 255 as note", "shiftright(word, 20) & 255 as vel")
