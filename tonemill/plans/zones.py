"""Zones, presets and opcode text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import zones
from ..sources.events import events, read
from .registry import EV, query

_ZONE = "zone as (select p_partkey as region, p_brand as preset, p_size as key_lo, p_size + 8 as key_hi, (p_partkey % 40) as vel_lo, 127 as vel_hi from part)"
_HIT = "hit as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_brand as preset, cast(l_quantity as integer) as key, l_linenumber * 18 as vel from lineitem join part on l_partkey = p_partkey)"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_partkey as region", "p_brand as preset", "p_size as key_lo", "p_size + 8 as key_hi", "p_partkey % 40 as vel_lo", "127 as vel_hi")


@query(f"with {_ZONE}, {_HIT}, q as (select distinct preset, key, vel from hit), f as (select q.*, region, row_number() over (partition by q.preset, q.key, q.vel order by region) as layer from q join zone z on q.preset = z.preset and q.key between z.key_lo and z.key_hi and q.vel between z.vel_lo and z.vel_hi) select {', '.join(_KEYS)}, region, cast(layer as integer) as layer from hit join f using (preset, key, vel) where layer <= 2")
def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    hits = lines.select(*_KEYS, F.col("p_brand").alias("preset"), F.col("l_quantity").cast("int").alias("key"), (F.col("l_linenumber") * 18).alias("vel"))
    return zones.lookup(hits, _zone(spark, sf_dir), "region", 2, _KEYS)


_PRESETS = "pre as (select distinct (case when p_size % 10 = 9 then 128 else p_size % 4 end) as bank, p_size as program, (case when p_size % 10 = 9 then 128 else p_size % 4 end) * 1000 + p_size as preset from part where p_size <> 7)"


@query(f"with {EV}, {_PRESETS}, h as (select seq, case when ch = 9 then 128 else ch % 4 end as bank, k % 60 as program from ev where kind = 'note_on') select seq, bank, program, cast(coalesce((select min(preset) from pre where pre.bank = h.bank and pre.program = h.program), (select min(preset) from pre where pre.bank = 0 and pre.program = h.program), case when bank = 128 then (select min(preset) from pre where pre.bank = 128) end, (select min(preset) from pre)) as integer) as preset from h")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = "case when p_size % 10 = 9 then 128 else p_size % 4 end"
    presets = read(spark, sf_dir, "part").filter("p_size <> 7").selectExpr(f"{bank} as bank", "p_size as program", f"({bank}) * 1000 + p_size as preset").distinct()
    hits = events(spark, sf_dir).filter("kind = 'note_on'").selectExpr("seq", "case when ch = 9 then 128 else ch % 4 end as bank", "k % 60 as program")
    return zones.with_fallback(hits, presets).select("seq", "bank", "program", "preset")


@query(f"with {EV}, g as (select distinct vi, ki, vi * 128 + ki as params from (select unnest(range(0, 4)) as vi), (select unnest(range(0, 128)) as ki)) select seq, params from ev join g on ev.vel // 32 = g.vi and ev.note = g.ki where kind = 'note_on'")
def params_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(512).selectExpr("id div 128 as vi", "id % 128 as note", "id as params")
    ons = events(spark, sf_dir).filter("kind = 'note_on'").selectExpr("seq", "vel div 32 as vi", "note")
    return ons.join(F.broadcast(grid), ["vi", "note"]).select("seq", "params")


@query("with o as (select p_partkey as id, p_partkey % 50 as instrument, p_size as key_lo, 60 - p_size as key_hi from part), i as (select s_suppkey as zone, s_suppkey % 50 as instrument, s_nationkey as key_lo, s_nationkey + 12 as key_hi from supplier), x as (select id, zone, greatest(least(o.key_lo, o.key_hi), i.key_lo) as low, least(greatest(o.key_lo, o.key_hi), i.key_hi) as high from o join i using (instrument)) select id, zone, low, high from x where low <= high")
def flatten_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = read(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_partkey % 50 as instrument", "p_size as key_lo", "60 - p_size as key_hi")
    inner = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as zone", "s_suppkey % 50 as instrument", "s_nationkey as key_lo", "s_nationkey + 12 as key_hi")
    return zones.flatten(outer, inner).select("id", "zone", "low", "high")


@query("with t as (select p_partkey as id, greatest(least(p_size, 55 - p_size), least(20, 40)) as low, least(greatest(p_size, 55 - p_size), greatest(20, 40)) as high from part) select id, low, high from t where low <= high")
def range_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = zones.intersect(F.col("p_size"), 55 - F.col("p_size"), F.lit(40), F.lit(20))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), low.alias("low"), high.alias("high")).filter("low <= high")


@query("select p_partkey as id, cast(least(greatest(coalesce(case when p_size % 3 = 0 then p_size * 1000 end, case when p_size % 2 = 0 then p_size * 500 end, -12000) + coalesce(case when p_size % 5 = 0 then 10000 end, 0), -32768), 32767) as integer) as value from part")
def layered_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    value = zones.layered(F.lit(-12000), [F.when(s % 2 == 0, s * 500), F.when(s % 3 == 0, s * 1000)], F.when(s % 5 == 0, 10000))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), value.alias("value"))


_ROWS = "case when event_id % 40 = 0 then 'global' when event_id % 20 = 10 then 'master' when event_id % 7 = 3 then 'group' else 'region' end"


@query(f"""with r as (select event_id // 500 as file, event_id as line, {_ROWS} as header, case when event_id % 3 = 0 then user_id end as a, case when event_id % 4 = 1 then event_type end as b from events),
 s as (select *, max(case when header = 'global' then line end) over w as g, max(case when header in ('global', 'master') then line end) over w as m, max(case when header in ('global', 'master', 'group') then line end) over w as p from r window w as (partition by file order by line rows unbounded preceding))
 select s.file, s.line, coalesce(s.a, p.a, m.a, g.a) as a, coalesce(s.b, p.b, m.b, g.b) as b from s left join r g on s.file = g.file and s.g = g.line left join r m on s.file = m.file and s.m = m.line and m.header = 'master' left join r p on s.file = p.file and s.p = p.line and p.header = 'group' where s.header = 'region'""")
def opcode_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("event_id div 500 as file", "event_id as line", f"{_ROWS} as header", "case when event_id % 3 = 0 then user_id end as a", "case when event_id % 4 = 1 then event_type end as b")
    return zones.inherit(rows, ["a", "b"])


@query("with t as (select event_id as id, substr('cdefgab', 1 + cast(user_id % 7 as integer), 1) as l, substr('#b', 1 + cast(event_id % 3 as integer), 1) as s, event_id % 11 - 1 as o from events) select id, l || s || o as name, cast(instr('c d ef g a b', l) - 1 + case s when '#' then 1 when 'b' then -1 else 0 end + (o + 1) * 12 as bigint) as note from t")
def note_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").selectExpr("event_id as id", "concat(substr('cdefgab', cast(1 + user_id % 7 as int), 1), substr('#b', cast(1 + event_id % 3 as int), 1), event_id % 11 - 1) as name")
    return t.select("id", "name", zones.note_number(F.col("name")).alias("note"))


@query("with t as (select event_id as id, user_id, event_type, value from events) select id, 'sample' as name, event_type || ' take ' || user_id as value from t union all select id, 'lokey', cast(user_id % 128 as varchar) from t")
def kv_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('Sample=', event_type, ' take ', user_id, ' lokey=', user_id % 128, ' // x=1')")
    pairs = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.explode(zones.key_values(text)).alias("p"))
    return pairs.select("id", "p.name", "p.value")


@query("select s_suppkey as sample, s_nationkey as rate from supplier where s_suppkey in (select l_suppkey from lineitem where l_discount > 0.09)")
def used_samples_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that some region refers to."""
    used = read(spark, sf_dir, "lineitem").filter("l_discount > 0.09").select(F.col("l_suppkey").alias("sample"))
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey as sample", "s_nationkey as rate").join(used, "sample", "left_semi")


_ADDR = "t as (select p_partkey as id, p_partkey % 997 as len, p_partkey % 400 as ls, p_partkey % 900 as le, p_size * 20 - 100 as o, p_size * 7 - 300 as e, (p_size % 5 + 2) / 4.0::double as ratio from part), m as (select *, cast(round(o * ratio) as bigint) as so, cast(round(e * ratio) as bigint) as se from t), l as (select *, greatest(1, least(len + se, len)) as n from m where len > 0)"


@query(f"with {_ADDR} select id, cast(greatest(0, least(so, len - 1)) as bigint) as start, cast(n as bigint) as length, cast(greatest(0, least(ls + so, n - 1)) as bigint) as loop_start, cast(greatest(0, least(le + se, n)) as bigint) as loop_end from l")
def sample_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address offsets in source frames, for samples held at another rate."""
    t = read(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_partkey % 997 as len", "p_partkey % 400 as ls", "p_partkey % 900 as le", "p_size * 20 - 100 as o", "p_size * 7 - 300 as e", "(p_size % 5 + 2) / 4.0D as ratio")
    at = zones.addressed(F.col("len"), (F.col("ls"), F.col("le")), (F.col("o"), F.col("e"), F.col("o"), F.col("e")), F.col("ratio"))
    return t.filter(zones.sounds(F.col("len"), F.col("ratio"))).select("id", *[c.alias(k) for k, c in at.items()])
