"""Clocks, programs and channel controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels, controls
from ..sources.events import events, read
from .registry import EV, query

_TEMPO = "t as (select epoch_us(o_orderdate) // 86400000000 as tick, arg_min(300000 + o_orderkey % 7 * 50000, o_orderkey) as us from orders group by 1), b as (select 0 as tick, 500000 as us, 0 as o union all select tick, us, 1 from t), d as (select tick, us, o, coalesce((tick - lag(tick) over (order by tick, o)) * lag(us) over (order by tick, o) * 0.048 / 480, 0) as d, lead(tick) over (order by tick, o) as until from b), s as (select tick as start, sum(d) over (order by tick, o) as base, us * 0.048::double / 480 as per, until from d)"


@query(f"with {_TEMPO}, l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, epoch_us(l_shipdate) // 86400000000 as tick from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(base + (l.tick - start) * per, 3) as frame from l join s on l.tick >= s.start and (s.until is null or l.tick < s.until)")
def asof_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of shipping days, by the tempo map that order days give."""
    day = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz)) div 86400000000")
    tempo = read(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("tick")).agg(F.min_by(F.expr("300000 + o_orderkey % 7 * 50000"), "o_orderkey").alias("us_per_qn"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = read(spark, sf_dir, "lineitem").select(*keys, day("l_shipdate").alias("tick"))
    return controls.frames(lines, controls.tempo_segments(tempo, 480, 48_000)).select(*keys, F.round("frame", 3).alias("frame"))


@query(f"with {EV} select seq, round((micros // 60000000 % 1000000) * (48000 / 25 / 40.0::double), 3) as frame from ev")
def smpte_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).selectExpr("seq", "micros div 60000000 % 1000000 as tick")
    return controls.smpte_frames(ev, 25, 40, 48_000).select("seq", F.round("frame", 3).alias("frame"))


@query(f"with {EV}, p as (select *, last_value(case when kind = 'controller' then k end ignore nulls) over (partition by ch order by seq rows unbounded preceding) as program from ev) select seq, ch, program from p where kind = 'note_on'")
def asof_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = F.when(F.col("kind") == "controller", F.col("k"))
    return controls.in_force(events(spark, sf_dir), program, "program").filter("kind = 'note_on'").select("seq", "ch", "program")


_GRID = f"{EV}, l as (select ch, tile, arg_max(k, seq) as v from ev where kind = 'controller' group by ch, tile), g as (select t.tile, c.ch from (select unnest(range((select min(tile) from ev), (select max(tile) from ev) + 1)) as tile) t, (select distinct ch from ev) c), f as (select g.tile, g.ch, last_value(l.v ignore nulls) over (partition by g.ch order by g.tile rows between unbounded preceding and 1 preceding) as bend from g left join l on g.tile = l.tile and g.ch = l.ch)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.tile_grid(events(spark, sf_dir), F.when(F.col("kind") == "controller", F.col("k")), "bend")


@query(f"with {_GRID} select tile, ch, bend from f")
def channel_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query(f"with {_GRID} select ev.seq, ev.ch, ev.tile, f.bend from ev join f on ev.tile = f.tile and ev.ch = f.ch where ev.kind = 'note_on'")
def tile_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note-on with its channel's control at the start of its tile."""
    ons = events(spark, sf_dir).filter("kind = 'note_on'").select("seq", "ch", "tile")
    return ons.join(_grid(spark, sf_dir), ["tile", "ch"]).select("seq", "ch", "tile", "bend")


@query(f"with {EV}, r as (select *, 0.0001 * pow(2, (k - 50) / 32.0::double) as r from ev), d as (select *, coalesce(lag(r) over w * (sec - lag(sec) over w), 0) as d from r window w as (partition by ch order by seq)) select seq, ch, round(sum(d) over (partition by ch order by seq rows unbounded preceding) - floor(sum(d) over (partition by ch order by seq rows unbounded preceding)), 5) as phase from d")
def lfo_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.pow(F.lit(2.0), (F.col("k") - 50) / 32) * 0.0001
    return controls.lfo(events(spark, sf_dir), rate).select("seq", "ch", F.round("phase", 5).alias("phase"))


@query()
def channel_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controllers, programs and bends dispatched to channels, with registered
    parameters and the bend range; the tests compare it with a loop."""
    # Numbers that come up often enough to meet: parameter choice, data entry, and the rest.
    numbers = F.array(*map(F.lit, [100, 101, 6, 38, 96, 97, 98, 7, 39, 10, 42, 11, 43, 1, 33, 0, 32, 67, 121, 64]))
    ev = events(spark, sf_dir).filter("kind <> 'note_off'")
    kind = F.when(F.col("kind") == "note_on", F.when(F.col("k") % 2 == 0, "bend").otherwise("program")).otherwise("controller")
    a = F.when(kind == "controller", F.element_at(numbers, (F.col("k") % 20 + 1).cast("int"))).when(kind == "bend", F.col("k") * 160 - 8000).otherwise(F.col("k"))
    b = F.when(F.col("k") % 20 < 2, 0).otherwise(F.col("vel"))
    return channels.dispatched(ev.select(F.col("ch").alias("channel"), "seq", kind.alias("kind"), a.alias("a"), b.alias("b")))


_ROLES = "case when k in (0, 1, 6, 7, 10, 11, 32, 33, 38, 39, 42, 43, 64, 66, 67) or k between 71 and 77 or k in (92, 96, 97, 98, 99) then 'applied' when k in (5, 12, 13, 65, 68, 69, 78, 84, 88, 91, 93, 94, 95) then 'missing' else 'inert' end"


@query(f"with {EV}, c as (select k as num, count(*) as n from ev where kind = 'controller' group by k) select num, n, {_ROLES.replace('k ', 'num ')} as role, round(100.0 * n / sum(n) over (), 6) as percent from c")
def cc_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controllers by number with what becomes of them."""
    # The controllers that are applied, and those that are known
    # but not implemented; the rest have no effect to implement.
    applied = [0, 1, 6, 7, 10, 11, 32, 33, 38, 39, 42, 43, 64, 66, 67, *range(71, 78), 92, *range(96, 102), 120, 121, *range(123, 128)]
    missing = [5, 12, 13, 65, 68, 69, 78, 84, 88, 91, 93, 94, 95]
    counts = events(spark, sf_dir).filter("kind = 'controller'").groupBy(F.col("k").alias("num")).agg(F.count("*").alias("n"))
    role = F.when(F.col("num").isin(applied), "applied").when(F.col("num").isin(missing), "missing").otherwise("inert")
    return counts.select("num", "n", role.alias("role"), F.expr("round(100.0D * n / sum(n) over (), 6)").alias("percent"))


# Names of controllers; other numbers have none.
CONTROLLER_NAMES = {
    0: "bank select msb", 1: "modulation", 2: "breath", 4: "foot controller", 5: "portamento time", 6: "data entry msb", 7: "channel volume", 8: "balance",
    10: "pan", 11: "expression", 12: "effect control", 13: "effect control", 16: "general purpose", 17: "general purpose", 18: "general purpose", 19: "general purpose",
    32: "bank select lsb", 33: "modulation lsb", 38: "data entry lsb", 39: "channel volume lsb", 42: "pan lsb", 43: "expression lsb",
    64: "sustain pedal", 65: "portamento", 66: "sostenuto", 67: "soft pedal", 68: "legato footswitch", 69: "hold 2",
    70: "sound variation", 71: "resonance", 72: "release time", 73: "attack time", 74: "brightness", 75: "decay time", 76: "vibrato rate", 77: "vibrato depth", 78: "vibrato delay", 79: "sound controller 10",
    80: "general purpose", 81: "general purpose", 82: "general purpose", 83: "general purpose", 84: "portamento control", 88: "high resolution velocity",
    91: "reverb send", 92: "tremolo depth", 93: "chorus send", 94: "celeste depth", 95: "phaser depth", 96: "data increment", 97: "data decrement",
    98: "nrpn select", 99: "nrpn select", 100: "rpn select", 101: "rpn select",
    120: "all sound off", 121: "reset controllers", 122: "local control", 123: "all notes off", 124: "omni off", 125: "omni on", 126: "mono mode on", 127: "poly mode on",
}
_NAMES = ", ".join(f"({num}, '{name}')" for num, name in CONTROLLER_NAMES.items())


@query(f"with {EV}, names(num, name) as (values {_NAMES}), c as (select k as num, ch, count(*) as n from ev where kind = 'controller' group by k, ch) select c.num, coalesce(name, '') as name, cast(sum(n) as bigint) as n, count(*) as channels from c left join names on c.num = names.num group by 1, 2")
def cc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controllers that occur, by name, with how often and on how many channels."""
    by = events(spark, sf_dir).filter("kind = 'controller'").groupBy(F.col("k").alias("num"), "ch").agg(F.count("*").alias("n"))
    names = F.create_map(*[F.lit(x) for pair in CONTROLLER_NAMES.items() for x in pair])
    counts = by.groupBy("num").agg(F.sum("n").alias("n"), F.count("*").alias("channels"))
    return counts.select("num", F.coalesce(F.try_element_at(names, F.col("num").cast("int")), F.lit("")).alias("name"), "n", "channels")
