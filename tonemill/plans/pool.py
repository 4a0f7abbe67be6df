"""Admission, stealing and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pool
from ..sources.events import candidates, events, read
from .registry import CAND, EV, query

_VOICE = "voice as (select (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey as id, l_discount * 10 as level, l_suppkey as region, l_returnflag as stage, l_quantity as qty, l_extendedprice / 100000 as gain, l_orderkey // 4096 as block, l_extendedprice from lineitem)"


def _voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("(l_orderkey * 8 + l_linenumber) * 100000 + l_partkey as id", "l_discount * 10 as level", "l_suppkey as region", "l_returnflag as stage", "l_quantity as qty", "l_extendedprice / 100000 as gain", "l_orderkey div 4096 as block", "l_extendedprice")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(events(spark, sf_dir))


@query(f"with {CAND}, s as (select *, least(want, 20) as take, least(want, 20, 64) as st from cand), t as (select *, ((idx + 1) * st - 1) // want as stratum from s), r as (select *, row_number() over (partition by block, stratum order by gain desc, idx desc) as n from t) select seq, block, idx, stratum, gain from r where n <= ((stratum + 1) * take) // st - (stratum * take) // st")
def admit_loudest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.admit_loudest(_candidates(spark, sf_dir), 20).selectExpr("seq", "block", "cast(idx as bigint) as idx", "stratum", "gain")


@query(f"with {CAND}, t as (select *, least(want, 20) as take from cand), p as (select block, (i * want) // take as idx from (select distinct block, want, take from t), (select unnest(range(0, 20)) as i) where i < take) select seq, t.block, t.idx from t join p using (block, idx)")
def admit_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.admit_even(_candidates(spark, sf_dir), 20).selectExpr("seq", "block", "cast(idx as bigint) as idx")


@query(f"with {CAND}, b as (select block, want from cand where idx = 0), l as (select block, want, coalesce(lag(want) over (order by block), 0) as live from b), w as (select *, least(want, 40) as q from l) select block, live, want, case when live + q <= 40 then q else least(q, 40 - (live - least(live + q - 40, live, 10))) end as take from w")
def admit_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose live voices are the note-ons of the block before."""
    per = events(spark, sf_dir).filter("kind = 'note_on'").groupBy("block").agg(F.count("*").alias("want"))
    live = per.withColumn("live", F.coalesce(F.lag("want").over(Window.orderBy("block")), F.lit(0)))
    return live.select("block", "live", "want", pool.admit_take(F.col("live"), F.col("want"), 40).alias("take"))


@query(f"with {CAND}, t as (select *, least(want, 20) as take, row_number() over (partition by block order by gain desc, idx desc) as n from cand) select block, cast(sum(floor(gain)) as bigint) as want_e, cast(sum(floor(gain)) filter (where n <= take) as bigint) as take_e from t group by block")
def admit_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("block").orderBy(F.desc("gain"), F.desc("idx"))
    ranked = _candidates(spark, sf_dir).withColumn("n", F.row_number().over(w))
    e = F.floor("gain")
    return ranked.groupBy("block").agg(F.sum(e).alias("want_e"), F.sum(F.when(F.col("n") <= F.least("want", F.lit(20)), e)).alias("take_e"))


_ROWS = f"with {_VOICE}"


@query(f"{_ROWS} select id, level, gain from voice order by floor(least(greatest(level, 0), 1) * 65535), id, gain limit 500")
def steal_quietest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voices(spark, sf_dir).select("id", "level", "gain")
    return v.orderBy(*pool.steal_key(F.col("level"), F.col("id")), "gain").limit(500)


@query(f"{_ROWS}, r as (select block, id, gain, row_number() over (partition by block order by id, gain) as n from voice) select block, id, gain from r where n <= 10")
def steal_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voices(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("block").orderBy("id", "gain"))
    return v.withColumn("n", n).filter("n <= 10").select("block", "id", "gain")


@query(f"{_ROWS} select id, gain, (id % 4294967296) % 4000 + 1 as stop, greatest(0.0, 1 - (qty - 1) / 96) as fade from voice where level < 0.2")
def steal_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame at which a stolen voice stops, spread by its id over the span,
    and the linear fade of 96 frames, ``qty`` frames in."""
    return _voices(spark, sf_dir).filter("level < 0.2").selectExpr("id", "gain", "(id % 4294967296) % 4000 + 1 as stop", "greatest(0.0D, 1 - (qty - 1) / 96) as fade")


@query(f"{_ROWS} select id, gain, region, stage, row_number() over (partition by region order by id, gain) - 1 as place from voice where level > 0.3")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live voices closed up in order within their region."""
    place = F.row_number().over(Window.partitionBy("region").orderBy("id", "gain")) - 1
    return _voices(spark, sf_dir).filter("level > 0.3").select("id", "gain", "region", "stage", place.cast("long").alias("place"))


@query(f"{_ROWS} select id, gain, region, stage, cast(qty as bigint) // 8 as bucket from voice")
def pool_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours share regions and stages; results never depend on it."""
    v = _voices(spark, sf_dir).selectExpr("id", "gain", "region", "stage", "cast(qty as bigint) div 8 as bucket")
    return v.repartition("region").sortWithinPartitions("region", "stage", "bucket", "id")


@query(f"{_ROWS} select (id >> 8) & 255 as byte, count(*) as n from voice group by 1")
def radix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voices(spark, sf_dir).selectExpr("shiftright(id, 8) & 255 as byte").groupBy("byte").agg(F.count("*").alias("n"))


@query(f"{_ROWS} select id, gain, block, 'now' as origin from voice where block % 2 = 0 union all select id, gain, block + 1, 'deferred' from voice where block % 2 = 1 and qty > 25")
def deferred_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices whose delay reaches into the next block join its own."""
    v = _voices(spark, sf_dir)
    now = v.filter("block % 2 = 0").selectExpr("id", "gain", "block", "'now' as origin")
    late = v.filter("block % 2 = 1 and qty > 25").selectExpr("id", "gain", "block + 1 as block", "'deferred' as origin")
    return now.unionByName(late)


_STATES = "known as (select cast(i as bigint) as state, (i * 7) % 64 as a, (i * 13) % 64 as b from (select unnest(range(0, 16)) as i))"


@query(f"with {EV}, {_STATES} select seq, distance, state from (select seq, abs(ev.vel // 2 - a) + abs(ev.note // 2 - b) as distance, state from ev, known where kind = 'controller') qualify row_number() over (partition by seq order by distance, state) = 1")
def nearest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.range(16).selectExpr("id as state", "(id * 7) % 64 as a", "(id * 13) % 64 as b")
    wanted = events(spark, sf_dir).filter("kind = 'controller'").selectExpr("seq", "vel div 2 as a", "note div 2 as b")
    return pool.nearest_state(wanted, known, ["a", "b"])


@query(f"with {EV} select ch, count(distinct (vel // 2, note // 2)) as states from ev where kind = 'controller' group by ch")
def distinct_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events(spark, sf_dir).filter("kind = 'controller'")
    return c.groupBy("ch").agg(F.count_distinct(F.expr("vel div 2"), F.expr("note div 2")).alias("states"))
