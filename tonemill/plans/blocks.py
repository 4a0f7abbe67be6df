"""Scans, merges and reports over blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, reports
from ..sources.events import events, read
from .registry import EV, query

_DENSITY = f"with {EV}, c as (select block, count(*) filter (where kind = 'note_on') as n from ev group by block), d as (select b.block, coalesce(c.n, 0) as n from (select unnest(range((select min(block) from c), (select max(block) from c) + 1)) as block) b left join c using (block))"


def _per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.density(events(spark, sf_dir))


@query(f"with {EV} select kind, count(*) as n from ev group by kind")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{_DENSITY} select block, n from d")
def block_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_block(spark, sf_dir)


@query(f"{_DENSITY} select n, block from d order by n desc, block desc limit 1")
def busiest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.busiest(_per_block(spark, sf_dir))


@query(f"{_DENSITY}, w as (select block, sum(n) over (order by block rows between current row and 7 following) as voices, count(*) over (order by block rows between current row and 7 following) as inside from d) select cast(voices as bigint) as voices, block from w where inside = 8 order by voices desc, block limit 1")
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.peak_concurrency(_per_block(spark, sf_dir), 8)


@query(f"{_DENSITY} select n, block, n * 60 as bytes from d order by n desc, block desc limit 1")
def memory_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.memory_projection(_per_block(spark, sf_dir), layers=2)


@query(f"with {EV} select seq, sec - block * 21600 as rel, block, tile - block * 32 as tile from ev")
def tumbling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("seq", "sec - block * 21600 as rel", "block", "(sec - block * 21600) div 675 as tile")


@query(f"with {EV} select slot % 7 as track, micros // 60000000 as tick, seq from ev")
def merge_ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks merged by tick, then track, then order within the track."""
    tracks = events(spark, sf_dir).selectExpr("slot % 7 as track", "micros div 60000000 as tick", "seq")
    return tracks.orderBy("tick", "track", "seq")


@query(f"with {EV} select seq, row_number() over (order by block, seq) - 1 as id from ev where kind = 'note_on'")
def note_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ons = events(spark, sf_dir).filter("kind = 'note_on'").select("seq", "block")
    return blocks.running(ons, F.lit(1), ["seq"], "id").select("seq", (F.col("id") - 1).alias("id"))


@query(f"with {EV} select seq, cast(sum(k) over (order by seq) - k as bigint) as before from ev")
def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("seq", "block", "k")
    return blocks.running(ev, F.col("k"), ["seq"], "upto").select("seq", (F.col("upto") - F.col("k")).alias("before"))


@query("with s as (select event_id as pos, value / 100 - 1 as l, 1 - value / 100 as r from events) select pos // 256 as block, round(sqrt(sum(l * l + r * r) / (2 * count(*))), 6) as rms, round(max(greatest(abs(l), abs(r))), 6) as peak from s group by 1")
def block_rms_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = read(spark, sf_dir, "events").selectExpr("event_id as pos", "value / 100 - 1 as l", "1 - value / 100 as r")
    return blocks.levels(signal, 256).select("block", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))


@query("with s as (select event_id as pos, value as x, round(value, 1) as y from events), d as (select pos, x, abs(x - y) as d from s) select round(max(d), 6) as peak_diff, round(sqrt(avg(d * d)), 6) as rms_diff, max(abs(x)) as ref_peak, (select pos from d order by d desc, pos limit 1) as worst_at, bool_and(d = 0) as identical from d")
def null_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("v"))
    out = blocks.null_diff(s, s.withColumn("v", F.round("v", 1)))
    return out.withColumns({"peak_diff": F.round("peak_diff", 6), "rms_diff": F.round("rms_diff", 6)})


@query("with s as (select event_id as pos, case when event_id % 997 = 5 then 'nan'::double when event_id % 991 = 7 then 'inf'::double else value end as v from events) select count(*) filter (where not isfinite(v)) as bad, min(pos) filter (where not isfinite(v)) as first from s")
def finite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("case when event_id % 997 = 5 then double('nan') when event_id % 991 = 7 then double('infinity') else value end")
    return blocks.finite_guard(read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), v.alias("v")))


@query(f"with {EV}, b as (select min(block) as a from ev) select seq, block from ev, b where (block - a) * 21600 < 86400 * 3")
def limit_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole blocks that begin within three days of the first."""
    ev = events(spark, sf_dir).select("seq", "block")
    first = F.broadcast(ev.agg(F.min("block").alias("a")))
    return ev.join(first, (F.col("block") - F.col("a")) * 21600 < 86400 * 3).select("seq", "block")


@query("with s as (select p_retailprice * 100 as frames, 8000 + p_size * 1000 as rate from part), t as (select pool_rate, 2 * cast(sum(floor(frames * pool_rate / greatest(rate, 1)) + 4) as bigint) as bytes from s, (select unnest([48000, 24000, 12000, 6000]) as pool_rate) group by pool_rate) select cast(pool_rate as bigint) as pool_rate, bytes from t where bytes <= 400000000 or pool_rate <= 8000 order by pool_rate desc limit 1")
def rate_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "part").selectExpr("p_retailprice * 100 as frames", "8000 + p_size * 1000 as rate")
    return blocks.rate_fit(samples, 48_000, 400_000_000)


@query(f"with {EV} select seq, kind as was, case when kind = 'note_on' and vel % 10 = 0 then 'note_off' else kind end as kind from ev")
def normalise_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note-on of velocity 0 is a note-off; here every tenth velocity is 0."""
    return events(spark, sf_dir).selectExpr("seq", "kind as was", "if(kind = 'note_on' and vel % 10 = 0, 'note_off', kind) as kind")


@query(f"with {EV} select count(*) filter (where kind = 'note_on') as notes, count(distinct block) as blocks, max(n) as peak, cast(sum(greatest(n - 20, 0)) filter (where first) as bigint) as dropped from (select *, count(*) filter (where kind = 'note_on') over (partition by block) as n, row_number() over (partition by block order by seq) = 1 as first from ev)")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run whose blocks take up to 20 notes."""
    per = events(spark, sf_dir).groupBy("block").agg(F.count_if(F.col("kind") == "note_on").alias("n"))
    return per.agg(F.sum("n").alias("notes"), F.count("*").alias("blocks"), F.max("n").alias("peak"), F.sum(F.greatest(F.col("n") - 20, F.lit(0))).alias("dropped"))


@query("with s as (select event_id as pos, value as x, round(value, 1) as y from events where event_id % 7 <> 3), d as (select pos, x, abs(x - y) as d from s), t as (select max(d) as p, sqrt(avg(d * d)) as q, max(abs(x)) as r, count(*) as compared, bool_and(d = 0) as identical from d) select compared, identical, round(20 * log10(p), 4) as peak_db, round(20 * log10(q), 4) as rms_db, round(20 * log10(r), 4) as ref_db, 20 * log10(p) <= -20.0 as passed from t")
def null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signals of which one lacks some positions, against a threshold."""
    s = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("v"))
    out = reports.null_report(s, s.filter("pos % 7 <> 3").withColumn("v", F.round("v", 1)), -20.0)
    return out.select("compared", "identical", *[F.round(c, 4).alias(c) for c in ("peak_db", "rms_db", "ref_db")], "passed")


@query(f"{_DENSITY}, k as (select count(*) filter (where kind = 'note_on') as note_ons, count(*) filter (where kind = 'note_off') as note_offs, count(*) filter (where kind = 'controller') as controllers from ev), b as (select n, block from d order by n desc, block desc limit 1), w as (select block, sum(n) over (order by block rows between current row and 7 following) as voices, count(*) over (order by block rows between current row and 7 following) as inside from d), p as (select voices, block from w where inside = 8 order by voices desc, block limit 1) select note_ons, note_offs, controllers, b.n as busiest, b.block * 4096 / 48000.0::double as busiest_at, b.n * 60 as bytes, 4096::bigint as advised, b.n * 60 as advised_bytes, cast(p.voices * 2 as bigint) as voices, p.block * 4096 / 48000.0::double as voices_at from k, b, p")
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.file_report(events(spark, sf_dir), block=4096, layers=2, width=8, rate=48_000.0)


@query("with recursive t as (select p_partkey as id, p_partkey * 40000 as notes from part), h(id, need, block) as (select id, notes * 60, 4096 from t union all select id, need, block // 2 from h where block > 128 and need // (4096 // block) > 2147483648), m as (select id, any_value(need) as need, min(block) as block from h group by id) select id, cast(block as bigint) as block, cast(need // (4096 // block) as bigint) as bytes from m")
def narrower_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block advised for a busiest block of so many notes."""
    block, held = reports.narrower_block(F.col("p_partkey") * 40_000, 4096, 2)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), block.alias("block"), held.alias("bytes"))
