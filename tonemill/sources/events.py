"""Adapters from ordinary tables to the event model.

An event has seq (unique, in time order), micros, slot, ch, note, k, vel, kind
(note_on, note_off, controller) and value; block and tile are tumbling windows
of BLOCK and TILE seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, TILE = 21_600, 675


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_activity(events: DataFrame) -> DataFrame:
    """The table events as note events; time zones play no part."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    kind = F.when(F.col("event_type").isin("click", "view"), "note_on").when(F.col("event_type").isin("signup", "purchase"), "note_off").otherwise("controller")
    base = events.select(F.col("event_id").alias("seq"), micros.alias("micros"), F.col("user_id").alias("slot"), "event_type", "value", k.alias("k"), kind.alias("kind"))
    return base.selectExpr("*", "micros div 1000000 as sec", "slot % 16 as ch", "slot % 128 as note", "1 + k % 127 as vel").selectExpr("*", f"sec div {BLOCK} as block", f"sec div {TILE} as tile")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_activity(read(spark, sf_dir, "events"))


def candidates(ev: DataFrame) -> DataFrame:
    """Note-ons of each block with idx (their order) and want (their number)."""
    return ev.filter("kind = 'note_on'").selectExpr("seq", "block", "value as gain", "row_number() over (partition by block order by seq) - 1 as idx", "count(*) over (partition by block) as want")
