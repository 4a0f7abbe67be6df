"""The same operators over an event stream (Structured Streaming).

Blocks are event-time windows, and the watermark closes them; state that
crosses batches (gate counters, a row a slot) is a table in the shared folder. `collected` runs a stream over what is there now and gives
its result as a table, which is how queries and tests use it.

Events that come later than the watermark allows are dropped by Spark once
their window is closed; with a delay at least as long as a batch's span none
are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.folds import in_order
from ..sources.events import BLOCK, from_activity
from ..sources.shared import shared_dir


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The table events as a stream of note events."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may be a file, too.
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")
    return from_activity(raw).withColumn("time", F.timestamp_micros("micros"))


def density(stream: DataFrame, seconds: int = BLOCK, late: str = "1 hour") -> DataFrame:
    """(block, n): note-ons of each block, as far as they have come."""
    on = stream.filter("kind = 'note_on'").withWatermark("time", late)
    counted = on.groupBy(F.window("time", f"{seconds} seconds")).agg(F.count("*").alias("n"))
    return counted.select((F.unix_seconds("window.start") / seconds).cast("long").alias("block"), "n")


@dataclass
class Carried:
    """A stream with an ordered fold that `collected` runs on each batch.
    ``step`` makes a batch and the table of states so far (null at first) to
    rows of ``schema``; ``state`` makes those rows to the states after them,
    one row for each ``key``."""

    stream: DataFrame
    schema: str
    key: str
    step: Callable[[DataFrame, DataFrame | None], DataFrame]
    state: Callable[[DataFrame], DataFrame]


def gates(stream: DataFrame) -> Carried:
    """(slot, seq, ons, offs, sounding) after each event, the counters kept per
    slot from batch to batch in a table. A slot's events are never gathered: a
    batch is sorted by slot and seq, and a task goes through it in order."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ons, sounding = None, 0, 0
        for b in batches:
            rows = []
            for slot, seq, kind, had, sounded in b[["slot", "seq", "kind", "ons", "sounding"]].itertuples(index=False):
                if slot != last:
                    last, ons, sounding = slot, 0, 0
                if kind == "state":
                    ons, sounding = had, sounded
                    continue
                if kind == "note_on":
                    ons, sounding = ons + 1, sounding + 1
                elif kind == "note_off" and sounding:
                    sounding -= 1
                rows.append((slot, seq, ons, ons - sounding, sounding))
            yield pd.DataFrame(rows, columns=["slot", "seq", "ons", "offs", "sounding"])

    def step(batch: DataFrame, states: DataFrame | None) -> DataFrame:
        rows = batch.selectExpr("slot", "seq", "kind", "0L as ons", "0L as sounding", "1 as place")
        if states is not None:
            carried = states.join(batch.select("slot").distinct(), "slot", "left_semi")
            rows = rows.unionByName(carried.selectExpr("slot", "0L as seq", "'state' as kind", "ons", "sounding", "0 as place"))
        return in_order(rows, "slot", "place", "seq").mapInPandas(fold, out)

    def state(rows: DataFrame) -> DataFrame:
        return rows.groupBy("slot").agg(F.max_by(F.struct("ons", "sounding"), "seq").alias("s")).select("slot", "s.*")

    out = "slot long, seq long, ons long, offs long, sounding long"
    return Carried(stream.select("slot", "seq", "kind"), out, "slot", step, state)


def collected(stream: DataFrame | Carried, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all input there is. Each batch's rows are written with
    its number under a folder of its own, so a batch that is run again replaces
    itself, and so are the states of a `Carried` fold after it; with ``keys`` the last row of each key counts (update mode)."""
    carried, stream = (stream, stream.stream) if isinstance(stream, Carried) else (None, stream)
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        if carried is None:
            batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
            return
        session = batch.sparkSession
        before = session.read.parquet(f"{at}/state/{number - 1}") if number else None
        carried.step(batch, before).write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        after = carried.state(session.read.schema(carried.schema).parquet(f"{at}/out/batch={number}"))
        if before is not None:
            after = after.unionByName(before.join(after, carried.key, "left_anti"))
        after.write.mode("overwrite").parquet(f"{at}/state/{number}")

    schema = carried.schema if carried else stream.schema
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(f"{at}/out/batch=-1")
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")
    if keys:
        newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    return rows.select(*empty.columns)
