"""What the listener records of streams, against sums of their rows."""

import os

import pytest
from pyspark.sql import functions as F

from tonemill.streaming import metrics

FORM = "id long, v double"


def add(spark, path, rows):
    spark.createDataFrame(rows, FORM).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    stream = spark.readStream.schema(FORM).option("maxFilesPerTrigger", 1).parquet(path)
    return metrics.observe(stream, "rows of v", total=F.sum("v"), top=F.max("v"), last=F.max(F.col("id").cast("string")))


def table(df):
    return {(r["batch"], r["metric"]): r["value"] for r in df.collect()}


def test_a_row_a_batch_and_metric(spark, tmp_path):
    path, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    parts = [[(1, 1.5), (2, 2.5)], [(3, None)], [(4, -1.0), (5, 0.0), (6, 7.0)]]
    for rows in parts:
        add(spark, path, rows)
    got = metrics.run(source(spark, path), checkpoint, out)
    assert table(got) == {(0, "rows"): 2, (0, "total"): 4.0, (0, "top"): 2.5, (1, "rows"): 1, (1, "total"): None, (1, "top"): None, (2, "rows"): 3, (2, "total"): 6.0, (2, "top"): 7.0}
    assert {r["name"] for r in got.collect()} == {"rows of v"} and got.filter("took_ms < 0 or input_rows <= 0").count() == 0
    # A restart goes on counting batches, and what it records is its own.
    add(spark, path, [(7, 9.0)])
    again = metrics.run(source(spark, path), checkpoint, out)
    assert table(again) == {(3, "rows"): 1, (3, "total"): 9.0, (3, "top"): 9.0}
    assert {r["stream"] for r in got.collect()} == {r["stream"] for r in again.collect()}
    assert spark.read.parquet(out).count() == 7


def test_nothing_to_record(spark, tmp_path):
    path, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    os.makedirs(path)
    got = metrics.run(source(spark, path), checkpoint, out)
    assert got.count() == 0 and got.columns == [c.split(" ")[0] for c in metrics.SCHEMA.split(", ")]


def test_waiting_ends(spark):
    with metrics.recording(spark) as recorder, pytest.raises(TimeoutError):
        recorder.wait("none", 0.1)
