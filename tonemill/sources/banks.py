"""Instrument banks of any kind as one table of regions.

Defined cases: a path whose ending names no kind raises an error; a bank of no
regions gives none; what a kind has no word for is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sfz, soundfont


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """The regions of all banks, each read by what its ending says: ``file``,
    ``kind``, the columns both kinds have, and those of either one."""
    found = []
    for path in paths:
        kind = sfz.kind_of(path)
        if kind == "sfz":
            regions = sfz.load(spark, path).withColumn("sample", F.col("sample").cast("string"))
        else:
            regions = soundfont.regions(soundfont.records(spark, path)).withColumnRenamed("path", "file").withColumn("sample", F.col("sample").cast("string"))
        found.append(regions.withColumn("kind", F.lit(kind)))
    if not found:
        raise ValueError("no bank is named")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
