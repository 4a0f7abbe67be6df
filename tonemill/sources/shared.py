"""The folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where the
    session names none, a local master gets a fresh temporary one (tests, local
    runs); any other raises, as its executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share; the master is {master}")
        where = "file://" + tempfile.mkdtemp(prefix="tonemill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new local path in the shared folder, for files that are single streams
    of bytes; needs a shared folder that is mounted."""
    folder = f"{shared_dir(spark).removeprefix('file://')}/{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what is read more than once
    is worked out once, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
