"""Small shared helpers of the corpus operators.

Tables that an operator reads more than once, and the state of iterative
ones, are written as Parquet below ``spark.checkpoint.dir``: that folder is
shared by all executors, so a lost executor costs a re-read and not the work
before it.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\f\r"
#: Tables up to this many rows, of a few short columns, may be broadcast.
BROADCAST_ROWS = 200_000
#: Broadcast tables take up to so many bytes, as their columns' lengths tell.
BROADCAST_BYTES = 32 << 20
#: While a table is written, its shuffle files go when the write ends, and
#: Python workers get texts in batches of few rows and bytes, which bounds
#: their memory.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


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


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it counts at most ``limit`` rows and
    ``most`` bytes, else df itself, which Spark then joins by shuffling. Count a
    materialized table. Strings and binaries count by their length, arrays of
    numbers by eight bytes an element, other arrays as their JSON, and any value
    by eight bytes besides."""

    def size(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return 8 * F.size(name) if isinstance(kind.elementType, T.NumericType) else F.length(F.to_json(name))
        if isinstance(kind, T.StructType | T.MapType):
            return F.length(F.to_json(name))
        return F.octet_length(name) if isinstance(kind, T.StringType | T.BinaryType) else F.lit(0)

    each = sum((F.coalesce(size(f.name, f.dataType), F.lit(0)) for f in df.schema.fields), F.lit(8 * len(df.columns)))
    rows, total = df.agg(F.count("*"), F.sum(each.cast("long"))).first()
    return F.broadcast(df) if rows <= limit and (total or 0) <= most else df


def hashed_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """About n rows of df (all, if it has no more), chosen by a hash of keys.

    A filter, not a top-n: no task or driver gathers n rows of every task.
    Repeats of a row are chosen alike; a limit of 2 n bounds what they add.
    """
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) < int(n / total * (1 << 40))).limit(2 * n)


def trim() -> None:
    """Give the system back what a task's Python has freed; its worker waits for
    the next task and would else keep it. For the end of a function over batches."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh_name(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores behind as it takes to clash with no
    column of the tables; Spark doesn't tell case."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Maximal runs without ASCII white space; an empty array for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def range_ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ``rank`` (0, 1, ... in ``order``), without a one-task sort.

    Rows are range-partitioned by sampled splitters, numbered within their
    partition, and shifted by the counts of the partitions before; the only
    unpartitioned window runs over one row per partition. Equal rows get
    consecutive ranks in any order.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_local", local).join(F.broadcast(shift), "_part").withColumn("rank", F.col("_local") + F.col("_shift")).drop("_part", "_local", "_shift")
