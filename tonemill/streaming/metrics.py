"""What streams did, as a table: a row for each query, batch and metric.

Metrics are observed in the stream's own plan (`reports.observed`), so they cost
no second pass. A listener on the driver gets each batch's values and writes
them, a small file a batch, to a folder; `recorded` reads them back. It sees
numbers only, a few for each batch, never rows.

Defined cases: a batch that is run again after a failure replaces its file;
batches without rows that Spark doesn't report have none; a metric that is null
stays null; those that aren't numbers are passed over; an empty folder gives an
empty table.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.shared import fresh_path

SCHEMA = "stream string, run string, batch long, name string, metric string, value double, input_rows long, took_ms long"


class Recorder(StreamingQueryListener):
    """Writes the progress of the session's streams to a mounted folder."""

    def __init__(self, folder: str):
        self.folder = folder
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        lines = []
        for name, row in (p.observedMetrics or {}).items():
            for metric, value in row.asDict().items():
                if value is None or isinstance(value, int | float):
                    lines.append({"stream": str(p.id), "run": str(p.runId), "batch": p.batchId, "name": name, "metric": metric, "value": None if value is None else float(value), "input_rows": p.numInputRows, "took_ms": p.batchDuration})
        if lines:
            target = os.path.join(self.folder, f"{p.id}-{p.batchId}.json")
            with open(target + ".part", "w") as f:
                f.writelines(json.dumps(line) + "\n" for line in lines)
            os.replace(target + ".part", target)

    def wait(self, run: str, seconds: float = 30.0) -> None:
        """Until the listener has had a run's last event, which comes after the
        run has ended; raises after ``seconds``."""
        until = time.monotonic() + seconds
        while run not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError(f"no end of run {run} in {seconds} s")
            time.sleep(0.05)


@contextmanager
def recording(spark: SparkSession) -> Iterator[Recorder]:
    """A recorder for as long as the block lasts."""
    recorder = Recorder(os.path.dirname(fresh_path(spark, "progress")))
    spark.streams.addListener(recorder)
    try:
        yield recorder
    finally:
        spark.streams.removeListener(recorder)


def recorded(spark: SparkSession, recorder: Recorder) -> DataFrame:
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "*.json").json(recorder.folder)


def observe(stream: DataFrame, name: str, /, **metrics: Column) -> DataFrame:
    """stream, of which each batch's rows and ``metrics`` are reported."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])


def run(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Run a stream over all input there is into a table, and give its metrics."""
    spark = stream.sparkSession
    with recording(spark) as recorder:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        recorder.wait(str(query.runId))
        return recorded(spark, recorder)
