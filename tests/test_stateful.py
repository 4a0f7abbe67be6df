"""Streams with state against the batch operators, over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tonemill.operators import folds
from tonemill.streaming import live, stateful

SECONDS = 10
ROW = "shard long, time timestamp, kind string, block long, idx long, id long, gain double, ends long"


def candidates(seed, n=300):
    """In order of time; some are put off to a later block."""
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.expovariate(1.5)
        block = int(at // SECONDS) + rng.choice([0, 0, 0, 1, 3])
        rows.append((rng.randrange(3), at, "voice", block, i, i, rng.random(), block + rng.randrange(6)))
    return rows, at


def save(spark, rows, path):
    df = spark.createDataFrame([(r[0], float(r[1]), *r[2:]) for r in rows], ROW.replace("timestamp", "double"))
    df.withColumn("time", F.timestamp_seconds("time")).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, path, checkpoint, out, cap=8, **how):
    stream = stateful.pool(source(spark, path), cap, SECONDS, **how)
    q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", out).format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()


def test_pool_equals_the_batch_over_restarts(spark, tmp_path):
    rows, end = candidates(3)
    path, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    off, tail = int(end // SECONDS), 4
    for i in range(0, 200, 50):
        save(spark, rows[i : i + 50], path)
    run(spark, path, checkpoint, out, release=1, tail=tail)
    early = spark.read.parquet(out).count()
    # A new query from the checkpoint goes on; shards' end events come last, with times that close all blocks.
    save(spark, rows[200:], path)
    save(spark, [(s, end + 1000.0, "end", off, 0, 0, 0.0, 0) for s in range(3)], path)
    run(spark, path, checkpoint, out, release=1, tail=tail)
    got = spark.read.parquet(out)
    assert 0 < early < got.count()
    assert got.filter("cut > 0").count() == 0
    cand = spark.createDataFrame([(r[0], r[3], r[4], r[5], r[6], min(r[7], off + 1)) for r in rows], "shard long, block long, idx long, id long, gain double, ends long")
    want = sorted(tuple(r) for r in folds.pool_fold(cand, 8).collect())
    assert sorted(tuple(r)[:-1] for r in got.collect()) == want and sum(r[5] for r in want) > 3


def test_end_turns_sound_off_and_bounds_the_tail(spark, tmp_path):
    rows = [(0, 1.0, "voice", 0, 0, 0, 0.5, 10**6), (0, 2.0, "voice", 1, 1, 1, 0.5, 10**6), (0, 500.0, "end", 2, 0, 0, 0.0, 0), (1, 1.0, "voice", 0, 2, 2, 0.5, 3), (1, 500.0, "end", 1, 0, 0, 0.0, 0)]
    for name, release, cut in (("short", 1, []), ("long", 9, [(0, 7, 2)])):
        path, checkpoint, out = (str(tmp_path / name / n) for n in ("in", "checkpoint", "out"))
        save(spark, rows, path)
        run(spark, path, checkpoint, out, release=release, tail=4)
        got = spark.read.parquet(out).collect()
        assert sorted((r["shard"], r["block"], r["live"]) for r in got if not r["cut"]) == [(0, 0, 1), (0, 1, 2), (1, 0, 1)]
        assert [(r["shard"], r["block"], r["cut"]) for r in got if r["cut"]] == cut


def test_limiter_goes_on_over_restarts(spark, tmp_path):
    rng = random.Random(2)
    req = [(s, i, rng.choice([1.0, 1.0, 0.4, 0.7])) for i in range(200) for s in (0, 1)]
    path, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    for part in (req[:100], req[100:170], req[170:]):
        spark.createDataFrame(part, "id long, pos long, req double").coalesce(1).write.mode("append").parquet(path)
        stream = stateful.limited(spark.readStream.schema("id long, pos long, req double").parquet(path), 0.1)
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
    g, want = {0: 1.0, 1: 1.0}, {}
    for s, i, r in req:
        g[s] = min(r, g[s] + (r - g[s]) * 0.1)
        want[s, i] = g[s]
    got = {(r["id"], r["pos"]): r["gain"] for r in spark.read.parquet(out).collect()}
    assert got == pytest.approx(want) and len(got) == len(req)


def test_collected_pool_of_nothing(spark, tmp_path):
    path = str(tmp_path / "in")
    save(spark, [], path)
    assert live.collected(stateful.pool(source(spark, path), 8, SECONDS), "append").count() == 0


def test_registered_stream_equals_the_batch(spark):
    from tonemill import plans
    from tonemill.plans import files

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r)[:-1] for r in plans.QUERIES["stream_pool"](spark, sf).collect())
    rows = files.pool_rows(spark, sf)
    off = rows.groupBy("shard").agg(F.max("own").alias("off"))
    cand = rows.join(off, "shard").withColumn("ends", F.least("ends", F.col("off") + 1))
    want = sorted(tuple(r) for r in folds.pool_fold(cand, 40).collect())
    assert got == want and len(got) > 10


class Kept:
    """State in memory, of any kind, that counts the rows it hands out."""

    def __init__(self):
        self.rows, self.read = {}, 0

    def _given(self, rows):
        self.read += sum(len(r[0]) if isinstance(r[0], list) else 1 for r in rows)
        return rows

    exists = lambda self: bool(self.rows)
    clear = lambda self: self.rows.clear()
    update = lambda self, row: self.rows.update({0: [row]})
    put = lambda self, rows: self.rows.update({0: list(rows)})
    appendList = lambda self, rows: self.rows.setdefault(0, []).extend(rows)
    containsKey = lambda self, key: key in self.rows
    updateValue = lambda self, key, row: self.rows.update({key: [row]})
    removeKey = lambda self, key: self.rows.pop(key)
    getValue = lambda self, key: self._given(self.rows[key])[0]


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def state(self, name, *_):
        kept = self.states.setdefault(name, Kept())
        kept.get = (lambda: kept._given(kept.rows[0])[0]) if name == "at" else (lambda: iter(kept._given(kept.rows.get(0, []))))
        return kept

    getListState = getMapState = getValueState = state
    registerTimer = lambda self, at: self.timers.add(at)


def test_a_closing_block_reads_its_own_queue_only(monkeypatch):
    import types

    import pandas as pd

    monkeypatch.setattr(stateful, "_ROWS", 100, raising=False)
    handle = Handle()
    processor = stateful.PoolProcessor(8, 2, "quietest", 1000, 1, 4)
    processor.init(handle)
    rng = random.Random(1)
    rows = [("voice", i % 50, i, i, rng.random(), i % 50 + i % 3) for i in range(1000)]
    rng.shuffle(rows)
    batch = pd.DataFrame(rows, columns=["kind", "block", "idx", "id", "gain", "ends"])
    list(processor.handleInputRows((0,), iter([batch[:300], batch[300:]]), None))
    out = [r for t in sorted(handle.timers) for b in processor.handleExpiredTimer((0,), None, types.SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)) for r in b.itertuples(index=False)]
    assert [(r.block, r.want) for r in out] == [(b, 20) for b in range(50)]
    assert sum(r.take for r in out) > 50 and handle.states["queue"].read == 1000
    assert not handle.states["queue"].rows and not handle.states["parts"].rows
