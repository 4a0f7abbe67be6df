"""A bounded pool and a limiter over streams, with state in Spark's state store.

`pool` closes a shard's block by an event-time timer at its end: what was queued
for it, with voices that an earlier event put off to it, is decided on then, in
the order and by the rules of `folds.pool_fold`. An end event turns all sound
off: voices ring out for their release, and after ``tail`` blocks the shard is
closed, by a row that says how many were cut. `limited` follows a signal's gain
from batch to batch.

State is kept per shard or signal: the queue of blocks that aren't closed yet,
the pool (at most its cap), and a few numbers. A restart from the checkpoint
goes on where the last batch ended.

Defined cases: rows later than the watermark allows are dropped by Spark; those
of a block that is closed already count to the first open one, as do negative
frames to block 0; a null gain is 0; what comes behind a shard's end event is
dropped; a stream without end events leaves its last blocks open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import _POOL, _POOL_NAMES, Held, most_stolen

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = _POOL + ", cut long"
_NAMES = [*_POOL_NAMES, "cut"]
#: Rows of a shard's batch that are held at a time, before they go to its queue.
_ROWS = 1 << 20


def _with_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class PoolProcessor(StatefulProcessor):
    """A shard's pool: blocks are decided on as their timers expire."""

    def __init__(self, cap: int, most: int, steal: str, millis: int, release: int, tail: int):
        self.cap, self.most, self.steal, self.millis, self.release, self.tail = cap, most, steal, millis, release, tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A block's queue in parts, each written once and read once, when the block closes.
        self.queue = handle.getMapState("queue", "block long, part long", "idx array<long>, id array<long>, gain array<double>, ends array<long>")
        self.parts = handle.getMapState("parts", "block long", "n long")
        self.held = handle.getListState("held", "id long, gain double, ends long")
        # The first block that is open, and the one in which sound went off (-1: not yet).
        self.at = handle.getValueState("at", "open long, off long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, off = self.at.get() if self.at.exists() else (0, -1)
        silent, ended, waiting, n = off >= 0, None, [], 0
        for batch in rows:
            end = batch["kind"] == "end"
            if end.any():
                last = int(batch.loc[end, "block"].min())
                ended = last if ended is None else min(ended, last)
            if not silent:
                waiting.append(batch.loc[~end, ["block", "idx", "id", "gain", "ends"]])
                n += len(waiting[-1])
            if n >= _ROWS:
                self._queue(pd.concat(waiting, ignore_index=True), first)
                waiting, n = [], 0
        if n:
            self._queue(pd.concat(waiting, ignore_index=True), first)
        if ended is not None and not silent:
            off = max(ended, first)
            self.handle.registerTimer((off + self.tail + 1) * self.millis)
        self.at.update((first, off))
        yield pd.DataFrame(columns=_NAMES)

    def _queue(self, fresh: pd.DataFrame, first: int) -> None:
        fresh = fresh.assign(block=np.maximum(fresh["block"], first), gain=fresh["gain"].fillna(0.0))
        for block, g in fresh.groupby("block"):
            block = int(block)
            n = self.parts.getValue((block,))[0] if self.parts.containsKey((block,)) else 0
            if not n:
                self.handle.registerTimer((block + 1) * self.millis)
            self.queue.updateValue((block, n), tuple(g[c].tolist() for c in ("idx", "id", "gain", "ends")))
            self.parts.updateValue((block,), (n + 1,))

    def _due(self, block: int) -> tuple[np.ndarray, ...]:
        """Ids, gains and ends of a block that closes, in order; taken off the queue."""
        got = []
        for part in range(self.parts.getValue((block,))[0]):
            got.append([np.array(c, t) for c, t in zip(self.queue.getValue((block, part)), (np.int64, np.int64, float, np.int64), strict=True)])
            self.queue.removeKey((block, part))
        self.parts.removeKey((block,))
        idx, ids, gains, ends = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((ends, gains, ids, idx))
        return ids[order], gains[order], ends[order]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, off = self.at.get() if self.at.exists() else (0, -1)
        before = expiredTimerInfo.getExpiryTimeInMs() // self.millis  # blocks below are over
        out: list[tuple] = []
        if before > first:
            held = list(self.held.get()) if self.held.exists() else []
            pool = Held(*(np.array(c, t) for c, t in zip(zip(*held, strict=True), (np.int64, float, np.int64), strict=True))) if held else Held()
            silent = lambda ends: np.minimum(ends, off + self.release) if off >= 0 else ends
            # Timers expire in order of time, and each block in the queue has one.
            if self.parts.containsKey((before - 1,)):
                ids, gains, ends = self._due(before - 1)
                pool.ends = silent(pool.ends)
                out.append((key[0], before - 1, *pool.decide(before - 1, ids, gains, silent(ends), self.cap, self.most, self.steal), 0))
            pool.ends = silent(pool.ends)
            if off >= 0 and before > off + self.tail:
                pool.keep(pool.ends > off + self.tail)
                if len(pool.ids):
                    out.append((key[0], off + self.tail + 1, 0, 0, 0, 0, 0, len(pool.ids), 0, 0, len(pool.ids)))
                pool = Held()
            self._put(self.held, list(zip(pool.ids.tolist(), pool.gains.tolist(), pool.ends.tolist(), strict=True)))
            self.at.update((before, off))
        yield pd.DataFrame(out, columns=_NAMES)

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def pool(stream: DataFrame, cap: int, seconds: int, steal_percent: int = 25, steal: str = "quietest", release: int = 1, tail: int = 10, late: str = "0 seconds") -> DataFrame:
    """(shard, block, live, want, take, stolen, dropped, alive, want_e, take_e,
    cut) of each closed block of ``seconds``; cut counts voices that outlast the
    tail and is 0 but in the row that says so. ``stream`` is (shard, time, kind,
    block, idx, id, gain, ends): kind 'end' ends its shard, any other is a
    candidate of ``block``, which may be later than its time's."""
    _with_state(stream.sparkSession)
    processor = PoolProcessor(cap, most_stolen(cap, steal_percent, steal), steal, seconds * 1000, release, tail)
    rows = stream.select("shard", "time", "kind", "block", "idx", "id", "gain", "ends").withWatermark("time", late)
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_OUT, outputMode="append", timeMode="EventTime")


class LimiterProcessor(StatefulProcessor):
    """A signal's gain: down at once, up by a share of what is missing."""

    def __init__(self, coef: float):
        self.coef = coef

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gain = handle.getValueState("gain", "g double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("pos", kind="stable")
        g = self.gain.get()[0] if self.gain.exists() else 1.0
        out = np.empty(len(batch))
        for i, req in enumerate(batch["req"].fillna(1.0).tolist()):
            out[i] = g = min(req, g + (req - g) * self.coef)
        self.gain.update((float(g),))
        yield pd.DataFrame({"id": key[0], "pos": batch["pos"].to_numpy(), "gain": out})

    def close(self) -> None:
        pass


def limited(stream: DataFrame, coef: float) -> DataFrame:
    """(id, pos, gain) following ``req`` of a stream (id, pos, req), whose batches
    come in order of pos; a batch's rows of a signal are sorted in one task."""
    _with_state(stream.sparkSession)
    grouped = stream.select("id", "pos", "req").groupBy("id")
    return grouped.transformWithStateInPandas(statefulProcessor=LimiterProcessor(coef), outputStructType="id long, pos long, gain double", outputMode="append", timeMode="None")
