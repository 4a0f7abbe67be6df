"""Ordered folds: what depends on the step before it.

Rows are dealt by a key and sorted within their partition, and a task reads
them in order as Arrow batches, carrying a state of fixed size from row to row
(or from block to block). A key is never gathered: memory holds one batch, one
block's candidates and the state. Keys spread the work; within a key the
recurrence is sequential by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .pool import STRATA


def in_order(df: DataFrame, by: str, *order: str) -> DataFrame:
    return df.repartition(by).sortWithinPartitions(by, *order)


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of equal keys that follow each other, across borders of batches."""
    rest: pd.DataFrame | None = None
    for b in batches:
        if rest is not None:
            b = pd.concat([rest, b], ignore_index=True)
        if b.empty:
            continue
        change = (b[keys] != b[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
        for lo, hi in zip(change[:-1], change[1:], strict=True):
            yield tuple(b[keys].iloc[lo]), b.iloc[lo:hi]
        rest = b.iloc[change[-1] :]
    if rest is not None and not rest.empty:
        yield tuple(rest[keys].iloc[0]), rest


def loudness(gain: np.ndarray) -> np.ndarray:
    """`functions.numbers.gain_rank`: 15 bits of the gains as 32-bit floats."""
    return np.where(gain > 0, gain.astype(np.float32).view(np.uint32) >> 16 & 0x7FFF, 0).astype(np.int64)


def loudest(gain: np.ndarray, take: int) -> np.ndarray:
    """Places of the ``take`` to admit: the loudest of each even stratum."""
    want = len(gain)
    strata = min(take, STRATA)
    if take >= want:
        return np.arange(want)
    idx = np.arange(want)
    stratum = ((idx + 1) * strata - 1) // want
    order = np.lexsort((-idx, -gain, stratum))
    rank = np.arange(want) - np.searchsorted(stratum[order], stratum[order], "left")
    quota = ((stratum[order] + 1) * take) // strata - (stratum[order] * take) // strata
    return np.sort(order[rank < quota])


class Held:
    """What a pool holds: ids, gains and last blocks of its voices."""

    def __init__(self, ids: np.ndarray | None = None, gains: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.ids = np.zeros(0, np.int64) if ids is None else ids
        self.gains = np.zeros(0) if gains is None else gains
        self.ends = np.zeros(0, np.int64) if ends is None else ends

    def keep(self, which: np.ndarray) -> None:
        self.ids, self.gains, self.ends = self.ids[which], self.gains[which], self.ends[which]

    def decide(self, block: int, ids: np.ndarray, gains: np.ndarray, ends: np.ndarray, cap: int, most: int, steal: str) -> tuple:
        """A block's candidates, in order: (live, want, take, stolen, dropped,
        alive, want_e, take_e), the pool being what is left. Voices that have
        ended are gone first, then as many are stolen as the cap asks for."""
        self.keep(self.ends >= block)
        queued, live, rank = len(ids), len(self.ids), loudness(gains)
        want = min(queued, cap)
        need = max(min(live + want - cap, live, most), 0)
        take = want if live + want <= cap else min(want, cap - (live - need))
        if need:
            quiet = np.lexsort((self.ids, np.floor(np.clip(self.gains, 0, 1) * 65535))) if steal == "quietest" else np.argsort(self.ids, kind="stable")
            stay = np.ones(live, bool)
            stay[quiet[:need]] = False
            self.keep(stay)
        chosen = loudest(gains, take)
        self.ids, self.gains, self.ends = (np.concatenate([a, b[chosen]]) for a, b in ((self.ids, ids), (self.gains, gains), (self.ends, ends)))
        return (len(self.ids), queued, take, need, queued - take, live, int(rank.sum()), int(rank[chosen].sum()))


def most_stolen(cap: int, steal_percent: int, steal: str) -> int:
    return max(cap * steal_percent // 100, 1) if steal != "none" else 0


def pool_fold(cand: DataFrame, cap: int, steal_percent: int = 25, steal: str = "quietest") -> DataFrame:
    """Blocks of a bounded pool, one pool a shard: (shard, block, live, want,
    take, stolen, dropped, alive, want_e, take_e), live being what sounds at the
    block's end, alive what does when it decides, and the last two the summed
    ranks of loudness of what is queued and of what is taken.

    ``cand`` is (shard, block, idx, id, gain, ends): a voice sounds through
    block ``ends``. What a block takes depends on what the block before left,
    so blocks of a shard follow each other; voices that end are gone first,
    then as many of the quietest (or oldest) are stolen as the cap asks for, up
    to ``steal_percent`` of it.
    """
    most = most_stolen(cap, steal_percent, steal)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        shard, pool = None, Held()
        for (key, block), g in groups(batches, ["shard", "block"]):
            if key != shard:
                shard, pool = key, Held()
            out.append((key, block, *pool.decide(block, *(g[c].to_numpy() for c in ("id", "gain", "ends")), cap, most, steal)))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=_POOL_NAMES)
                out = []
        yield pd.DataFrame(out, columns=_POOL_NAMES)

    rows = in_order(cand.select("shard", "block", "idx", "id", "gain", "ends"), "shard", "block", "idx")
    return rows.mapInPandas(fold, _POOL)


_POOL = "shard long, block long, live long, want long, take long, stolen long, dropped long, alive long, want_e long, take_e long"
_POOL_NAMES = [c.split(" ")[0] for c in _POOL.split(", ")]


def _by_signal(signal: DataFrame, columns: list[str], start: Callable[[], object], step: Callable, out: str) -> DataFrame:
    """signal (id, pos, ...) row by row in order of pos, with a state per id.
    ``step`` takes the state and a batch's columns and gives the results."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = None, None
        for b in batches:
            if b.empty:
                continue
            ids = b["id"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            parts = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if state is None or ids[lo] != last:
                    state, last = start(), ids[lo]
                got = step(state, *(b[c].to_numpy()[lo:hi] for c in columns))
                parts.append(pd.DataFrame({"id": ids[lo:hi], "pos": b["pos"].to_numpy()[lo:hi], **got}))
            yield pd.concat(parts)

    return in_order(signal.select("id", "pos", *columns), "id", "pos").mapInPandas(fold, out)


def follow(signal: DataFrame, attack: float, falloff: float, least: float = 0.4, velocity_limit: float | None = None) -> DataFrame:
    """(id, pos, l, r): each channel over its own followed loudness, halved.
    Loudness rises over ``attack`` frames and falls over ``falloff``, never
    below ``least``. With ``velocity_limit`` the output's fast changes are held
    to it, too; the followed change reads the output, hence the fold."""

    def start() -> list:
        return [1.0, 1.0, 0.0, 0.0, True]

    def one(s: list, c: int, x: float) -> float:
        loud, a = s[c], abs(x)
        w = falloff if loud > a else attack
        s[c] = loud = max((loud * w + a) / (w + 1), least)
        y = x / loud / 2
        if not s[4]:
            d, v = abs(x - y), s[2 + c]
            w = falloff if v > d else attack
            s[2 + c] = (v * w + d) / (w + 1)
        if velocity_limit is not None and s[2 + c] > velocity_limit:
            y = y / s[2 + c] * velocity_limit
        return y

    def step(s: list, left: np.ndarray, right: np.ndarray) -> dict:
        out = np.empty((len(left), 2))
        for i, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            out[i] = one(s, 0, x), one(s, 1, y)
            s[4] = False
        return {"l": out[:, 0], "r": out[:, 1]}

    return _by_signal(signal, ["l", "r"], start, step, "id long, pos long, l double, r double")


def two_stage_release(signal: DataFrame, fast: float, slow_down: float = 0.0, slow_up: float = 0.0) -> DataFrame:
    """(id, pos, gain) following ``ma``: a slow stage that settles on sustained
    levels, if slow_down is above 0, and a fast one for what it leaves, which
    goes down at once. The product never exceeds ma."""

    def step(s: list, ma: np.ndarray) -> dict:
        slow, quick = s
        out = np.empty(len(ma))
        for i, m in enumerate(ma.tolist()):
            if slow_down > 0:
                slow = min(max(slow + (m - slow) * (slow_down if m < slow else slow_up), 1e-9), 1.0)
            need = min(m / slow, 1.0)
            quick = need if need < quick else min(quick + (need - quick) * fast, need)
            out[i] = min(slow * quick, m)
        s[:] = slow, quick
        return {"gain": out}

    return _by_signal(signal, ["ma"], lambda: [1.0, 1.0], step, "id long, pos long, gain double")
