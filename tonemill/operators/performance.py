"""A performance: events and a bank of regions to a mix.

The plan has stages, each a table that the next one joins by what it shares:

- `control_rows`: a channel's events in order make, for each block in which any
  falls, the bend, gains and variant at the start of every gate tile, and each
  note's preset and variant;
- `sounding`: gates give each note its release, presets and zones its layers:
  one row a voice, with its pitch as a 32.32 step and its loudness;
- `admitted`: blocks of the bounded pool in order, each deciding on its queue by
  the voices that still live; where all voices fit, there is nothing to decide;
- the kernel: voices are dealt to stretches of blocks by where they start, each
  with the controls of its voices' channels while they live. A task goes through
  its blocks in order and holds the voices that live then; a voice is sent once,
  not once a block. Within a gate tile nothing changes but the envelope and the
  filter, so a tile's frames of all voices are worked out at once;
- `brickwall`: the limiter, over the summed mix.

Events are (channel, seq, frame, kind, a, b), frames falling nowhere along seq.
A release, a bend or a gain is heard from the gate tile after its event's on. At
the end of the events all sound goes off; what still rings is heard for up to
TAIL seconds, and voices that even then live are reported by `tail`.

Defined cases: notes whose preset has no zone for them are silent; voices of
empty samples don't exist; a loop that ends before it has two frames is none;
unknown kinds change nothing; no events give an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import numbers
from ..sources.shared import written
from . import channels, signal, zones
from .folds import groups, in_order, loudest, loudness

FLOOR, TAIL = 1e-5, 60.0
#: Voices are dealt to shares of some SHARE each: where the pool decides, those of
#: a stretch of blocks, STRETCH or as many as make MOST_TASKS; else LEAST_SHARES at least.
SHARE, LEAST_SHARES, STRETCH, MOST_TASKS = 4096, 8, 16, 4096
ONE = 1 << 24
_ABREAST, _NEVER = 64, 1 << 62
_CONTROL = "channel long, block long, seq long, bank long, program long, variant long, bends array<long>, lefts array<double>, rights array<double>, variants array<long>, vib double, trem double, rate double, turn double"
_CONTROL_NAMES = [c.split(" ")[0] for c in _CONTROL.split(", ")]
#: A region: seconds, cents and centibels as a bank has them; see `sounding`.
REGION = "preset long, region long, key_lo long, key_hi long, vel_lo long, vel_hi long, sample long, frames long, root long, cents_a_key double, tune double, attenuation double, vel_track double, pan double, delay double, attack double, hold double, decay double, sustain double, release double, cutoff double, resonance double, loop_start long, loop_end long, loop string"
_VOICE = {"voice": "int64", "channel": "int64", "start": "int64", "release_tile": "int64", "step": "int64", "variant": "int64", "frames": "int64", "sample": "int64", "loop_start": "int64", "loop_end": "int64", "loops": "int64", "stop": "int64", "gain_l": "float64", "gain_r": "float64", "attack": "float64", "hold": "float64", "decay": "float64", "sustain": "float64", "release": "float64", "cutoff": "float64", "resonance": "float64"}


def bend_factor(semitones: float) -> int:
    """`functions.numbers.bend_factor` of a range of semitones."""
    if not math.isfinite(semitones):
        return ONE
    return max(int(min(2.0 ** min(semitones / 12, 60) * ONE, 2.0**32 - 1) + 0.5), 1)


def variant_of(sound: dict[int, int]) -> int:
    """The five sound controllers, each in 64 steps, as one number."""
    return sum((v >> 1) << 6 * i for i, v in enumerate(sound.values()))


class _Rows:
    """A channel's controls by tile, block after block."""

    def __init__(self, channel: int, cfg: Config):
        self.channel, self.cfg, self.state = channel, cfg, channels.Controls(channel)
        self.block: int | None = None
        self.now, self.turning = self.values(), _Channel(cfg)

    def values(self) -> tuple[int, float, float, int]:
        s = self.state
        return (bend_factor(s.bend / 8192 * s.bend_range), *s.gains(), variant_of(s.sound))

    def take(self, frame: int, kind: str, a: int, b: int) -> list[tuple]:
        """Rows that are done, as an event of a later block has come."""
        block, inside = divmod(frame, self.cfg.block_frames)
        done = self.finish() if block != self.block else []
        if done or self.block is None:
            self.block, self.tiles = block, []
        upto = inside // self.cfg.gate_frames + 1
        self.tiles += [self.now] * (upto - len(self.tiles))
        self.state.take(kind, a, b)
        self.now = self.values()
        return done

    def finish(self) -> list[tuple]:
        if self.block is None:
            return []
        s, n = self.state, self.cfg.block_frames // self.cfg.gate_frames
        # One more than there are tiles: what holds from the next block on.
        tiles = self.tiles + [self.now] * (n + 1 - len(self.tiles))
        vib, rate = s.wheel() * s.vibrato_depth / 64 * 50, 5 * 2.0 ** ((s.vibrato_rate - 64) / 32)
        self.turning.to(self.block)
        self.turning.rate = rate
        return [(self.channel, self.block, None, None, None, None, *map(list, zip(*tiles, strict=True)), vib, s.tremolo / 127 * 0.25, rate, self.turning.turn)]


def control_rows(ev: DataFrame, cfg: Config) -> DataFrame:
    """Rows of seq, bank, program and variant for each note-on; and of block,
    bends, lefts, rights, variants (by tile, and one for what comes after), vib,
    trem, rate and turn (the modulation's at the block's start) for each block in
    which a channel has other events."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: _Rows | None = None
        for b in batches:
            out: list[tuple] = []
            for channel, seq, frame, kind, a, value in b.itertuples(index=False):
                if rows is None or channel != rows.channel:
                    out += rows.finish() if rows else []
                    rows = _Rows(channel, cfg)
                if kind == "note_on":
                    out.append((channel, None, seq, *rows.state.preset, rows.now[3], None, None, None, None, None, None, None, None))
                else:
                    out += rows.take(frame, kind, a, value)
            yield pd.DataFrame(out, columns=_CONTROL_NAMES)
        if rows:
            yield pd.DataFrame(rows.finish(), columns=_CONTROL_NAMES)

    used = ev.filter(F.col("kind").isin("note_on", "controller", "program", "bend")).select("channel", "seq", "frame", "kind", "a", "b")
    return in_order(used.fillna(0, ["a", "b"]), "channel", "seq").mapInPandas(fold, _CONTROL)


def sounding(ev: DataFrame, notes: DataFrame, regions: DataFrame, presets: DataFrame, cfg: Config, last: int) -> DataFrame:
    """A row for each voice: a note's layers in its preset, from gates, zones and
    the notes' rows of `control_rows`; ``last`` is the last event's frame."""
    spans = channels.note_spans(channels.pedalled(ev))
    frame_of = lambda name, frame: ev.select(F.col("seq").alias(name), F.col("frame").alias(frame))
    ons = ev.filter("kind = 'note_on'").select(F.col("seq").alias("on_seq"), "frame", F.col("b").cast("long").alias("vel"))
    held = spans.join(ons, "on_seq").join(frame_of("off_seq", "off_frame"), "off_seq", "left")
    tile = F.expr(f"coalesce(off_frame, {last}) div {cfg.gate_frames} + 1")
    asked = notes.select(F.col("seq").alias("on_seq"), "bank", "program", "variant")
    chosen = zones.with_fallback(held.withColumn("release_tile", tile).join(asked, "on_seq"), presets).withColumn("preset", F.col("preset").cast("long"))
    hit = ["on_seq", "channel", "frame", "release_tile", "variant"]
    layers = zones.lookup(chosen, regions.select("preset", "region", "key_lo", "key_hi", "vel_lo", "vel_hi"), "region", cfg.max_layers, [*hit, "key", "vel"])
    v = layers.join(regions.drop("preset", "key_lo", "key_hi", "vel_lo", "vel_hi"), "region")
    ratio = numbers.pitch_ratio(F.col("key"), F.col("root"), F.col("cents_a_key"), F.col("tune"))
    quiet = F.col("attenuation") + numbers.velocity_attenuation(F.col("vel"), F.col("vel_track"))
    left, right = numbers.pan_gains(F.col("pan"))
    gain = numbers.centibels_to_gain(quiet)
    start = (F.col("frame") + F.floor(F.col("delay") * cfg.sample_rate)).cast("long")
    whole = F.col("loop_end") > F.col("loop_start") + 1
    v = v.filter(zones.sounds(F.col("frames"), ratio)).withColumns({
        "voice": F.col("on_seq") * cfg.max_layers + F.col("layer") - 1,
        "start": start,
        "late": F.expr(f"frame div {cfg.block_frames}") < F.expr(f"cast(frame + floor(delay * {cfg.sample_rate}) as bigint) div {cfg.block_frames}"),
        "step": F.floor(ratio * float(1 << 32)).cast("long"),
        "gain_l": gain * left,
        "gain_r": gain * right,
        "loops": F.when((F.col("loop") == "continuous") & whole, 1).when((F.col("loop") == "until_release") & whole, 2).otherwise(0).cast("long"),
        "stop": F.lit(-1).cast("long"),
        "block": F.expr(f"cast(frame + floor(delay * {cfg.sample_rate}) as bigint) div {cfg.block_frames}"),
    })
    return v.select("block", "late", *_VOICE)


def _constants(v: dict[str, np.ndarray], at: np.ndarray, cfg: Config, dry: bool) -> None:
    """Per-frame constants of the voices ``at``, by region and variant; those of
    the filter are of no use to a dry run."""
    q, release, attack, cutoff, decay = ((v["variant"][at] >> 6 * i & 63) * 2.0 for i in range(5))
    rate = float(cfg.sample_rate)

    def timed(seconds: np.ndarray, value: np.ndarray) -> np.ndarray:
        d = value - 64
        return np.where(d <= 0, seconds * 2.0 ** (d / 8), seconds + 6e-5 * d**3)

    def falling(seconds: np.ndarray, value: np.ndarray) -> np.ndarray:
        frames = np.maximum(np.maximum(timed(seconds, value), np.minimum(seconds, 0.004)) * rate, 1)
        return 10.0 ** (-5 / frames)

    up = timed(v["attack"][at], attack) * rate
    v["up"][at] = np.where(up < 1, 1.0, 1 / np.maximum(up, 1e-9))
    v["top"][at] = 1 + v["hold"][at] * rate * v["up"][at]
    v["fall"][at] = falling(v["decay"][at], decay)
    v["let"][at] = falling(v["release"][at], release)
    if dry:
        return
    cents = v["cutoff"][at] + (cutoff - 64) * 75
    hz = 8.176 * 2.0 ** (cents / 1200)
    w = np.clip(hz / rate, 1e-5, 0.49) * 2 * np.pi
    peak = np.maximum(10.0 ** (((v["resonance"][at] + np.maximum(q - 64, 0) * 240 / 63) / 10 - 3.01) / 20), 0.001)
    alpha, level = np.sin(w) / (2 * peak), np.sqrt(np.sqrt(0.5) / peak)
    v["filtered"][at] = (cents < 13_500) & (hz > 20) & (hz < rate * 0.49)
    v["b0"][at], v["b1"][at] = level * (1 - np.cos(w)) / 2 / (1 + alpha), level * (1 - np.cos(w)) / (1 + alpha)
    v["a1"][at], v["a2"][at] = -2 * np.cos(w) / (1 + alpha), (1 - alpha) / (1 + alpha)


def _wrapped(v: dict[str, np.ndarray], phase: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Where the voices ``w`` read, in their loops if they are behind its end."""
    start, end = v["loop_start"][w] << 32, v["loop_end"][w] << 32
    return np.where(phase >= end, start + (phase - start) % np.maximum(end - start, 1 << 32), phase)


class Pool:
    """The voices of a task that live, and what a tile makes of them. Stages: 0
    attack, 1 decay, 2 sustain, 3 release, 4 gone."""

    STATE = {"stage": 0, "phase": 0, "level": 0.0, "z1": 0.0, "z2": 0.0, "base": 0, "up": 0.0, "top": 0.0, "fall": 0.0, "let": 0.0, "b0": 0.0, "b1": 0.0, "a1": 0.0, "a2": 0.0, "filtered": False}

    def __init__(self, cfg: Config, dry: bool):
        self.cfg, self.dry, self.pcm, self.bases = cfg, dry, np.zeros(1), {}
        self.v = {k: np.zeros(0, t) for k, t in _VOICE.items()} | {k: np.zeros(0, type(d)) for k, d in self.STATE.items()}
        self.started = 0  # those of earlier blocks

    def __len__(self) -> int:
        return len(self.v["voice"])

    def add_samples(self, samples: pd.DataFrame) -> None:
        parts, at = [self.pcm], len(self.pcm)
        for sample, pcm in zip(samples["sample"], samples["pcm"], strict=True):
            self.bases[int(sample)] = at
            parts.append(np.asarray(pcm, float))
            at += len(pcm)
        self.pcm = np.concatenate(parts)

    def add(self, rows: pd.DataFrame) -> None:
        """Voices of a block, behind those that have started, by their start."""
        old, n, rows = self.v, len(rows), rows.sort_values("start", kind="stable")
        fresh = {k: rows[k].to_numpy().astype(t) for k, t in _VOICE.items()} | {k: np.full(n, d) for k, d in self.STATE.items()}
        if not self.dry:
            fresh["base"] = np.array([self.bases[s] for s in fresh["sample"].tolist()], np.int64)
        _constants(fresh, np.arange(n), self.cfg, self.dry)
        self.v = {k: np.concatenate([old[k], fresh[k]]) for k in old}

    def keep(self, which: np.ndarray) -> None:
        self.started = int(which[: self.started].sum())
        self.v = {k: c[which] for k, c in self.v.items()}

    def _turning(self, all_: dict[str, np.ndarray], which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the voices ``which``: level after each of 0..n advances, the advance
        at which a voice dies, 2 n + 2 if it doesn't, stage after each; multiplied
        and added up one by one, as frames do it."""
        v, m = {c: all_[c][which] for c in ("stage", "level", "up", "top", "fall", "let", "sustain")}, np.arange(n + 1)[:, None]
        stage, never = v["stage"], 2 * n + 2
        rising = np.flatnonzero(stage == 0)
        level = np.empty((n + 1, len(which)))
        level[0] = np.where(stage == 0, 1.0, v["level"])
        level[1:] = np.where(stage == 3, v["let"], v["fall"])
        level = np.multiply.accumulate(level, axis=0)
        # When a fall has come to its end; of the least levels only what is behind the first counts.
        low = level[1:] <= np.where(stage == 3, FLOOR, np.maximum(v["sustain"], FLOOR))
        settled = np.where(low[-1], low.argmax(0) + 1, never)
        attacked = np.zeros(len(which), int)
        if len(rising):
            rise = np.empty((n + 1, len(rising)))
            rise[0], rise[1:] = v["level"][rising], v["up"][rising]
            rise = np.add.accumulate(rise, axis=0)
            attacked[rising] = first = (rise[1:] >= v["top"][rising]).argmax(0) + 1
            since = m - first
            level[:, rising] = np.where(since < 0, rise, np.take_along_axis(level[:, rising], np.maximum(since, 0), 0))
        ended = attacked + settled
        over = (m >= ended) & (stage < 2)
        level = np.where(over, v["sustain"], level)
        after = np.where(over, 2, np.where((stage == 0) & (m >= attacked), 1, stage))
        return level, np.where((stage == 3) | (v["sustain"] <= FLOOR), ended, never), after

    def _envelope(self, v: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Levels (n + 1 x voices) and deaths as `_turning` has them, the voices
        whose stage ends within n advances, and those' stages. Levels only rise or
        only fall within a stage, so the last one tells which it ends for."""
        stage = v["stage"]
        level = np.empty((n + 1, len(stage)))
        level[0] = v["level"]
        level[1:] = np.where(stage == 3, v["let"], np.where(stage == 1, v["fall"], 1.0))
        level = np.multiply.accumulate(level, axis=0)
        rising = np.flatnonzero(stage == 0)
        if len(rising):
            rise = np.empty((n + 1, len(rising)))
            rise[0], rise[1:] = v["level"][rising], v["up"][rising]
            level[:, rising] = np.add.accumulate(rise, axis=0)
        least = np.where(stage == 3, FLOOR, np.where(stage == 1, np.maximum(v["sustain"], FLOOR), -1.0))
        turning = np.flatnonzero(((stage == 0) & (level[n] >= v["top"])) | (level[n] <= least))
        dies, after = np.full(len(stage), 2 * n + 2), np.zeros((n + 1, 0), int)
        if len(turning):
            level[:, turning], dies[turning], after = self._turning(v, turning, n)
        return level, dies, turning, after

    def follow(self, first: int, bends: np.ndarray, variants: np.ndarray) -> None:
        """Without sound through a block's tiles, ``first`` being its first: stages,
        levels and phases as `tile` makes them, of pools that nothing is stolen from."""
        v, n, tiles = self.v, self.cfg.gate_frames, len(bends)
        at = first + np.arange(tiles)
        begun = self.started + np.searchsorted(v["start"][self.started :], (at + 1) * n)
        step = (v["step"] >> 24) * bends + ((v["step"] & (ONE - 1)) * bends >> 24)
        variant = np.where(at[:, None] > v["start"] // n, variants, v["variant"])
        # All constants that change in the block, in order of tiles.
        tile, of = np.nonzero(variant != np.concatenate([v["variant"][None, :], variant[:-1]]))
        cut = np.searchsorted(tile, np.arange(tiles + 1))
        fresh = {c: v[c][of] for c in ("attack", "hold", "decay", "release", "up", "top", "fall", "let")} | {"variant": variant[tile, of]}
        _constants(fresh, np.arange(len(of)), self.cfg, True)
        frames, late = v["frames"] << 32, self.started
        for t, m in enumerate(begun.tolist()):
            if not m:
                continue
            changed = slice(cut[t], cut[t + 1])
            for c in ("up", "top", "fall", "let"):
                v[c][of[changed]] = fresh[c][changed]
            stage, level, phase = (v[c][:m] for c in ("stage", "level", "phase"))
            letting = np.flatnonzero((v["release_tile"][:m] <= at[t]) & (stage < 3))
            level[letting] = np.minimum(level[letting], 1.0)
            stage[letting] = 3
            room = np.full(m, n)
            room[late:] -= np.maximum(v["start"][late:m] - at[t] * n, 0)
            late = m
            looped = (v["loops"][:m] == 1) | ((v["loops"][:m] == 2) & (stage < 3))
            alone = np.flatnonzero(~looped)
            over = alone[frames[alone] - phase[alone] <= step[t, alone] * (room[alone] - 1)]
            moving = np.flatnonzero((stage != 2) & (stage < 4))
            if len(moving):
                levels, dies, turning, after = self._envelope({c: v[c][moving] for c in ("stage", "level", "up", "top", "fall", "let", "sustain")}, n)
                done = room[moving]
                level[moving] = levels[done, np.arange(len(moving))]
                stage[moving[turning]] = after[done[turning], np.arange(len(turning))]
                stage[moving[dies <= done]] = 4
            stage[over] = 4
            phase += step[t, :m] * room
            w = np.flatnonzero(looped & (phase >= v["loop_end"][:m] << 32))
            phase[w] = _wrapped(v, phase[w], w)
        v["variant"][:] = variant[-1]

    def tile(self, t: int, bend: np.ndarray, left: np.ndarray, right: np.ndarray, variant: np.ndarray, mix: np.ndarray) -> None:
        """Through tile t, under each voice's controls; adds to mix (2 x frames)."""
        n, cfg = self.cfg.gate_frames, self.cfg
        m = int(np.searchsorted(self.v["start"][self.started :], (t + 1) * n)) + self.started
        if not m:
            return
        # Those that have started; the arrays are parts of the pool's and written in place.
        v = {k: c[:m] for k, c in self.v.items()}
        bend, left, right, variant = bend[:m], left[:m], right[:m], variant[:m]
        letting = np.flatnonzero((v["release_tile"] <= t) & (v["stage"] < 3))
        v["level"][letting] = np.minimum(v["level"][letting], 1.0)
        v["stage"][letting] = 3
        changed = np.flatnonzero((v["variant"] != variant) & (t > v["start"] // n))
        if len(changed):
            v["variant"][changed] = variant[changed]
            _constants(v, changed, cfg, False)
        skipped = np.clip(v["start"] - t * n, 0, n)
        step = (v["step"] >> 24) * bend + ((v["step"] & (ONE - 1)) * bend >> 24)
        looped = (v["loops"] == 1) | ((v["loops"] == 2) & (v["stage"] < 3))
        ahead = (v["frames"] << 32) - v["phase"]
        ends = np.where(looped | (step == 0) & (ahead > 0), 2 * n + 2, np.maximum(-(-ahead // np.maximum(step, 1)), 0))
        faded = np.where(v["stop"] >= 0, np.maximum(v["stop"] + cfg.steal_fade_frames - 1 - t * n - skipped, 0), 2 * n + 2)
        ends = np.minimum(ends, faded)
        level, dies, turning, after = self._envelope(v, n)
        room = n - skipped
        alive = v["stage"] < 4
        gone = alive & ((ends < room) | (dies <= room))
        played = np.where(alive, np.minimum(np.minimum(ends, room), dies), 0)
        self._sound(v, t, step, looped, level, dies, skipped, played, left, right, mix)
        done = np.minimum(played, n)
        phase = v["phase"] + step * done
        w = np.flatnonzero(looped & (phase >= v["loop_end"] << 32))
        phase[w] = _wrapped(v, phase[w], w)
        v["phase"][:], v["level"][:] = phase, level[done, np.arange(m)]
        if len(turning):
            v["stage"][turning] = after[done[turning], np.arange(len(turning))]
        v["stage"][gone] = 4

    def _sound(self, v: dict[str, np.ndarray], t: int, step: np.ndarray, looped: np.ndarray, level: np.ndarray, dies: np.ndarray, skipped: np.ndarray, played: np.ndarray, left: np.ndarray, right: np.ndarray, mix: np.ndarray) -> None:
        """Adds to mix what is heard in tile t; a row a frame, a column a voice."""
        n = self.cfg.gate_frames
        frame, y = np.arange(n)[:, None], np.empty((n, len(step)))
        # Some voices at a time, so that what is held of them stays in the cache.
        for at in range(0, len(step), _ABREAST):
            c = slice(at, at + _ABREAST)
            phase, amp = v["phase"][c] + step[c] * frame, np.minimum(level[1:, c], 1.0)
            late = np.flatnonzero(skipped[c])
            if len(late):
                k = np.clip(frame - skipped[c][late], 0, n - 1)
                phase[:, late] = v["phase"][c][late] + step[c][late] * k
                amp[:, late] = np.minimum(np.take_along_axis(level[:, c][:, late], k + 1, 0), 1.0)
            w = np.flatnonzero(looped[c] & (phase[-1] >= v["loop_end"][c] << 32))
            if len(w):
                phase[:, w] = _wrapped(v, phase[:, w], w + at)
            last = v["frames"][c] - 1
            i = np.minimum(phase >> 32, last)
            j = i + 1
            j = np.where(j >= np.where(looped[c], v["loop_end"][c], _NEVER), v["loop_start"][c], np.minimum(j, last, out=j))
            i += v["base"][c]
            j += v["base"][c]
            phase &= 0xFFFF_FFFF
            one = self.pcm.take(i)
            two = self.pcm.take(j)
            two -= one
            two *= phase / float(1 << 32)
            two += one
            np.multiply(two, amp, out=y[:, c])
        # Voices that sound in a part of the tile; the frame of a death is silent.
        part = np.flatnonzero((skipped > 0) | (played < n) | (dies <= n))
        k = frame - skipped[part]
        inside = (k >= 0) & (k < played[part])
        y[:, part] = np.where(inside & (k + 1 < dies[part]), y[:, part], 0.0)
        f = np.flatnonzero(v["filtered"])
        if len(f):
            # Before a voice starts all is 0 and stays so; behind its end nothing of it is used.
            b0, b1, a1, a2, z1, z2 = (v[c][f] for c in ("b0", "b1", "a1", "a2", "z1", "z2"))
            x = y[:, f]
            x0, x1, held = b0 * x, b1 * x, np.empty(len(f))
            add, times, less = np.add, np.multiply, np.subtract
            for p, q, yc in zip(x0, x1, x, strict=True):
                add(p, z1, yc)
                times(a1, yc, held)
                less(q, held, z1)
                add(z1, z2, z1)
                times(a2, yc, held)
                less(p, held, z2)
            v["z1"][f], v["z2"][f] = z1, z2
            y[:, f] = x
            # What the filter makes of the silent frame is heard.
            y[:, part] = np.where(inside, y[:, part], 0.0)
        stolen = np.flatnonzero(v["stop"] >= 0)
        if len(stolen):
            d = t * n + frame + 1 - v["stop"][stolen]
            y[:, stolen] *= np.clip(1 - d / self.cfg.steal_fade_frames, 0, 1)
        mix[0] += y @ (v["gain_l"] * left)
        mix[1] += y @ (v["gain_r"] * right)


class _Channel:
    """A channel's controls from block to block."""

    def __init__(self, cfg: Config):
        self.rest = (ONE, 1.0, 1.0, variant_of(dict.fromkeys(range(5), 64)))
        self.vib, self.trem, self.rate, self.turn, self.at = 0.0, 0.0, 5.0, 0.0, 0
        self.by_tile, self.tiles = cfg.gate_frames / cfg.sample_rate, cfg.block_frames // cfg.gate_frames

    def enter(self, row: dict) -> None:
        """What holds from the block of ``row`` on, whatever was before."""
        self.vib, self.trem, self.rate, self.turn, self.at = (row[c] for c in ("vib", "trem", "rate", "turn", "at"))
        self.rest = tuple(row[c][-1] for c in ("bends", "lefts", "rights", "variants"))

    def to(self, block: int) -> None:
        """The modulation's turn goes on through blocks in which nothing is asked."""
        self.turn = (self.turn + self.rate * self.by_tile * self.tiles * (block - self.at)) % 1
        self.at = block

    def rows(self, row: dict | None) -> list[np.ndarray]:
        """Bends, left and right gains and variants of a block's tiles, with
        what a block's last state makes of modulation."""
        rows = [np.asarray(row[c]) for c in ("bends", "lefts", "rights", "variants")] if row is not None else [np.full(self.tiles + 1, c) for c in self.rest]
        if row is not None:
            self.vib, self.trem, self.rate, self.rest = row["vib"], row["trem"], row["rate"], tuple(c[-1] for c in rows)
        bends, lefts, rights, variants = (c[:-1] for c in rows)
        turns = np.add.accumulate(np.r_[self.turn, np.full(self.tiles, self.rate * self.by_tile)])
        s = np.sin(turns[:-1] % 1 * 2 * np.pi)
        if self.vib > 0:
            factors = np.array([bend_factor(self.vib * x / 100) for x in s.tolist()])
            bends = np.maximum(bends.astype(np.int64) * factors >> 24, 1)
        if self.trem > 0:
            lefts, rights = (g * (1 - self.trem + self.trem * s) for g in (lefts, rights))
        self.turn, self.at = turns[-1] % 1, self.at + 1
        return [bends, lefts, rights, variants]


class _Task:
    """Goes through a share's blocks in order."""

    def __init__(self, cfg: Config, dry: bool, until: int):
        self.cfg, self.until, self.pool, self.at = cfg, until, Pool(cfg, dry), 0
        self.tiles = cfg.block_frames // cfg.gate_frames
        self.channels: dict[int, _Channel] = {}
        self.out: list[tuple] = []

    def to(self, block: int) -> None:
        """Through all blocks before ``block`` that any voice sounds in."""
        while self.at < block and len(self.pool):
            self.play({})
        self.at = block

    def play(self, control: dict[int, dict]) -> None:
        """A block, by its tiles' controls or, for channels without, what held before."""
        pool = self.pool
        asked, inverse = np.unique(pool.v["channel"], return_inverse=True)
        rows: dict[int, list[np.ndarray]] = {}
        for c in {*asked.tolist(), *control}:
            of = self.channels.setdefault(c, _Channel(self.cfg))
            of.to(self.at)
            rows[c] = of.rows(control.get(c))
        if len(pool):
            by = [np.stack([rows[c][i] for c in asked.tolist()], 1) for i in range(4)]
            if pool.dry:
                pool.follow(self.at * self.tiles, by[0][:, inverse], by[3][:, inverse])
                live = pool.v["stage"] < 4
                self.out.append((pool.v["voice"][~live], self.at))
                pool.keep(live)
            else:
                self.sound(by, inverse)
            pool.started = len(pool)
        self.at += 1

    def sound(self, by: list[np.ndarray], inverse: np.ndarray) -> None:
        pool, n, of = self.pool, self.cfg.gate_frames, [b[:, inverse] for b in by]
        mix = np.zeros((2, self.cfg.block_frames))
        for t in range(self.tiles):
            pool.tile(self.at * self.tiles + t, *(b[t] for b in of), mix[:, t * n : (t + 1) * n])
            live = pool.v["stage"] < 4
            # The dead go when they are many, and at the block's end.
            if t == self.tiles - 1 or 4 * live.sum() < 3 * len(pool):
                pool.keep(live)
                inverse = inverse[live]
                of = [b[:, inverse] for b in by]
        self.out.append((self.at, mix[0], mix[1], [], len(pool)))

    def finish(self) -> None:
        while len(self.pool) and self.at <= self.until:
            self.play({})
        if len(self.pool) and not self.pool.dry:
            self.out.append((self.at - 1, [], [], self.pool.v["voice"].tolist(), 0))
        elif len(self.pool):
            self.out.append((self.pool.v["voice"], self.until))


def _every(voices: DataFrame, control: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """What a task reads for a share's block: samples that are first used there
    (order 0), its control rows (1; -1 for what held before the first) and the
    voices that are born in it (2)."""
    every = voices.withColumn("order", F.lit(2)).unionByName(control, allowMissingColumns=True)
    if samples is not None:
        first = voices.groupBy("key", "sample").agg(F.min("block").alias("block"))
        every = every.unionByName(first.join(samples, "sample").select("key", "block", "sample", F.col("pcm").cast("array<double>").alias("pcm")).withColumn("order", F.lit(0)), allowMissingColumns=True)
    return every


def _routed(voices: DataFrame, control: DataFrame, last: int) -> DataFrame:
    """The control rows of each share: of its voices' channels, from the block in
    which the first of them is born to the one in which the last one ends, and
    what held before. voices has ``end``; no control is behind block ``last``."""
    reach = written(voices.groupBy("key", "channel").agg(F.min("block").alias("lo"), F.max("end").alias("hi")), "performance-reach")
    blocks = reach.filter(f"lo <= {last}").select("key", "channel", F.explode(F.sequence("lo", F.greatest("lo", F.least("hi", F.lit(last))))).alias("block"))
    own = blocks.join(control, ["channel", "block"]).select("key", "block", *_STATE, F.col("block").alias("at"), F.lit(1).alias("order"))
    # The last row of a channel before a share's: both in one order, shares behind the block before theirs.
    asked = control.select("channel", "block", F.lit(0).alias("ask")).unionByName(reach.select("channel", F.col("lo").alias("block"), F.lit(-1).alias("ask"), "key"), allowMissingColumns=True)
    w = Window.partitionBy("channel").orderBy("block", "ask").rowsBetween(Window.unboundedPreceding, -1)
    found = asked.withColumn("at", F.last(F.when(F.col("ask") == 0, F.col("block")), ignorenulls=True).over(w)).filter("ask < 0 and at is not null")
    before = found.select("key", "channel", F.col("block").alias("lo"), "at").join(control.withColumnRenamed("block", "at"), ["channel", "at"])
    return own.unionByName(before.select("key", F.col("lo").alias("block"), *_STATE, "at", F.lit(-1).alias("order")))


_STATE = ["channel", "bends", "lefts", "rights", "variants", "vib", "trem", "rate", "turn"]


def _controls(g: pd.DataFrame, order: int = 1) -> dict[int, dict]:
    rows = g.loc[g["order"] == order, [*_STATE, "at"]]
    return {int(c): dict(zip(rows.columns, row, strict=True)) for c, row in zip(rows["channel"], rows.itertuples(index=False), strict=True)}


def _played(voices: DataFrame, control: DataFrame, samples: DataFrame, cfg: Config, until: int, last: int, shares: int) -> DataFrame:
    """The kernel over shares: (block, ls, rs, cut, alive), a task's sums, the
    voices that live on behind ``until``, and how many do at a block's end."""
    out = "block long, ls array<double>, rs array<double>, cut array<long>, alive long"
    names = [c.split(" ")[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, task = None, None
        for (key, block), g in groups(batches, ["key", "block"]):
            if key != last:
                if task:
                    task.finish()
                    yield pd.DataFrame(task.out, columns=names)
                last, task = key, _Task(cfg, False, until)
            task.to(int(block))
            for c, row in _controls(g, -1).items():
                task.channels[c] = _Channel(cfg)
                task.channels[c].enter(row)
            task.pool.add_samples(g[g["order"] == 0])
            task.pool.add(g[g["order"] == 2])
            task.play(_controls(g))
            if len(task.out) > 16:
                yield pd.DataFrame(task.out, columns=names)
                task.out = []
        if task:
            task.finish()
            yield pd.DataFrame(task.out, columns=names)

    every = _every(voices.select("key", "block", *_VOICE), _routed(voices, control, last), samples)
    # A task a share: their work is frames, not bytes, so they aren't merged where rows are few.
    dealt = every.repartitionById(shares, F.col("key").cast("int")).sortWithinPartitions("key", "block", "order", "voice")
    return dealt.mapInPandas(run, out)


def admitted(voices: DataFrame, control: DataFrame, cfg: Config, until: int) -> DataFrame:
    """(voice, block, what): each voice's block where it is taken, where it is
    stolen, and where it ends otherwise. What a block takes depends on what the one before left, so one
    task goes through the blocks in order; it holds the pool, at most
    ``max_voices``, whose envelopes it follows without their sound, and one
    block's queue."""
    cap, most = cfg.max_voices, cfg.max_steal if cfg.steal != "none" else 0
    idx = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("late"), "voice"))
    queue = voices.withColumns({"key": F.lit(0).cast("long"), "idx": idx}).select("key", "block", "idx", *_VOICE)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, out = _Task(cfg, True, until), []
        for (_, block), g in groups(batches, ["key", "block"]):
            task.to(int(block))
            cands, v = g[g["order"] == 2], task.pool.v
            live, want, fit = len(task.pool), len(cands), min(len(cands), cap)
            need = max(min(live + fit - cap, live, most), 0)
            take = fit if live + fit <= cap else min(fit, cap - (live - need))
            quiet = np.lexsort((v["voice"], np.floor(np.clip(v["level"], 0, 1) * 65535))) if cfg.steal == "quietest" else np.argsort(v["voice"], kind="stable")
            gone = v["voice"][quiet[:need]]
            if cfg.admit == "loudest":
                chosen = loudest(loudness((cands["gain_l"] + cands["gain_r"]).to_numpy()), take) if want else []
            else:
                chosen = np.arange(take) * want // max(take, 1)
            taken = cands.iloc[chosen]
            task.pool.keep(~np.isin(v["voice"], gone))
            task.pool.add(taken)
            task.play(_controls(g))
            out += [("taken", taken["voice"].to_numpy().astype(np.int64), int(block)), ("stolen", gone, int(block))]
            if len(out) > 100:
                yield rows(out, task)
                out = []
        task.finish()
        yield rows(out, task)

    def rows(out: list[tuple], task: _Task) -> pd.DataFrame:
        out, task.out = out + [("ended", *ended) for ended in task.out], []
        n = [len(ids) for _, ids, _ in out]
        return pd.DataFrame({"voice": np.concatenate([np.zeros(0, np.int64), *(ids for _, ids, _ in out)]), "block": np.repeat([b for *_, b in out], n).astype(np.int64), "what": np.repeat([w for w, *_ in out], n)})

    every = _every(queue, control.select(F.lit(0).cast("long").alias("key"), "block", *_STATE, F.col("block").alias("at"), F.lit(1).alias("order")))
    return in_order(every, "key", "block", "order", "idx").mapInPandas(fold, "voice long, block long, what string")


def perform(ev: DataFrame, regions: DataFrame, presets: DataFrame, samples: DataFrame, cfg: Config | None = None) -> dict[str, DataFrame]:
    """``mix`` (frame, l, r) over all blocks from the first event's on, ``voices``
    with ``taken`` and ``stolen`` (the block, or null), ``blocks`` (block, want,
    take, stolen, alive at its end), and ``tail``: voices that outlast TAIL seconds. regions are
    as REGION, presets (bank, program, preset), samples (sample, pcm)."""
    cfg = cfg or Config()
    spark = ev.sparkSession
    ev = written(ev.select("channel", "seq", "frame", "kind", "a", "b"), "performance-events")
    first, last = ev.agg(F.min("frame"), F.max("frame")).first()
    if last is None:
        first = last = 0
    until = last // cfg.block_frames + max(int(TAIL * cfg.sample_rate) // cfg.block_frames, 1)
    rows = written(control_rows(ev, cfg), "performance-controls")
    control = rows.filter("block is not null")
    voices = written(sounding(ev, rows.filter("seq is not null"), regions, presets, cfg, last), "performance-voices")
    every, latest = voices.agg(F.count("*"), F.max("block")).first()
    if every > cfg.max_voices:
        decided = written(admitted(voices, control, cfg, until), "performance-pool")
        # Voices of a stretch of blocks go through them together.
        parts = -(-cfg.max_voices // SHARE)
        begun = first // cfg.block_frames
        width = max(STRETCH, -(-(latest + 1 - begun) * parts // MOST_TASKS))
        stretch, count = F.expr(f"(block - {begun}) div {width}") * parts, ((latest - begun) // width + 1) * parts
    else:  # the pool can't fill
        decided = voices.select("voice", "block", F.lit("taken").alias("what"))
        stretch, count = F.lit(0), max(-(-every // SHARE), LEAST_SHARES)
        parts = count
    told = decided.groupBy("voice").agg(F.lit(True).alias("taken"), F.max(F.when(F.col("what") == "stolen", F.col("block"))).alias("stolen"), F.max(F.when(F.col("what") != "taken", F.col("block"))).alias("end"))
    known = voices.drop("stop").join(told, "voice", "left").withColumns({"taken": F.coalesce("taken", F.lit(False)), "end": F.coalesce("end", F.lit(until)), "key": stretch + F.pmod(F.xxhash64("voice"), F.lit(parts))})
    # Which frame of the block a stolen voice begins to fade at is spread by its id.
    stop = F.coalesce(F.col("stolen") * cfg.block_frames + F.pmod(F.pmod("voice", F.lit(1 << 32)), F.lit(cfg.steal_span)) + 1, F.lit(-1)).cast("long")
    known = written(known.withColumn("stop", stop), "performance-known")
    sums = written(_played(known.filter("taken"), control, samples, cfg, until, last // cfg.block_frames, count), "performance-sums")
    each = sums.select("block", F.posexplode(F.arrays_zip("ls", "rs")).alias("i", "v"))
    mix = each.groupBy((F.col("block") * cfg.block_frames + F.col("i")).alias("frame")).agg(F.sum("v.ls").alias("l"), F.sum("v.rs").alias("r"))
    end = max(sums.agg(F.max("block")).first()[0] or 0, last // cfg.block_frames)
    spine = spark.range(first // cfg.block_frames * cfg.block_frames, (end + 1) * cfg.block_frames if every else 0).withColumnRenamed("id", "frame")
    dense = spine.join(mix, "frame", "left").select("frame", F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("r", F.lit(0.0)).alias("r"))
    decided = decided.filter("what <> 'ended'")
    want = voices.groupBy("block").agg(F.count("*").alias("want"))
    done = decided.groupBy("block").agg(F.count_if(F.col("what") == "taken").alias("take"), F.count_if(F.col("what") == "stolen").alias("stolen"))
    alive = sums.groupBy("block").agg(F.sum("alive").alias("alive"))
    blocks = want.join(done, "block", "full").join(alive, "block", "full").select("block", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("want", "take", "stolen", "alive")])
    return {"mix": dense, "voices": known, "blocks": blocks, "tail": sums.select(F.explode("cut").alias("voice"))}


def brickwall(mix: DataFrame, cfg: Config) -> DataFrame:
    """(frame, l, r) under the ceiling: the true peak of both channels, its
    maximum over the lookahead, the mean of the gain that needs, and a release;
    the signal is late by the lookahead and half the detector."""
    look = max(round(cfg.limiter_lookahead_ms / 1000 * cfg.sample_rate), 1)
    coef = 1 - math.exp(-1 / max(cfg.limiter_release_ms / 1000 * cfg.sample_rate, 1))
    mix = written(mix, "limiter-in")
    peaks = [signal.true_peak(mix.select(F.col("frame").alias("pos"), F.col(c).alias("v"))).withColumnRenamed("peak", c) for c in ("l", "r")]
    top = peaks[0].join(peaks[1], "pos").select("pos", F.greatest("l", "r").alias("v"))
    over = signal.sliding_max(written(top, "limiter-peaks"), look).withColumnRenamed("top", "v")
    mean = written(signal.moving_gain(written(over, "limiter-tops"), look, cfg.limiter_ceiling).withColumnRenamed("gain", "req"), "limiter-gains")
    gain = signal.release(mean, coef).join(mean, "pos").select(F.col("pos").alias("frame"), F.least("gain", "req").alias("gain"))
    late = look + 3
    moved = mix.select((F.col("frame") + late).alias("frame"), "l", "r")
    heard = gain.join(moved, "frame", "left")
    one = lambda c: F.greatest(F.least(F.coalesce(F.col(c) * F.col("gain"), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)).alias(c)
    return heard.select("frame", one("l"), one("r"))
