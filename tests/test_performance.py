"""A performance against a sequential loop over frames, written from the rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_channels import loop

from tonemill.config import Config
from tonemill.operators import folds, performance, reports

EVENT = "channel long, seq long, frame long, kind string, a long, b long"
CFG = Config(sample_rate=8000, block_frames=64, gate_frames=8, steal_fade_frames=16, max_voices=10_000)


def bank(seed, n=12):
    rng = random.Random(seed)
    samples = [(i, [round(rng.uniform(-1, 1), 3) for _ in range(rng.choice([1, 30, 60, 200]))]) for i in range(n)]
    samples.append((n, []))
    regions = []
    for r in range(30):
        sample = rng.randrange(n + 1)
        frames = len(samples[sample][1])
        loop_at = (4, frames - 3) if frames > 20 else (0, 1)
        lo, vel = rng.randrange(30, 60), rng.choice([0, 0, 40])
        regions.append((r % 3, r, lo, lo + 40, vel, rng.choice([127, 127, 90]), sample, frames, 60, rng.choice([100.0, 50.0]), rng.uniform(-300, 300), rng.uniform(0, 60), rng.choice([100.0, 0.0]), rng.uniform(-1, 1), rng.choice([0.0, 0.0, 0.0, 0.02]), rng.choice([0.0, 0.004]), rng.choice([0.0, 0.002]), rng.choice([0.01, 0.2]), rng.choice([0.0, 0.4, 1.0]), rng.choice([0.01, 0.05]), rng.choice([13_500.0, 6000.0]), rng.choice([0.0, 60.0]), *loop_at, rng.choice(["none", "continuous", "until_release"])))
    return regions, [(0, 0, 0), (0, 5, 1), (128, 0, 2)], samples


def events(seed, n=260):
    rng = random.Random(seed)
    frame, out = 5, []
    numbers = [7, 39, 10, 42, 11, 1, 33, 64, 64, 66, 67, 71, 72, 73, 74, 75, 76, 77, 92, 98, 100, 101, 6, 38, 121, 123, 0]
    for seq in range(n):
        frame += rng.choice([0, 1, 3, 9, 40])
        kind = rng.choice(["note_on"] * 5 + ["note_off"] * 3 + ["controller"] * 3 + ["bend", "program"])
        key = rng.randrange(55, 62)
        a, b = {"note_on": (key, rng.randrange(1, 128)), "note_off": (key, 0), "bend": (rng.randrange(-8192, 8192), 0), "program": (rng.choice([0, 5, 9]), 0), "controller": (rng.choice(numbers), rng.choice([0, 0, 20, 64, 100, 127]))}[kind]
        out.append((rng.choice([0, 3, 9]), seq, frame, kind, a, b))
    return out


class Channel:
    def __init__(self, number):
        self.number, self.sel = number, 0
        self.fresh()
        self.preset = (128 if number == 9 else 0, 0)

    def fresh(self):
        self.cc = {c: 0 for c in (0, 1, 33, 39, 42, 43, 67, 92)} | {7: 127, 10: 64, 11: 127} | {c: 64 for c in range(71, 78)}
        self.range, self.bend = 2.0, 0

    def take(self, kind, a, b):
        if kind == "program":
            self.preset = (128 if self.number == 9 else self.cc[0], a)
        elif kind == "bend":
            self.bend = a
        elif a in (98, 99):
            self.sel = None
        elif a in (100, 101):
            held = self.sel or 0
            self.sel = (held & 0x3F80 | b) if a == 100 else (held & 0x7F | b << 7)
        elif a == 6 and self.sel == 0:
            self.range = float(b)
        elif a == 38 and self.sel == 0:
            self.range = int(self.range) + b / 100
        elif a == 121:
            self.fresh()
            self.sel = None
        elif a in self.cc:
            self.cc[a] = b
            if a in (1, 7, 10, 11):
                self.cc[a + 32] = 0

    def row(self):
        part = lambda c: (self.cc[c] * 128 + self.cc[c + 32]) / 16383 if self.cc[c + 32] else self.cc[c] / 127
        amp = part(7) ** 2 * part(11) ** 2 * (1 - self.cc[67] / 254)
        turn = part(10) * math.pi / 2
        l, r = (1, 1) if self.cc[10] == 64 and not self.cc[42] else (math.cos(turn) * math.sqrt(2), math.sin(turn) * math.sqrt(2))
        return factor(self.bend / 8192 * self.range), amp * l, amp * r, tuple(self.cc[c] // 2 * 2 for c in range(71, 76))


def factor(semitones):
    return max(math.floor(2 ** (semitones / 12) * 2**24 + 0.5), 1)


def constants(v, cc, cfg):
    q, release, attack, cutoff, decay = cc
    timed = lambda s, c: s * 2 ** ((c - 64) / 8) if c <= 64 else s + 6e-5 * (c - 64) ** 3
    fall = lambda s, c: 10 ** (-5 / max(max(timed(s, c), min(s, 0.004)) * cfg.sample_rate, 1))
    up = timed(v["attack"], attack) * cfg.sample_rate
    v["up"] = 1.0 if up < 1 else 1 / up
    v["top"] = 1 + v["hold"] * cfg.sample_rate * v["up"]
    v["fall"], v["let"] = fall(v["decay"], decay), fall(v["release"], release)
    cents = v["cutoff"] + (cutoff - 64) * 75
    hz = 8.176 * 2 ** (cents / 1200)
    v["f"] = None
    if cents < 13_500 and 20 < hz < cfg.sample_rate * 0.49:
        w = 2 * math.pi * hz / cfg.sample_rate
        quality = 10 ** (((v["resonance"] + max(q - 64, 0) * 240 / 63) / 10 - 3.01) / 20)
        alpha, level = math.sin(w) / 2 / quality, math.sqrt(math.sqrt(0.5) / quality)
        v["f"] = tuple(c / (1 + alpha) for c in (level * (1 - math.cos(w)) / 2, level * (1 - math.cos(w)), -2 * math.cos(w), 1 - alpha))


def sequential(ev, regions, presets, samples, cfg):
    names = [c.split(" ")[0] for c in performance.REGION.split(", ")]
    regions = [dict(zip(names, r, strict=True)) for r in regions]
    pcm = dict(samples)
    preset_of = {(b, p): x for b, p, x in presets}
    gates = {}
    for channel, key, seq, ons, offs in loop([(c, s, k, a, b) for c, s, _, k, a, b in ev]):
        gates[channel, key, seq] = (ons, offs)
    frame_of, end = {s: f for _, s, f, *_ in ev}, ev[-1][2]
    release, begun = {}, {}
    for (channel, key, seq), (ons, offs) in sorted(gates.items(), key=lambda g: g[0][2]):
        was = begun.get((channel, key), (0, 0))
        if ons > was[0]:
            release[channel, seq] = None
        for n in range(was[1], offs):
            note = [s for (c, s) in release if c == channel and any(e[1] == s and e[4] == key for e in ev)]
            release[channel, sorted(note)[n]] = frame_of[seq]
        begun[channel, key] = (ons, offs)
    chan = {c: Channel(c) for c in range(16)}
    rows = {c: ch.row() for c, ch in chan.items()}
    turn = dict.fromkeys(range(16), 0.0)
    tiles, queue, live, todo, out, stats = cfg.block_frames // cfg.gate_frames, [], [], list(ev), {}, []
    block = 0
    while todo or queue or live:
        cands, table = [], {c: [] for c in rows}
        for v in [v for v in queue if v["start"] < (block + 1) * cfg.block_frames]:
            cands.append(v)
            queue.remove(v)
        cands.sort(key=lambda v: v["voice"])
        while todo and todo[0][2] < (block + 1) * cfg.block_frames:
            c, seq, frame, kind, a, b = todo.pop(0)
            upto = (frame % cfg.block_frames) // cfg.gate_frames + 1
            for ch, tab in table.items():
                tab += [rows[ch]] * (upto - len(tab))
            if kind == "note_on":
                bank_no, program = chan[c].preset
                preset = preset_of.get((bank_no, program), preset_of.get((0, program), 2 if bank_no == 128 else 0))
                layer = 0
                for r in regions:
                    if r["preset"] != preset or not (r["key_lo"] <= a <= r["key_hi"] and r["vel_lo"] <= b <= r["vel_hi"]) or layer == cfg.max_layers:
                        continue
                    layer += 1
                    if not r["frames"]:
                        continue
                    step = math.floor(2 ** (((a - r["root"]) * r["cents_a_key"] + r["tune"]) / 1200) * 2**32)
                    quiet = r["attenuation"] + (min(max(-400 * math.log10(b / 127), 0), 960) if r["vel_track"] == 100 else 0)
                    theta, gain = (r["pan"] + 1) / 2 * math.pi / 2, 10 ** (-quiet / 200)
                    start = frame + int(r["delay"] * cfg.sample_rate)
                    whole = r["loop_end"] > r["loop_start"] + 1
                    v = dict(r, voice=seq * cfg.max_layers + layer - 1, start=start, channel=c, step=step, l=gain * math.cos(theta), r=gain * math.sin(theta), off=((end if release[c, seq] is None else release[c, seq]) // cfg.gate_frames + 1), loops=r["loop"] if whole else "none", stage=0, level=0.0, phase=0, z1=0.0, z2=0.0, cc=rows[c][3], stop=None)
                    constants(v, v["cc"], cfg)
                    if start >= (block + 1) * cfg.block_frames:
                        queue.append(v)
                    else:
                        cands.append(v)
            elif kind != "note_off":
                chan[c].take(kind, a, b)
                rows[c] = chan[c].row()
        for ch, tab in table.items():
            tab += [rows[ch]] * (tiles - len(tab))
            k = chan[ch].cc
            vib, trem = (k[1] * 128 + k[33]) / 16383 * k[77] / 64 * 50, k[92] / 127 * 0.25
            for t in range(tiles):
                s = math.sin(turn[ch] * 2 * math.pi)
                bend, l, r, cc = tab[t]
                if vib > 0:
                    bend = max(bend * factor(vib * s / 100) >> 24, 1)
                if trem > 0:
                    l, r = l * (1 - trem + trem * s), r * (1 - trem + trem * s)
                tab[t] = (bend, l, r, cc)
                turn[ch] = (turn[ch] + 5 * 2 ** ((k[76] - 64) / 32) * cfg.gate_frames / cfg.sample_rate) % 1
        cap, most = cfg.max_voices, cfg.max_steal
        want, n = min(len(cands), cap), len(live)
        need = max(min(n + want - cap, n, most), 0)
        take = want if n + want <= cap else min(want, cap - (n - need))
        for v in sorted(live, key=lambda v: (math.floor(min(max(v["level"], 0), 1) * 65535), v["voice"]))[:need]:
            v["stop"] = block * cfg.block_frames + v["voice"] % cfg.steal_span + 1
        chosen = folds.loudest(folds.loudness(np.array([v["l"] + v["r"] for v in cands])), take) if cands else []
        stats.append((block, len(cands), take, need))
        live += [cands[i] for i in chosen]
        for v in live:
            x = pcm[v["sample"]]
            for t in range(tiles):
                bend, gl, gr, cc = table[v["channel"]][t]
                at = block * tiles + t
                if v["off"] <= at and v["stage"] < 3:
                    v["stage"], v["level"] = 3, min(v["level"], 1.0)
                step = v["step"] * bend >> 24
                if cc != v["cc"] and at > v["start"] // cfg.gate_frames:
                    v["cc"] = cc
                    constants(v, cc, cfg)
                for f in range(at * cfg.gate_frames, (at + 1) * cfg.gate_frames):
                    if f < v["start"]:
                        continue
                    looping = v["loops"] == "continuous" or (v["loops"] == "until_release" and v["stage"] < 3)
                    i = v["phase"] >> 32
                    if v["stage"] == 4 or (not looping and i >= len(x)):
                        v["stage"] = 4
                        break
                    if v["stage"] == 0:
                        v["level"] += v["up"]
                        if v["level"] >= v["top"]:
                            v["stage"], v["level"] = 1, 1.0
                    elif v["stage"] == 1:
                        v["level"] *= v["fall"]
                        if v["level"] <= max(v["sustain"], 1e-5):
                            v["stage"], v["level"] = (4, 0.0) if v["sustain"] <= 1e-5 else (2, v["sustain"])
                    elif v["stage"] == 3:
                        v["level"] *= v["let"]
                        if v["level"] <= 1e-5:
                            v["stage"], v["level"] = 4, 0.0
                    j = i + 1
                    if looping and j >= v["loop_end"]:
                        j = v["loop_start"] + (j - v["loop_start"]) % (v["loop_end"] - v["loop_start"])
                    j = min(j, len(x) - 1)
                    y = (x[i] + (x[j] - x[i]) * (v["phase"] % 2**32) / 2**32) * min(v["level"], 1.0)
                    if v["f"]:
                        b0, b1, a1, a2 = v["f"]
                        u = y
                        y = b0 * u + v["z1"]
                        v["z1"], v["z2"] = b1 * u - a1 * y + v["z2"], b0 * u - a2 * y
                    if v["stop"] is not None and f + 1 >= v["stop"]:
                        d = f + 1 - v["stop"]
                        if d >= cfg.steal_fade_frames:
                            v["stage"], y = 4, 0.0
                        y *= max(1 - d / cfg.steal_fade_frames, 0)
                    left, right = out.get(f, (0.0, 0.0))
                    out[f] = (left + y * v["l"] * gl, right + y * v["r"] * gr)
                    v["phase"] += step
                    if looping and v["phase"] >> 32 >= v["loop_end"]:
                        hi = v["phase"] >> 32
                        v["phase"] = (v["loop_start"] + (hi - v["loop_start"]) % (v["loop_end"] - v["loop_start"]) << 32) + v["phase"] % 2**32
        live = [v for v in live if v["stage"] < 4]
        block += 1
    return out, stats


def played(spark, ev, regions, presets, samples, cfg):
    return performance.perform(spark.createDataFrame(ev, EVENT).repartition(3), spark.createDataFrame(regions, performance.REGION), spark.createDataFrame(presets, "bank long, program long, preset long"), spark.createDataFrame(samples, "sample long, pcm array<double>"), cfg)


@pytest.mark.parametrize("seed,cap", [(1, 10_000), (2, 9)])
def test_mix_equals_a_sequential_loop(spark, seed, cap):
    cfg = Config(**(CFG.__dict__ | {"max_voices": cap}))
    regions, presets, samples = bank(seed)
    ev = events(seed)
    got = played(spark, ev, regions, presets, samples, cfg)
    want, stats = sequential(ev, regions, presets, samples, cfg)
    mix = {r["frame"]: (r["l"], r["r"]) for r in got["mix"].collect()}
    assert len(want) > 2000 and set(want) <= set(mix) and max(abs(v) for lr in want.values() for v in lr) > 0.5
    for side in (0, 1):
        a = spark.createDataFrame([(f, want.get(f, (0.0, 0.0))[side]) for f in sorted(mix)], "pos long, v double")
        b = spark.createDataFrame([(f, lr[side]) for f, lr in sorted(mix.items())], "pos long, v double")
        assert reports.null_report(a, b, -100.0).first()["passed"]
    blocks = {r["block"]: s for r in got["blocks"].collect() for s in [(r["want"], r["take"], r["stolen"])] if any(s)}
    assert blocks == {b: s for b, *rest in stats for s in [tuple(rest)] if any(rest)}
    if cap < 100:
        assert sum(b[2] for b in blocks.values()) > 5 and sum(b[0] - b[1] for b in blocks.values()) > 5
    assert got["tail"].count() == 0
    totals = reports.run_totals(spark.createDataFrame(ev, EVENT), got, 0.5).first()
    assert totals["notes"] == sum(e[3] == "note_on" for e in ev) and totals["voices"] == sum(s[1] for s in stats) and totals["dropped"] == sum(s[1] - s[2] for s in stats)
    assert totals["stolen"] == sum(s[3] for s in stats) and 0 < totals["peak_live"] <= cap and totals["cut"] == 0
    assert totals["peak"] == pytest.approx(max(abs(v) for lr in want.values() for v in lr)) and totals["clipped_percent"] == pytest.approx(100 * sum(abs(v) > 0.5 for lr in want.values() for v in lr) / 2 / len(mix))


def test_sound_goes_off_at_the_end_and_the_tail_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(performance, "TAIL", 0.1)
    regions, presets, samples = bank(4)
    region = dict(zip([c.split(" ")[0] for c in performance.REGION.split(", ")], regions[0], strict=True)) | {"preset": 0, "key_lo": 0, "key_hi": 127, "vel_lo": 0, "vel_hi": 127, "sample": 0, "frames": 60, "loop_start": 4, "loop_end": 50, "loop": "continuous", "sustain": 1.0, "delay": 0.0}
    samples = [(0, [0.5] * 60)]
    ev = [(0, 0, 10, "note_on", 60, 100), (0, 1, 700, "controller", 64, 127)]
    for release, left in ((0.01, 0), (5.0, 1)):
        got = played(spark, ev, [tuple((region | {"release": release}).values())], presets, samples, CFG)
        assert got["tail"].count() == left
        loud = got["mix"].filter("abs(l) > 1e-9").agg(F.max("frame")).first()[0]
        # The release begins with the tile after the last event's; 0.01 s are 80 frames.
        assert 700 + 80 <= loud <= 704 + 82 if not left else loud >= 700 + 750


def test_nothing_to_play(spark):
    regions, presets, samples = bank(5)
    got = played(spark, [], regions, presets, samples, CFG)
    assert got["mix"].count() == 0 and got["voices"].count() == 0
    got = played(spark, [(0, 0, 0, "note_on", 3, 3), (0, 1, 9, "what", None, None)], regions, presets, samples, CFG)
    assert got["mix"].filter("l <> 0").count() == 0


def test_limited_mix_stays_below_the_ceiling(spark):
    cfg = Config(**(CFG.__dict__ | {"limiter_lookahead_ms": 2.0, "limiter_release_ms": 20.0}))
    mix = spark.range(3000).select(F.col("id").alias("frame"), (F.sin(F.col("id") / 5) * (1 + F.col("id") / 700)).alias("l"), (F.cos(F.col("id") / 9) * 0.3).alias("r"))
    rows = mix.orderBy("frame").collect()
    out = performance.brickwall(mix, cfg).orderBy("frame").collect()
    assert len(out) == 3000 and max(abs(r["l"]) for r in out) <= cfg.limiter_ceiling * 1.001
    # The highest gain at which all that is heard stays below passes a quiet start unchanged, 16 + 3 frames late.
    for f in range(19, 300):
        assert (out[f]["l"], out[f]["r"]) == pytest.approx((rows[f - 19]["l"], rows[f - 19]["r"]), rel=0.35, abs=1e-3)
        assert out[f]["l"] * rows[f - 19]["r"] == pytest.approx(out[f]["r"] * rows[f - 19]["l"], abs=1e-9)


def test_stretches_of_blocks_are_played_apart(spark, monkeypatch):
    """However blocks are cut into stretches the mix is the same, and a stretch's
    task goes on only while its own voices live."""
    regions, presets, samples = bank(2)
    cfg = Config(**(CFG.__dict__ | {"max_voices": 9}))
    kept, mixes = {}, []
    monkeypatch.setattr(performance, "written", lambda df, name, w=performance.written: kept.setdefault(name, []).append(w(df, name)) or kept[name][-1])
    for width in (1, 1 << 20):
        monkeypatch.setattr(performance, "STRETCH", width)
        mixes.append({r["frame"]: (r["l"], r["r"]) for r in played(spark, events(2), regions, presets, samples, cfg)["mix"].collect()})
    assert mixes[0].keys() == mixes[1].keys() and len(mixes[0]) > 2000
    assert all(mixes[0][f] == pytest.approx(mixes[1][f], abs=1e-9) for f in mixes[0])
    apart, whole = kept["performance-sums"]
    assert whole.groupBy("block").count().agg(F.max("count")).first()[0] == 1
    # At most 9 voices sound and 2 fade in a block, in as many stretches at most; most have ended long before.
    assert apart.groupBy("block").count().agg(F.max("count")).first()[0] <= 11
    assert apart.count() < 6 * whole.count()
