"""Rendering, ordered folds, limiter properties, streams and configuration."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.config import Config
from tonemill.functions import numbers
from tonemill.operators import folds, gates, pool, render, signal
from tonemill.streaming import live

VOICE = "voice long, start long, held long, step double, gain_l double, gain_r double, attack_rate double, attack_end double, decay_coef double, sustain double, release_coef double, loop_start long, loop_end long, b0 double, b1 double, a1 double, a2 double, pcm array<double>"


def voices(spark, filtered=False):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        pcm = [rng.uniform(-1, 1) for _ in range(rng.choice([0, 1, 40, 90]))]
        loop = (10, 35) if len(pcm) >= 40 and i % 2 else (None, None)
        held = rng.choice([None, 0, 1, 7, 200])
        f = (0.2, 0.4, -0.5, 0.3) if filtered and i % 3 else (None,) * 4
        rows.append((i, rng.randrange(300), held, rng.choice([0.5, 1.0, 1.37]), rng.random(), rng.random(), rng.choice([1.0, 0.13]), rng.choice([1.0, 1.4]), rng.choice([0.9, 0.97]), rng.choice([0.0, 0.3, 1.0]), rng.choice([0.8, 0.95]), *loop, *f, pcm))
    return spark.createDataFrame(rows, VOICE), rows


def mixed(df):
    return {r["frame"]: (r["l"], r["r"]) for r in df.collect()}


def brute_mix(rows, limit):
    out = {}
    for _, start, held, step, gl, gr, rate, end, fall, rest, let, ls, le, b0, b1, a1, a2, pcm in rows:
        amp, stage, place, z1, z2 = 0.0, 0, 0.0, 0.0, 0.0
        for n in range(limit):
            if held is not None and n + 1 > held and stage < 3:
                stage, amp = 3, min(amp, 1.0)
            if not pcm or (le is None and place >= len(pcm)):
                break
            if stage == 0:
                amp += rate
                if amp >= end:
                    stage, amp = 1, 1.0
            elif stage == 1:
                amp *= fall
                if amp <= max(rest, render.FLOOR):
                    if rest <= render.FLOOR:
                        break
                    stage, amp = 2, rest
            elif stage == 3:
                amp *= let
                if amp <= render.FLOOR:
                    break
            i = int(place)
            after = ls if le is not None and i + 1 >= le else min(i + 1, len(pcm) - 1)
            x = (pcm[i] + (pcm[after] - pcm[i]) * (place - i)) * min(amp, 1.0)
            if b0 is not None:
                y = b0 * x + z1
                z1, z2 = b1 * x - a1 * y + z2, b0 * x - a2 * y
                x = y
            left, right = out.get(start + n, (0.0, 0.0))
            out[start + n] = left + x * gl, right + x * gr
            place += step
            if le is not None and place >= le:
                place = ls + (place - ls) % (le - ls)
    return out


def test_a_limit_bounds_no_voice_with_an_end(spark):
    df = voices(spark)[0].filter("loop_end is not null").limit(1)
    frames = lambda held, limit: df.withColumn("held", F.lit(held).cast("long")).select(render.frames_of(limit).alias("n")).first()["n"]
    assert frames(2_000_000, 1 << 20) > 2_000_000 and frames(None, 1 << 20) == 1 << 20


@pytest.mark.parametrize("filtered", [False, True])
def test_kernel_equals_loop(spark, filtered):
    df, rows = voices(spark, filtered)
    got, want = mixed(render.by_kernel(df, block=64, limit=700)), brute_mix(rows, 700)
    for frame in set(got) | set(want):
        assert got.get(frame, (0, 0)) == pytest.approx(want.get(frame, (0, 0)), abs=1e-6), frame


def test_plan_equals_kernel(spark):
    df, _ = voices(spark)
    plan, kernel = mixed(render.by_plan(df, limit=700)), mixed(render.by_kernel(df, limit=700))
    for frame in set(plan) | set(kernel):
        assert plan.get(frame, (0, 0)) == pytest.approx(kernel.get(frame, (0, 0)), abs=1e-4), frame


def test_pool_fold_equals_loop(spark):
    rng = random.Random(5)
    rows = [(s, b, i, 1000 * b + i, rng.choice([0.1, 0.5, rng.random()]), b + rng.randrange(4)) for s in range(3) for b in range(12) for i in range(rng.randrange(14))]
    df = spark.createDataFrame(rows, "shard long, block long, idx long, id long, gain double, ends long")
    got = sorted(tuple(r) for r in folds.pool_fold(df, cap=8).collect())
    want, most = [], 2
    for s in range(3):
        held = []
        for b in sorted({r[1] for r in rows if r[0] == s}):
            queue = sorted(r for r in rows if r[:2] == (s, b))
            held = [v for v in held if v[5] >= b]
            want_n, live_n = min(len(queue), 8), len(held)
            need = max(min(live_n + want_n - 8, live_n, most), 0)
            take = want_n if live_n + want_n <= 8 else min(want_n, 8 - (live_n - need))
            held = sorted(held, key=lambda v: (math.floor(min(max(v[4], 0), 1) * 65535), v[3]))[need:]
            strata, chosen = min(take, pool.STRATA), []
            for st in range(strata):
                part = [q for i, q in enumerate(queue) if ((i + 1) * strata - 1) // len(queue) == st]
                quota = (st + 1) * take // strata - st * take // strata
                chosen += sorted(part, key=lambda v: (-v[4], -v[2]))[:quota]
            held += chosen
            want.append((s, b, len(held), len(queue), take, need, len(queue) - take))
    assert [g[:7] for g in got] == sorted(want) and any(w[5] for w in want) and any(w[6] for w in want)
    rank = lambda x: struct.unpack("<I", struct.pack("<f", x))[0] >> 16 & 0x7FFF
    for s, b, live, n, take, stolen, _, alive, want_e, take_e in got:
        queue = sorted((rank(r[4]) for r in rows if r[:2] == (s, b)), reverse=True)
        assert want_e == sum(queue) and take_e <= sum(queue[:take]) and live == alive - stolen + take and len(queue) == n


def test_follower_and_release_equal_loops(spark):
    rng = random.Random(6)
    rows = [(i, p, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.random()) for i in range(3) for p in range(400)]
    df = spark.createDataFrame(rows, "id long, pos long, l double, r double, ma double").repartition(7)
    got = {(r["id"], r["pos"]): r["l"] for r in folds.follow(df, 5.0, 50.0).collect()}
    gain = {(r["id"], r["pos"]): r["gain"] for r in folds.two_stage_release(df, 0.2, 0.05, 0.01).collect()}
    for i in range(3):
        loud, slow, quick = 1.0, 1.0, 1.0
        for _, p, x, _, m in [r for r in rows if r[0] == i]:
            w = 50.0 if loud > abs(x) else 5.0
            loud = max((loud * w + abs(x)) / (w + 1), 0.4)
            assert got[i, p] == pytest.approx(x / loud / 2)
            slow = min(max(slow + (m - slow) * (0.05 if m < slow else 0.01), 1e-9), 1.0)
            need = min(m / slow, 1.0)
            quick = need if need < quick else min(quick + (need - quick) * 0.2, need)
            assert gain[i, p] == pytest.approx(min(slow * quick, m)) and gain[i, p] <= m
    held = folds.follow(df, 5.0, 50.0, velocity_limit=0.1).agg(F.max(F.abs("l"))).first()[0]
    assert held < max(map(abs, got.values()))


def test_limiter_never_exceeds_its_ceiling(spark):
    """Delay, sliding maximum, moving mean and release together."""
    look, ceiling = 32, 0.5
    df = spark.range(3000).selectExpr("id as pos", "sin(id / 9D) * if(id % 500 < 20, 40, 0.6) as v")
    top = signal.sliding_max(df, look).withColumnRenamed("top", "v")
    ma = signal.moving_gain(top, look, ceiling).withColumnRenamed("gain", "req")
    gain = signal.release(ma, 0.05, block=256)
    out = signal.delayed(df, look).join(gain, "pos").selectExpr("abs(v * gain) as y")
    assert out.agg(F.max("y")).first()[0] <= ceiling + 1e-9


def test_release_equals_loop(spark):
    rng = random.Random(7)
    req = [rng.random() for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(req)), "pos long, req double")
    got = [r["gain"] for r in signal.release(df, 0.1, block=64).orderBy("pos").collect()]
    g = 1.0
    for i, r in enumerate(req):
        g = min(r, g + (r - g) * 0.1)
        assert got[i] == pytest.approx(g)


def test_release_in_levels_equals_loop(spark):
    rng = random.Random(9)
    req = [rng.random() for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(req)), "pos long, req double")
    out = signal.release(df, 0.1, block=4, run=5)  # 175 blocks, 35 runs, 7, 2
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, g = [r["gain"] for r in out.orderBy("pos").collect()], 1.0
    for i, r in enumerate(req):
        g = min(r, g + (r - g) * 0.1)
        assert got[i] == pytest.approx(g)
    assert signal.release(df.limit(0), 0.1).count() == 0


def brute_sinc(src, ratio):
    """One output after the other, as the reference has it."""
    cutoff, out = min(ratio, 1.0) * 0.95, []
    for j in range(max(math.floor(len(src) * ratio + 0.5), 1)):
        at = j * (1 / ratio)
        i = math.floor(at)
        frac = min(int((at - i) * 512), 511) / 512
        row = []
        for k in range(32):
            x, t = (k - 15 - frac) * cutoff, min(max((k - frac + 1) / 32, 0), 1)
            w = 0.42 - 0.5 * math.cos(2 * math.pi * t) + 0.08 * math.cos(4 * math.pi * t)
            row.append((math.sin(math.pi * x) / (math.pi * x) if x else 1.0) * cutoff * w)
        out.append(sum(c * src[min(max(i - 15 + k, 0), len(src) - 1)] for k, c in enumerate(row)) / sum(row))
    return out


def test_sinc_resampling(spark):
    rng, up, down = random.Random(11), 48_000 / 44_100, 0.5
    tone = lambda hz, n: [int(12_000 * math.sin(2 * math.pi * hz * i / 44_100)) for i in range(n)]
    sources = [[10_000] * 4000, tone(1000, 44_100), tone(18_000, 4000), [rng.randrange(-20_000, 20_000) for _ in range(200)], [5], [], None]
    df = spark.createDataFrame(list(enumerate(sources)), "id int, x array<int>").repartition(3)
    rows = df.select("id", *[signal.sinc_resampled(F.col("x"), r).alias(n) for n, r in (("up", up), ("down", down), ("same", 1.0))]).orderBy("id").collect()
    dc, kilo, high, noise, one, none, null = rows
    assert len(dc["up"]) == round(4000 * up) and all(abs(v - 10_000) < 60 for v in dc["up"][200:-200])
    crossings = sum(a < 0 <= b for a, b in zip(kilo["up"], kilo["up"][1:], strict=False))
    assert abs(crossings / (len(kilo["up"]) / 48_000) - 1000) < 5
    assert max(map(abs, high["down"][50:-50])) < 150 and max(map(abs, kilo["down"])) > 11_500  # above the new band it is silent
    for ratio in ("up", "down"):
        want = brute_sinc(sources[3], up if ratio == "up" else down)
        assert len(want) == len(noise[ratio]) and all(abs(a - math.trunc(b)) <= 1 for a, b in zip(noise[ratio], want, strict=True))
    assert noise["same"] == sources[3] and abs(one["up"][0] - 5) <= 1 and none["up"] == [] and null["up"] is None


def test_slots_are_folded_batch_by_batch(spark):
    """One slot with nearly all events, in Arrow batches of 50 rows."""
    rng = random.Random(12)
    rows = [(0 if rng.random() < 0.9 else rng.randrange(4), i, rng.choice(["note_on", "note_off", "controller"]), rng.random() < 0.5) for i in range(2000)]
    df = spark.createDataFrame(rows, "slot long, seq long, kind string, press boolean").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = gates.sostenuto(df)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["slot"], r["seq"]): r["published"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in plan and len(got) == 2000
    for s in range(4):
        on = off = pending = captured = 0
        down = False
        for _, seq, kind, press in [r for r in rows if r[0] == s]:
            if kind == "note_on":
                on += 1
            elif kind == "note_off" and on > off + pending:
                if down and captured:
                    captured, pending = captured - 1, pending + 1
                else:
                    off += 1
            elif kind == "controller" and press != down:
                captured, off, pending = (on - off - pending, off, pending) if press else (0, off + pending, 0)
                down = press
            assert got[s, seq] == off


def test_stream_gates_carry_their_state(spark, tmp_path):
    """Slots that pause for a batch keep their counters; no group is gathered."""
    parts = [[(0, 1, "note_on"), (1, 2, "note_on")], [(0, 3, "note_on"), (0, 4, "note_off")], [(1, 5, "note_off"), (1, 6, "note_off"), (0, 7, "note_off")]]
    form = "slot long, seq long, kind string"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, form).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    folded = live.gates(stream)
    assert isinstance(folded, live.Carried)
    got = sorted(map(tuple, live.collected(folded, "append").collect()))
    want = gates.counters(spark.read.parquet(str(tmp_path / "ev"))).select("slot", "seq", "ons", "offs", "sounding").collect()
    assert got == sorted(map(tuple, want))


def test_gate_properties(spark):
    ev = lambda kinds: spark.createDataFrame([(0, i, k, 64 if k == "controller" else 0) for i, k in enumerate(kinds)], "slot long, seq long, kind string, k long")
    stray = gates.counters(ev(["note_off", "note_on"])).orderBy("seq").collect()
    assert [(r["ons"], r["offs"]) for r in stray] == [(0, 0), (1, 0)]
    fifo = gates.pairs(gates.counters(ev(["note_on", "note_on", "note_off"]))).orderBy("ordinal").collect()
    assert [(r["on_seq"], r["off_seq"]) for r in fifo] == [(0, 2), (1, None)]


def test_units(spark):
    row = spark.range(1).select(numbers.timecents_to_seconds(F.lit(-12000)).alias("a"), numbers.timecents_to_seconds(F.lit(0)).alias("b"), numbers.timecents_to_seconds(F.lit(1200)).alias("c"), numbers.velocity_attenuation(F.lit(127), F.lit(100)).alias("d"), numbers.velocity_attenuation(F.lit(64), F.lit(100)).alias("e"), numbers.velocity_attenuation(F.lit(1), F.lit(100)).alias("f")).first()
    assert (row["a"], row["b"], row["c"]) == (0, 1, 2) and row["d"] < 0.01 and 100 < row["e"] < 140 and row["f"] >= 800
    mixed_ = spark.range(20_000).select(numbers.mix48(F.col("id")).alias("m")).distinct().count()
    assert mixed_ == 20_000


def test_results_do_not_depend_on_partitions(spark):
    cand = spark.range(3000).selectExpr("id as seq", "id div 100 as block", "id % 100 as idx", "100L as want", "(id * 7919) % 31 / 31D as gain")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in ("1", "4", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(tuple(sorted(r["seq"] for r in pool.admit_loudest(cand.repartition(int(n)), 40).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1 and len(seen.pop()) == 30 * 40


def test_streams(spark, tmp_path):
    rng = random.Random(8)
    kinds = ["click", "signup", "error", "view", "purchase"]
    folder = tmp_path / "events.parquet"
    rows = [(i, 1_704_067_200 + i * 997, rng.randrange(6), rng.choice(kinds), 1.0, '{"k": %d}' % rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    df = df.selectExpr("event_id", "cast(timestamp_seconds(t) as timestamp_ntz) as ts", "user_id", "event_type", "value", "props")
    for lo in (0, 200, 400):  # three files, three batches, in order
        df.filter(f"event_id >= {lo} and event_id < {lo + 200}").coalesce(1).write.mode("append").parquet(str(folder))
    got = {r["block"]: r["n"] for r in live.collected(live.density(live.events(spark, str(tmp_path)), late="30 days"), "update", ["block"]).collect()}
    want = {}
    for _, t, _, e, _, _ in rows:
        if e in ("click", "view"):
            want[t // 21_600] = want.get(t // 21_600, 0) + 1
    assert got == want
    out = live.collected(live.gates(live.events(spark, str(tmp_path), files_per_batch=3)), "append").collect()
    counted = gates.counters(live.from_activity(spark.read.parquet(str(folder)))).select("slot", "seq", "ons", "offs", "sounding").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, counted))


def test_config():
    c = Config(max_voices=100)
    assert (c.max_steal, c.pool_slots, c.steal_span, c.block_bytes) == (25, 125, 4000, 32_768) and 0.96 < c.limiter_ceiling < 0.97
    for bad in ({"channels": 1}, {"sample_rate": 10}, {"block_frames": 4098}, {"gate_frames": 6}, {"max_layers": 0}, {"steal_fade_frames": 4096}, {"limiter_ceiling_db": 1.0}, {"admit": "x"}, {"max_steal_percent": 101}, {"limiter_release_ms": 0.0}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert np.isclose(Config(limiter_ceiling_db=0.0).limiter_ceiling, 1.0)


def test_sustained_slots_of_odd_pedals(spark, monkeypatch):
    """Against each slot's own list of events; presses may be null, slots have no channel."""
    monkeypatch.setattr(gates, "CHUNK", 3)
    rng = random.Random(5)
    rows = []
    for seq in range(600):
        ch = rng.choice([0, 1, 1, None])
        slot = rng.choice([None, 100 if ch is None else ch * 10 + rng.randrange(4)]) if ch != 0 else rng.randrange(4)
        rows.append((seq, slot, ch, rng.choice(["note_on", "note_off", "controller"]), rng.choice([True, False, False, None])))
    rows += [(600 + i, 50, 5, "note_on", None) for i in range(3)] + [(700 + i, None, 6, "controller", i % 2 == 0) for i in range(4)]
    df = spark.createDataFrame(rows, "seq long, slot long, ch long, kind string, p boolean").repartition(3)
    # The slots of each channel, as the events come.
    was, changes = {}, []
    for seq, _, ch, kind, p in rows:
        if kind == "controller" and ch is not None:
            if p is not None and p != bool(was.get(ch)):
                changes.append((seq, ch, p))
            was[ch] = p
    state = {}
    slots = {(s, c) for _, s, c, kind, _ in rows if kind != "controller"}
    spread = [(seq, s, kind, None) for seq, s, _, kind, _ in rows if kind != "controller"] + [(q, s, "controller", p) for q, ch, p in changes for s, c in slots if c == ch]
    want, ends = [], {}
    for seq, slot, kind, p in sorted(spread, key=lambda r: (r[0], str(r[1]))):
        ons, offs, down, published = state.get(slot, (0, 0, False, 0))
        ons += kind == "note_on"
        offs += kind == "note_off" and ons > offs
        down = down if p is None else p
        for n in range(published + 1, offs + 1 if not down else 0):
            ends[slot, n] = seq
        published = published if down else offs
        state[slot] = ons, offs, down, published
        want.append((seq, slot, offs, published, down))
    by = lambda r: tuple(map(str, r))
    known = lambda r: r[1] is not None  # noqa: E731 (slots without a name share a window, whatever their channels)
    got = [tuple(r) for r in gates.sustained(df, "p").select("seq", "slot", "offs", "published", "down").collect()]
    assert sorted(filter(known, got), key=by) == sorted(filter(known, want), key=by)
    pairs = {(r["slot"], r["ordinal"]): r["off_seq"] for r in gates.held_pairs(df, "p").filter("slot is not null").collect()}
    assert pairs == {(s, n): ends.get((s, n)) for s, st in state.items() if s is not None for n in range(1, st[0] + 1)}


def test_no_row_of_a_slot_and_a_change_is_shuffled(spark):
    """1000 changes of pedal and 100 slots: 100,000 rows come out."""
    rows = spark.range(1200).selectExpr("id as seq", "if(id < 200, id div 2, null) as slot", "0L as ch", "if(id < 200, if(id % 2 = 0, 'note_on', 'note_off'), 'controller') as kind", "id % 2 = 0 as p")
    out = gates.sustained(rows, "p")
    assert out.count() == 200 + 100 * 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Behind the spelling out of changes there is neither exchange nor sort.
    behind = plan.split("\n   +- ")[1].split("Generate explode(c")
    assert len(behind) == 2 and not any(n in behind[0] for n in ("Exchange", "Sort", "Window"))


def test_changes_are_spelled_out_in_tasks_dealt_by_number(spark):
    """2500 changes, three notes amid them: a slot's windows are made once, and
    the rows come from as many tasks as are set, few as are the bytes read."""
    rows = spark.range(2503).selectExpr("id as seq", "if(id in (700, 1100, 2400), 7L, null) as slot", "bigint(id < 0) as ch", "case id when 700 then 'note_on' when 1100 then 'note_off' when 2400 then 'note_on' else 'controller' end as kind", "id % 2 = 0 as p")
    out = gates.sustained(rows, "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning(slot") == 1
    want, ons, offs, published, down, was = [], 0, 0, 0, False, False
    for seq in range(2503):
        note = seq in (700, 1100, 2400)
        if not note:
            if (seq % 2 == 0) == was:
                continue
            down = was = seq % 2 == 0
        ons += seq in (700, 2400)
        offs += seq == 1100
        published = published if down else offs
        want.append((7, 0, seq, "note_on" if note and seq != 1100 else "note_off" if note else "controller", None if note else down, ons, offs, ons - offs, down, published))
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == want


def test_fixed_scale_cuts_exactly(spark):
    """Fractions of up to 1 - 2^-24, which six digits round up; both signs."""
    pairs = [(v, f) for v in (1, (1 << 24) - 1, 1_704_067_211_172_425, -5, 0) for f in ((1 << 24) - 1, (1 << 24) + 99_991 * 99, 1)]
    got = spark.createDataFrame(pairs, "v long, f long").select("v", "f", numbers.fixed_scale(F.col("v"), F.col("f")).alias("s")).collect()
    assert {(r["v"], r["f"]): r["s"] for r in got} == {(v, f): abs(v * f) // (1 << 24) * (-1 if v < 0 else 1) for v, f in pairs}


def test_lookup_spells_out_the_first_zones_of_a_band_only(spark):
    """Every zone of a band holds the same hits; two layers need two of each."""
    from tonemill.operators import zones

    rows = [("a", i, i % 2 * 10, i % 2 * 10 + 20, 0, 60 + i % 3 * 30) for i in range(60)] + [("b", 99, -5, 200, 0, 127)]
    df = spark.createDataFrame(rows, "preset string, region long, key_lo long, key_hi long, vel_lo long, vel_hi long")
    asked = [(i, p, k, v) for i, (p, k, v) in enumerate((p, k, v) for p in "abc" for k in (0, 5, 15, 25, 127) for v in (1, 80, 127))]
    out = zones.lookup(spark.createDataFrame(asked, "id long, preset string, key long, vel long"), df, "region", 2, ["id"])
    want = {(i, r[1], n + 1) for i, p, k, v in asked for n, r in enumerate([r for r in rows if r[0] == p and r[2] <= k <= r[3] and r[4] <= v <= r[5]][:2])}
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(preset" in plan and "key_lo" in plan.split("row_number() windowspecdefinition(preset")[1]
    assert "SortMergeJoin [preset" in plan


def test_flatten_spells_pairs_out_last(spark, monkeypatch):
    from tonemill.operators import zones

    monkeypatch.setattr(zones, "CHUNK", 3, raising=False)
    rng = random.Random(7)
    outer = [(i, i % 2 if i % 11 else None, rng.choice([0, 40]), rng.choice([20, 60]), f"n{i}") for i in range(40)]
    inner = [(i, i % 2, rng.choice([10, 50]), rng.choice([30, 55])) for i in range(30)]
    out = zones.flatten(spark.createDataFrame(outer, "id long, instrument long, key_lo long, key_hi long, name string"), spark.createDataFrame(inner, "zone long, instrument long, key_lo long, key_hi long"))
    want = [(*o, z, max(min(o[2:4]), lo), min(max(o[2:4]), hi)) for o in outer for z, ins, lo, hi in inner for lo, hi in [sorted((lo, hi))] if ins == o[1] and max(min(o[2:4]), lo) <= min(max(o[2:4]), hi)]
    got = [tuple(r) for r in out.select("id", "instrument", "key_lo", "key_hi", "name", "zone", "low", "high").collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan[: plan.index("Generate")]


def test_kernel_sums_cover_a_tasks_own_frames(spark):
    """Voices come in no order; blocks made are those that hold sound, about once."""
    fixed = {"held": 3, "step": 1.0, "gain_l": 1.0, "gain_r": 0.5, "attack_rate": 1.0, "attack_end": 1.0, "decay_coef": 0.99, "sustain": 0.5, "release_coef": 0.5}
    none = {n: F.lit(None).cast("double") for n in ("loop_start", "loop_end", "b0", "b1", "a1", "a2")}
    df = spark.range(64_000).selectExpr("id as voice", "(id * 7919) % 64000 * 10 as start", "array(1D, 1D) as pcm").withColumns({n: F.lit(v) for n, v in fixed.items()} | none).repartition(7)
    for by in (render.by_kernel, render.by_plan):
        out = by(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning((start" in plan
        assert out.count() == 128_000


def test_plan_has_no_interpreted_frames(spark):
    """Frames are rows of one generated stage, not an array's function."""
    fixed = {"held": 3, "step": 1.0, "gain_l": 1.0, "gain_r": 0.5, "attack_rate": 1.0, "attack_end": 1.0, "decay_coef": 0.99, "sustain": 0.5, "release_coef": 0.5}
    none = {n: F.lit(None).cast("double") for n in ("loop_start", "loop_end", "b0", "b1", "a1", "a2")}
    out = render.by_plan(spark.range(4).selectExpr("id * 5 as start", "array(1D, 1D) as pcm").withColumns({n: F.lit(v) for n, v in fixed.items()} | none))
    assert "transform(" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["frame"] for r in out.orderBy("frame").collect()] == [0, 1, 5, 6, 10, 11, 15, 16]
