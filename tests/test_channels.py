"""Pedals and controllers of a channel against plain lists of notes."""

import random

import numpy as np
from pyspark.sql import functions as F

from tonemill.operators import channels, signal

EVENT = "channel long, seq long, kind string, a long, b long"


def random_events(seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = rng.choice(["note_on"] * 4 + ["note_off"] * 4 + ["controller"] * 3 + ["program", "bend"])
        a = {"note_on": lambda: rng.randrange(5), "note_off": lambda: rng.randrange(5), "program": lambda: rng.randrange(128), "bend": lambda: rng.randrange(-8192, 8192)}.get(kind, lambda: rng.choice([64] * 6 + [66] * 6 + [120, 121, 123, 126, 6, 38, 96, 97, 98, 99, 100, 101, 7, 39, 10, 42, 11, 43, 1, 33, 0, 32, 67, 5]))()
        rows.append((rng.randrange(3), seq, kind, a, rng.choice([0, 0, 1, 63, 64, 127, rng.randrange(128)])))
    return rows


def loop(rows):
    """Notes as a list per key: "on", "off" and, while a pedal holds, "kept";
    caught ones are those that sounded when sostenuto went down."""
    out, state = [], {}
    for channel, seq, kind, a, b in sorted(rows, key=lambda r: (r[0], r[1])):
        s = state.setdefault(channel, {"notes": {}, "sustain": False, "sostenuto": False, "caught": {}})
        notes = s["notes"]
        was = {k: (len(v), v.count("off")) for k, v in notes.items()}

        def give(key):
            notes[key][next(i for i, n in enumerate(notes[key]) if n == "on")] = "kept"

        def let_go():
            if not (s["sustain"] or s["sostenuto"]):
                for k, v in notes.items():
                    notes[k] = ["off" if n == "kept" else n for n in v]

        def lift(pedal):
            if s[pedal]:
                s[pedal] = False
                if pedal == "sostenuto":
                    s["caught"] = {}
                let_go()

        if kind == "note_on":
            notes.setdefault(a, []).append("on")
        elif kind == "note_off" and notes.get(a):
            sounding = [n for n in notes[a] if n == "on"]
            if s["sostenuto"] and s["caught"].get(a, 0) > 0:
                if sounding:
                    give(a)
                    s["caught"][a] -= 1
            elif s["sustain"]:
                if sounding:
                    give(a)
            elif any(n != "off" for n in notes[a]):
                # Ends count: the oldest note that hasn't ended does, and a kept one stands for the next.
                i = next(i for i, n in enumerate(notes[a]) if n != "off")
                if notes[a][i] == "kept" and "on" in notes[a]:
                    give(a)
                notes[a][i] = "off"
        elif kind == "controller" and a == 64 and s["sustain"] != (b >= 64):
            if b >= 64:
                s["sustain"] = True
            else:
                lift("sustain")
        elif kind == "controller" and a == 66 and s["sostenuto"] != (b >= 64):
            if b >= 64:
                s["sostenuto"] = True
                s["caught"] = {k: v.count("on") for k, v in notes.items()}
            else:
                lift("sostenuto")
        elif kind == "controller" and a == 121:
            lift("sostenuto")
            lift("sustain")
        elif kind == "controller" and a == 120:
            for k, v in notes.items():
                notes[k] = ["off"] * len(v)
            s["caught"] = {}
        elif kind == "controller" and 123 <= a <= 127:
            for k, v in notes.items():
                notes[k] = ["kept" if s["sustain"] and n != "off" else "off" for n in v]
        for k, v in sorted(notes.items()):
            now = (len(v), v.count("off"))
            if now != was.get(k, (0, 0)):
                out.append((channel, k, seq, *now))
    return out


def test_pedals_equal_lists_of_notes(spark):
    for seed in (1, 2, 3):
        rows = [r for r in random_events(seed) if not (r[2] == "controller" and r[3] == 66 and seed == 1)]
        got = sorted(tuple(r) for r in channels.pedalled(spark.createDataFrame(rows, EVENT).repartition(4)).collect())
        want = sorted(loop(rows))
        assert got == want, seed


def test_pedal_holds_until_it_is_lifted(spark):
    events = [("note_on", 60, 9), ("controller", 64, 127), ("note_off", 60, 0), ("note_on", 60, 9), ("note_off", 60, 0), ("note_off", 60, 0), ("controller", 64, 0), ("note_off", 61, 0), ("note_on", 61, 9), ("controller", 66, 127), ("note_on", 62, 9), ("note_off", 61, 0), ("note_off", 62, 0), ("controller", 123, 0), ("controller", 66, 0)]
    df = spark.createDataFrame([(0, i, *e) for i, e in enumerate(events)], EVENT)
    got = [tuple(r)[1:] for r in channels.pedalled(df).orderBy("seq", "key").collect()]
    assert got == [(60, 0, 1, 0), (60, 3, 2, 0), (60, 6, 2, 2), (61, 8, 1, 0), (62, 10, 1, 0), (62, 12, 1, 1), (61, 13, 1, 1)]
    spans = sorted(tuple(r)[1:] for r in channels.note_spans(channels.pedalled(df)).collect())
    assert spans == [(60, 1, 0, 6), (60, 2, 3, 6), (61, 1, 8, 13), (62, 1, 10, 12)]


def test_bend_range_follows_registered_parameters(spark):
    steps = [("bend", 4096, 0), ("controller", 101, 0), ("controller", 100, 0), ("controller", 6, 12), ("controller", 38, 50), ("controller", 96, 0), ("controller", 98, 5), ("controller", 6, 40), ("controller", 100, 1), ("controller", 6, 41), ("controller", 100, 0), ("controller", 97, 0), ("controller", 7, 64), ("controller", 39, 64), ("program", 7, 0), ("controller", 32, 3), ("controller", 0, 1), ("controller", 121, 0), ("controller", 6, 9)]
    got = channels.dispatched(spark.createDataFrame([(4, i, *e) for i, e in enumerate(steps)], EVENT)).orderBy("seq").collect()
    assert [r["bend_range"] for r in got] == [2, 2, 2, 12, 12.5, 13.5, 13.5, 13.5, 13.5, 13.5, 13.5, 12.5, 12.5, 12.5, 12.5, 12.5, 12.5, 2, 2]
    assert got[0]["bend"] == 1 and got[5]["bend"] == 6.75 and got[-1]["bend"] == 0
    assert got[12]["volume"] == 64 / 127 and got[13]["volume"] == (64 * 128 + 64) / 16383 and got[-1]["volume"] == 1
    assert got[14]["program"] == 7 and {r["bank"] for r in got} == {0} and got[-1]["program"] == 7  # a bank counts when a program is chosen


def test_dispatch_equals_loop_over_partitions(spark):
    rows = random_events(7)
    got = {(r["channel"], r["seq"]): tuple(r)[2:] for r in channels.dispatched(spark.createDataFrame(rows, EVENT).repartition(5)).collect()}
    state = {}
    for channel, seq, kind, a, b in rows:
        # Written from the rules: the wheel has fourteen bits always; a program fixes the preset, by the coarse bank as it is then.
        fresh = {"range": 2.0, "bend": 0, "bank": 0, 1: 0, 33: 0, 7: 127, 39: 0, 10: 64, 42: 0, 11: 127, 43: 0, 67: 0, 71: 64, 72: 64, 73: 64, 74: 64, 75: 64, 76: 64, 77: 64, 92: 0}
        s = state.setdefault(channel, {"sel": 0, "preset": (128 if channel == 9 else 0, 0), **fresh})
        if kind == "program":
            s["preset"] = (128 if channel == 9 else s["bank"], a)
        elif kind == "bend":
            s["bend"] = a
        elif kind == "controller":
            if a == 0:
                s["bank"] = b
            elif a in (98, 99):
                s["sel"] = -1
            elif a == 100:
                s["sel"] = (max(s["sel"], 0) & 0x3F80) | b
            elif a == 101:
                s["sel"] = (max(s["sel"], 0) & 0x7F) | b << 7
            elif a == 121:
                s.update({"sel": -1, **fresh})
            elif a in (6, 38, 96, 97):
                if s["sel"] == 0:
                    s["range"] = {6: float(b), 38: int(s["range"]) + b / 100, 96: min(s["range"] + 1, 127.0), 97: max(s["range"] - 1, 0.0)}[a]
            elif a in s:
                s[a] = b
                if a in (1, 7, 10, 11):
                    s[a + 32] = 0
        else:
            continue
        part = [s[c] / 127 if s[c + 32] == 0 else (s[c] * 128 + s[c + 32]) / 16383 for c in (7, 10, 11)]
        want = (*s["preset"], (s[1] * 128 + s[33]) / 16383, *part, s[67], s["bend"] / 8192 * s["range"], s["range"], *(s[c] for c in (71, 72, 73, 74, 75, 76, 77, 92)))
        assert got.pop((channel, seq)) == want
    assert not got


def test_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], EVENT)
    assert channels.pedalled(empty).count() == channels.dispatched(empty).count() == 0
    odd = spark.createDataFrame([(1, 0, None, 1, 1), (1, 1, "tempo", 1, 1), (1, 2, "note_off", None, None), (1, 3, "note_on", 3, None)], EVENT)
    assert [tuple(r) for r in channels.pedalled(odd).collect()] == [(1, 3, 3, 1, 0)]


def test_windows_reach_back_over_many_shards(spark):
    rng = random.Random(5)
    v = [round(rng.uniform(-1, 1), 3) for _ in range(700)]
    v[0] = 5.0
    df = spark.createDataFrame(list(enumerate(v)), "pos long, v double")
    rows = signal.sharded(df, 300, 100).withColumn("top", signal.over_back(F.abs("v"), 300, F.max)).filter("own")
    got = [r["top"] for r in rows.orderBy("pos").collect()]
    assert got == [max(map(abs, v[max(0, i - 300) : i + 1])) for i in range(len(v))]


def test_looped_reading(spark):
    df = spark.createDataFrame([(i / 4,) for i in range(32)], "at double").withColumn("x", F.array(*[F.lit(float(k * k)) for k in range(9)]))
    nearest, linear, cubic = signal.interpolate(F.col("x"), F.col("at"), (F.lit(3), F.lit(7)))
    x = np.arange(9.0) ** 2
    at = lambda k: x[max(k if k < 7 else 3 + (k - 3) % 4, 0)]
    for r in df.select("at", nearest.alias("n"), linear.alias("l"), cubic.alias("c")).collect():
        i, t = int(r["at"]), r["at"] % 1
        p, a, b, c = (at(i + k) for k in (-1, 0, 1, 2))
        assert r["n"] == a and abs(r["l"] - (a + (b - a) * t)) < 1e-9
        assert abs(r["c"] - (((-0.5 * p + 1.5 * a - 1.5 * b + 0.5 * c) * t + p - 2.5 * a + 2 * b - 0.5 * c) * t + 0.5 * (b - p)) * t - a) < 1e-9


def test_reports_and_observations(spark):
    from tonemill.operators import reports

    same = spark.createDataFrame([(i, 0.5) for i in range(50)], "pos long, v double")
    r = reports.null_report(same, same.filter("pos < 40"), -90.0).first()
    assert r["compared"] == 40 and r["identical"] and r["passed"] and r["peak_db"] == float("-inf")
    assert not reports.null_report(same, same.withColumn("v", F.col("v") + 0.25), -90.0).first()["passed"]
    df, seen = reports.observed(same, "signal", top=F.max("v"))
    assert df.count() == 50 and seen.get == {"rows": 50, "top": 0.5}


def test_bends_that_are_no_numbers(spark):
    from tonemill.functions import numbers

    rows = [(float("nan"),), (float("inf"),), (8192.0,), (-8192.0,), (1e9,), (-1e9,)]
    got = [r[0] for r in spark.createDataFrame(rows, "b double").select(numbers.bend_factor(F.col("b"), F.lit(12.0))).collect()]
    assert got == [1 << 24, 1 << 24, 1 << 25, 1 << 23, (1 << 32) - 1, 1]
