"""MIDI, WAVE, SoundFont and SFZ sources and sinks."""

import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tonemill.operators import zones
from tonemill.sources import banks, fixtures, midi, sfz, soundfont, wav


def test_midi_round_trip(spark, tmp_path):
    rows = fixtures.scatter(spark, 100, 2, tracks=3)
    path = str(tmp_path / "a.mid")
    midi.write(rows, path)
    back = midi.read(spark, path)
    assert back.rdd.getNumPartitions() == 4  # the tempo track and three more
    key = ["track", "tick", "kind", "ch", "key", "vel", "us_per_qn"]
    got = sorted(map(tuple, back.filter("kind <> 'other'").select(key).collect()), key=str)
    assert got == sorted(map(tuple, rows.select(key).collect()), key=str)
    ticks = [(r["tick"], r["track"], r["seq"]) for r in midi.merged(back).collect()]
    assert ticks == sorted(ticks)
    assert {r["kind"]: r["n"] for r in midi.kinds(back).collect()} == {"tempo": 1, "note_on": 100, "note_off": 100, "other": 4}
    assert [(r["declared"], r["division"]) for r in midi.tracks(spark, path).collect()] == [(4, 960)] * 4


def test_midi_track_over_many_parts(spark, tmp_path):
    form = "track int, seq long, tick long, kind string, ch int, key int, vel int, num int, val int, us_per_qn int"
    rows = [(2, i, 3 * i // 2, "note_on" if i % 5 else "other", 1, i % 128, 1 + i % 100, None, None, None) for i in range(5000)] + [(7, 0, 4, "other", 0, None, None, None, None, None)]
    path = str(tmp_path / "c.mid")
    midi.write(spark.createDataFrame(rows, form).repartition(9), path)
    got = midi.read(spark, path).filter("kind <> 'other'").orderBy("seq").select("track", "tick", "key", "vel").collect()
    assert [tuple(r) for r in got] == [(0, r[2], r[5], r[6]) for r in rows if r[3] == "note_on"]
    assert [(r["track"], r["length"]) for r in midi.tracks(spark, path).collect()][1:] == [(1, 4)]  # nothing in it to write
    assert [f.name for f in tmp_path.iterdir() if f.name.endswith(".part")] == []


def test_midi_parts_are_written_row_by_row(tmp_path):
    sizes = []

    def rows():
        for i in range(60_000):
            if i % 20_000 == 19_999:
                sizes.append(sum(f.stat().st_size for f in tmp_path.glob("*.part")))
            yield Row(track=0, seq=i, tick=i, kind="note_on", ch=0, key=60, vel=1, num=None, val=None, us_per_qn=None)

    writer = midi._Writer(str(tmp_path / "d.mid"), 960)
    writer.commit([writer.write(rows())])
    assert 0 < sizes[0] < sizes[1] < sizes[2]
    assert sum(e[1] == "note_on" for e in midi.decode((tmp_path / "d.mid").read_bytes()[22:])) == 60_000


def test_midi_decoding():
    track = b"\x00\x90\x3c\x64" + b"\x81\x00\x3c\x00" + b"\x00\xb0\x07\x64" + b"\x00\xc1\x05" + b"\x00\xe2\x00\x40" + b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x00\xf0\x02\x01\xf7" + b"\x00\xd0\x11" + b"\x05\xff\x2f\x00" + b"\x00\x90\x01\x01"
    got = list(midi.decode(track))
    assert got[0] == (0, "note_on", 0, 60, 100, None, None, None)
    assert got[1] == (128, "note_off", 0, 60, None, None, None, None)  # running status, velocity 0
    assert got[2][1:] == ("controller", 0, None, None, 7, 100, None)
    assert got[3][1:] == ("program", 1, None, None, None, 5, None)
    assert got[4][1:] == ("pitch_bend", 2, None, None, None, 0, None)
    assert got[5][1:] == ("tempo", None, None, None, None, None, 500_000)
    assert [g[1] for g in got[6:]] == ["other"] * 3 and got[-1][0] == 133
    assert list(midi.decode(track[:6])) == got[:1] and list(midi.decode(b"\x00\x3c\x40")) == []


def test_midi_headers(tmp_path):
    path = tmp_path / "b.mid"
    chunk = lambda tag, body: tag + struct.pack(">I", len(body)) + body
    head = chunk(b"MThd", struct.pack(">HHH", 1, 9, 96))
    path.write_bytes(head + chunk(b"XFIH", b"abc") + chunk(b"MTrk", b"\x00\xff\x2f\x00") + chunk(b"\0\0\0\0", b"") + chunk(b"MTrk", b"\x00\xff\x2f\x00"))
    assert [c[3:] for c in midi.track_chunks(str(path))] == [(0, 33, 4)]
    path.write_bytes(b"RIFF" + bytes(20))
    with pytest.raises(ValueError, match="not a standard MIDI"):
        list(midi.track_chunks(str(path)))
    assert midi.ticks_per_second(960) == 1920 and midi.ticks_per_second(0xE728) == 1000


def test_generated_logs(spark):
    held = fixtures.sustained(spark, 50, 1)
    assert held.filter("kind = 'note_off'").select("tick").distinct().collect()[0][0] == 1921
    once = fixtures.simultaneous(spark, 30, 0.5, per_track=20)
    assert {r["tick"] for r in once.filter("kind = 'note_on'").collect()} == {1} and once.agg(F.max("track")).first()[0] == 2
    assert [(r["num"], r["val"]) for r in fixtures.bend_range(spark, 12).filter("kind = 'controller'").collect()] == [(101, 0), (100, 0), (6, 12)]
    assert fixtures.ramp(3).tolist() == [-32767, 0, 32767] and len(fixtures.sine(2, 10)) == 20 and len(set(fixtures.noise(50, 1).tolist())) > 40


@pytest.mark.parametrize("kind", ["float32", "pcm16"])
def test_wav_round_trip(spark, tmp_path, kind):
    signal = spark.range(5000).selectExpr("id as pos", "sin(id / 10D) as l", "cos(id / 7D) * 1.5 as r")
    path = str(tmp_path / "a.wav")
    wav.write(signal, path, rate=22_050, kind=kind)
    one = wav.read(spark, path).first()
    assert (one["sample_rate"], one["channels"], one["loop_start"], len(one["samples"])) == (22_050, 2, None, 10_000)
    got = [(r["l"], r["r"]) for r in wav.frames(wav.read(spark, path)).orderBy("pos").collect()]
    n = np.arange(5000)
    right = np.cos(n / 7) * 1.5
    assert np.allclose([g[0] for g in got], np.sin(n / 10), atol=1e-4)
    assert np.allclose([g[1] for g in got], right if kind == "float32" else np.clip(right, -1, 1), atol=1e-4)


@pytest.mark.parametrize(("tag", "bits", "raw", "values"), [(1, 8, b"\x00\x80\xff", [-1, 0, 127 / 128]), (1, 16, b"\x00\x80\xff\x7f", [-1, 32767 / 32768]), (1, 24, b"\x00\x00\x80\x00\x00\x40", [-1, 0.5]), (1, 32, struct.pack("<i", 1 << 30), [0.5]), (3, 32, struct.pack("<f", 0.25), [0.25]), (3, 64, struct.pack("<d", -0.5), [-0.5])])
def test_wav_encodings(tag, bits, raw, values):
    loop = b"smpl" + struct.pack("<I", 60) + struct.pack("<9I", 0, 0, 0, 69, 1 << 31, 0, 0, 1, 0) + struct.pack("<6I", 0, 0, 3, 9, 0, 0)
    body = b"junk" + struct.pack("<I", 1) + b"x\0" + b"fmt " + struct.pack("<IHHIIHH", 16, tag, 1, 8000, 0, 0, bits) + b"data" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) & 1) + loop
    got = wav.decode(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body)
    assert got["samples"].tolist() == values and (got["loop_start"], got["loop_end"], got["root_key"], got["fine_tune"]) == (3, 9, 69, 50.0)


def test_wav_errors():
    with pytest.raises(ValueError, match="not a WAVE"):
        wav.decode(b"RIFX" + bytes(20))
    with pytest.raises(ValueError, match="no fmt"):
        wav.decode(b"RIFF" + bytes(4) + b"WAVE")


def test_soundfont_regions(spark, tmp_path):
    path = str(tmp_path / "rich.sf2")
    fixtures.rich_soundfont(path)
    recs = soundfont.records(spark, path)
    assert [r["name"] for r in soundfont.samples(recs).orderBy("sample").collect()] == ["s0", "s1", "s2", "unused"]
    assert sorted(r["name"] for r in soundfont.used_samples(recs).collect()) == ["s0", "s1", "s2"]
    rows = {(r["program"], r["sample"]): r for r in soundfont.regions(recs).collect()}
    assert len(rows) == 6
    low, mid, high = (rows[0, i] for i in range(3))
    assert (low["key_lo"], low["key_hi"], low["pan"], low["loop_mode"]) == (0, 59, -1.0, "continuous")
    assert low["attack"] == 0.5 and mid["attack"] == 1.0 and low["release"] == 0.5  # a zone's own value, else its global zone's
    assert low["decay"] == 2.0 and low["sustain"] == pytest.approx(0.1) and low["hold"] == 0.0
    assert mid["filter_fc_cents"] == 9000 and high["filter_fc_cents"] == 13_500 and mid["scale_tuning"] == 100
    assert rows[1, 2]["attenuation_cb"] == 300 and rows[1, 0]["attenuation_cb"] == 200 and high["attenuation_cb"] == 100
    assert (rows[1, 2]["key_lo"], rows[1, 2]["key_hi"]) == (72, 100) and (high["vel_lo"], high["vel_hi"]) == (0, 127)
    pcm = {r["sample"]: r["pcm"] for r in soundfont.fetch(recs).collect()}
    assert set(pcm) == {0, 1, 2} and pcm[1] == fixtures.ramp(600).tolist()


def test_sfz(spark, tmp_path):
    (tmp_path / "main.sfz").write_text("""// a comment
<control> default_path=kit\\
<global> ampeg_release=0.5 volume=-6
<group> lokey=c4 hikey=b4 // notes
<region> sample=My Sample Name.wav lovel=30 pan=50
<region> sample=b.wav key=69 loop_mode=loop_sustain cutoff=8.176
#include "more.sfz"
<master> volume=3
<group> group=2 off_by=2
<region> sample=d.wav fil_type=hpf_2p cutoff=500 weird=1
<odd> x=1
""")
    (tmp_path / "more.sfz").write_text("<region> sample=c.wav ampeg_sustain=50 lokey=10\n")
    rows = sfz.lines(spark, str(tmp_path)).filter("file like '%main.sfz'")
    other = sfz.lines(spark, str(tmp_path)).filter("file like '%more.sfz'")
    every = sfz.included(rows.unionByName(other)).filter("file like '%main.sfz'")
    toks = sfz.tokens(every)
    got = sfz.regions(sfz.sections(toks)).orderBy("line").collect()
    assert [r["sample"] for r in got] == ["kit/My Sample Name.wav", "kit/b.wav", "kit/c.wav", "kit/d.wav"]
    a, b, c, d = got
    assert (a["key_lo"], a["key_hi"], a["vel_lo"], a["vel_hi"], a["pan"], a["attenuation_cb"], a["release"]) == (60, 71, 30, 127, 0.5, 60.0, 0.5)
    assert (b["key_lo"], b["key_hi"], b["root_key_override"], b["loop_mode"], b["filter_fc_cents"]) == (69, 69, 69, "until_release", 0.0)
    assert (c["key_lo"], c["sustain"], a["sustain"], c["loop_mode"]) == (10, 0.5, 1.0, "of_sample")
    assert (d["attenuation_cb"], d["exclusive_class"], d["filter_fc_cents"], d["key_lo"], a["exclusive_class"]) == (-30.0, 2, 13_500.0, 0, 0)
    assert {r["what"]: r["n"] for r in sfz.unknown(toks).collect()} == {"weird": 1, "<odd>": 1, "x": 1}
    assert sfz.kind_of("a/B.SF2") == "soundfont" and sfz.kind_of("c.sfz") == "sfz"
    with pytest.raises(ValueError, match="unknown kind"):
        sfz.kind_of("a.mp3")


def test_banks_of_both_kinds(spark, tmp_path):
    fixtures.rich_soundfont(str(tmp_path / "rich.sf2"))
    (tmp_path / "kit.sfz").write_text("<region> sample=a.wav lokey=60 hikey=64\n<region> sample=b.wav\n")
    got = banks.load(spark, str(tmp_path / "rich.sf2"), str(tmp_path / "kit.sfz"))
    rows = got.collect()
    assert sorted(r["kind"] for r in rows) == ["sfz"] * 2 + ["soundfont"] * 6
    kit = {r["sample"]: r for r in rows if r["kind"] == "sfz"}
    assert (kit["a.wav"]["key_lo"], kit["a.wav"]["key_hi"], kit["a.wav"]["program"]) == (60, 64, None)
    assert all(r["file"] and r["pan"] is not None and r["release"] is not None for r in rows)
    with pytest.raises(ValueError, match="unknown kind"):
        banks.load(spark, str(tmp_path / "a.mp3"))


def test_voices_that_exist(spark):
    rows = [(10, 1.0), (0, 1.0), (10, 0.0), (10, float("nan")), (10, float("inf")), (10, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "n long, r double")
    assert [r[0] for r in df.select(zones.sounds(df.n, df.r)).collect()] == [True] + [False] * 6


def test_a_task_writes_its_frames_as_they_come(tmp_path, monkeypatch):
    from tonemill.sources import wav

    monkeypatch.setattr(wav, "BATCH", 10)
    seen = []

    def rows():
        for i in range(95):
            seen.append(len(list(tmp_path.iterdir())))
            yield {"pos": i + 7, "l": i / 100, "r": -i / 100}

    writer = wav._Writer(str(tmp_path / "s.wav"), 8000, "pcm16")
    part = writer.write(rows())
    assert (part.start, part.size, seen[-1]) == (7, 95 * 4, 1)
    writer.commit([part, writer.write(iter([]))])
    got = wav.decode((tmp_path / "s.wav").read_bytes())["samples"]
    assert [round(x * 32_768) for x in got[::2].tolist()] == [int(i / 100 * 32_767 + 0.5) for i in range(95)]


def test_wav_scan_holds_no_whole_file(spark, monkeypatch):
    from tonemill import plans
    from tonemill.sources import wav

    monkeypatch.setattr(wav, "decode", None)
    monkeypatch.setattr(wav, "read", lambda *_: (_ for _ in ()).throw(AssertionError("a whole file as one row")))
    assert plans.QUERIES["wav_scan"](spark, "/root/testdata/sf0.001").count() == 1000


def test_sf2_regions_parses_files_once(spark):
    from tonemill import plans

    plan = plans.QUERIES["sf2_regions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sf2-records" in plan and "MapInPandas" not in plan


def test_soundfont_records_are_never_broadcast(spark, tmp_path):
    """A table of records is small on disk and large in memory, so no estimate
    of its size may make the driver gather it."""
    from tonemill import plans

    fixtures.rich_soundfont(str(tmp_path / "rich.sf2"))
    for got in (plans.QUERIES["sf2_regions"](spark, "/root/testdata/sf0.001"), soundfont.fetch(soundfont.records(spark, str(tmp_path)))):
        before = got._jdf.queryExecution().executedPlan()
        assert "SortMergeJoin" in before.toString() and "Broadcast" not in before.toString()
        assert got.collect()
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
