"""Registered queries without SQL, on the smallest tables, against plain loops."""

import os

import numpy as np
import pytest
from test_channels import loop

from tonemill import plans
from tonemill.sources.events import read

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def values(spark):
    return [(r["event_id"], r["user_id"], r["value"]) for r in read(spark, SF, "events").orderBy("event_id").collect()]


def test_limiter_release(spark):
    got = {r["pos"]: r["gain"] for r in plans.QUERIES["limiter_release"](spark, SF).collect()}
    gain, rows = 1.0, values(spark)
    for pos, _, value in rows:
        level = abs(value / 100 - 1)
        need = 0.5 / level if level > 0.5 else 1.0
        gain = min(need, 0.9 * gain + 0.1 * need)
        assert got[pos] == pytest.approx(gain, abs=2e-6)
    assert len(got) == len(rows)


def test_biquad_long(spark):
    got = {r["pos"]: r["v"] for r in plans.QUERIES["biquad_long"](spark, SF).collect()}
    z1 = z2 = 0.0
    for pos, _, value in values(spark):
        x = value / 100 - 1
        y = 0.2 * x + z1
        z1, z2 = 0.4 * x + 0.5 * y + z2, 0.2 * x - 0.3 * y
        assert got[pos] == pytest.approx(y, abs=2e-6)
    assert len(got) == len(values(spark))


def test_limiter_sustain(spark):
    got = {(r["id"], r["pos"]): r["gain"] for r in plans.QUERIES["limiter_sustain"](spark, SF).collect()}
    state, rows = {}, values(spark)
    for pos, user, value in rows:
        slow, quick = state.get(user % 16, (1.0, 1.0))
        ma = 50 / value if value > 50 else 1.0
        slow += (ma - slow) * (0.01 if ma < slow else 0.001)
        need = min(ma / slow, 1.0)
        quick = need if need < quick else min(quick + (need - quick) * 0.1, need)
        state[user % 16] = slow, quick
        assert got[user % 16, pos] == pytest.approx(min(slow * quick, ma), abs=2e-6)
    assert len(got) == len(rows)


def test_limiter_sustain_of_zeros(spark, tmp_path):
    events = read(spark, SF, "events")
    events.selectExpr(*[c for c in events.columns if c != "value"], "if(event_id % 3 = 0, 0.0D, value) as value").write.parquet(f"{tmp_path}/events.parquet")
    assert plans.QUERIES["limiter_sustain"](spark, str(tmp_path)).filter("gain is null or gain > 1").count() == 0


def test_channel_pedals(spark):
    from tonemill.plans import gates

    rows = [tuple(r) for r in gates._pedals(spark, SF).select("channel", "seq", "kind", "a", "b").collect()]
    got = sorted(tuple(r) for r in plans.QUERIES["channel_pedals"](spark, SF).collect())
    assert got == sorted(loop(rows)) and len(got) > 20


def test_resample_sinc(spark):
    from tonemill.operators import signal

    first = read(spark, SF, "embeddings").orderBy("vec_id").first()
    got = [r["v"] for r in plans.QUERIES["resample_sinc"](spark, SF).filter(f"vec_id = {first['vec_id']}").orderBy("i").collect()]
    pcm = [int(max(min(v * 32767, 32767), -32767)) for v in first["embedding"]]
    bank, n = signal.sinc_bank(1.5), len(pcm)
    assert len(got) == round(n * 1.5)
    for j, v in enumerate(got):
        at = j / 1.5
        i, phase = int(at), min(int((at - int(at)) * 512), 511)
        want = sum(float(bank[phase, k]) * pcm[min(max(i - 15 + k, 0), n - 1)] for k in range(32))
        assert abs(v - want) <= 1.01


def test_block_report(spark):
    import math

    from tonemill.operators import folds

    got = plans.QUERIES["block_report"](spark, SF).orderBy("block").collect()
    rows = values(spark)
    on = {r["event_id"] for r in read(spark, SF, "events").filter("event_type in ('click', 'view')").collect()}
    dropped, by = 0, {}
    for pos, user, value in rows:
        by.setdefault(pos // 64, []).append((pos, user, value))
    assert [r["block"] for r in got] == [b + 1 for b in sorted(by)]
    for r, b in zip(got, sorted(by), strict=True):
        x = [min(max(v / 100 - 1, -0.5), 0.5) for _, _, v in by[b]]
        gains = [v / 100 for pos, _, v in by[b] if pos in on]
        dropped += len(gains) - r["take"]
        assert r["want"] == len(gains) and r["dropped"] == dropped and r["t"] == pytest.approx((b + 1) * 64 / 48_000, abs=1e-6)
        assert r["rms"] == pytest.approx(math.sqrt(sum(v * v for v in x) / len(x)), abs=2e-6) and r["peak"] == pytest.approx(max(map(abs, x)), abs=2e-6)
        assert r["want_e"] == folds.loudness(np.array(gains)).sum() >= r["take_e"] and r["live"] <= 24
