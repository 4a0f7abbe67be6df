"""The grid of envelope and filter constants against plain loops."""

import math

import pytest

from tonemill.config import Config
from tonemill.operators import params

REGION = "region long, vel_lo int, vel_hi int, vel_track double, key_to_hold int, key_to_decay int, attack double, hold double, decay double, sustain double, release double, cutoff double, resonance double"
REGIONS = [
    (0, 10, 12, 0.0, 0, 0, 0.1, 0.05, 1.0, 0.5, 0.3, 9000.0, 20.0),
    (1, 10, 12, 2400.0, 0, 0, 0.0, 0.0, 0.002, 0.0, 0.001, 9000.0, 0.0),
    (2, 0, 127, 0.0, 0, 50, 0.1, 0.05, 1.0, 2.0, 0.3, 13_500.0, 0.0),
    (5, 100, 90, 1200.0, -30, 0, 0.1, 0.05, 1.0, 0.5, 0.3, 12_000.0, 0.0),
    (9000, 126, 127, 600.0, 20, 0, 0.5, 0.2, 3.0, 0.1, 2.0, 8000.0, 90.0),
]
NEUTRAL, MOVED = (64, 64, 64, 64, 64), (90, 20, 100, 40, 127)


def number(cc):
    return sum((c >> 1) << 6 * i for i, c in enumerate(cc))


def laid(spark, rows=REGIONS):
    return params.layout(spark.createDataFrame(rows, REGION))


def constants(r, cc, key, vel, even=False):
    _, _, _, track, to_hold, to_decay, attack, hold, decay, sustain, release, cutoff, peak = r
    q, let, rise, bright, fall = (c // 2 * 2 for c in cc)

    def timed(t, c):
        return t * 2 ** ((c - 64) / 8) if c <= 64 else t + 6e-5 * (c - 64) ** 3

    decay *= 2 ** (to_decay * (60 - key) / 1200)
    a = timed(attack, rise) * 48_000
    frames = [max(max(timed(t, c), min(t, 0.004)) * 48_000, 1) for t, c in ((decay, fall), (release, let))]
    up = 1 if a < 1 else 1 / a
    top = 1 + hold * 2 ** (to_hold * (60 - key) / 1200) * 48_000 * up
    cents = cutoff + track * vel / 127 + (bright - 64) * 75
    hz = 8.176 * 2 ** (cents / 1200)
    b0 = 1.0
    if cents < 13_500 and 20 < hz < 48_000 * 0.49:
        w, res = 2 * math.pi * hz / 48_000, 10 ** (((peak + max(q - 64, 0) * 240 / 63) / 10 - 3.01) / 20)
        b0 = math.sqrt(math.sqrt(0.5) / res) * (1 - math.cos(w)) / 2 / (1 + math.sin(w) / (2 * res))
    coef = [1 / n if even else 10 ** (-5 / n) for n in frames]
    return (up, top, *coef, max(min(sustain, 1), 1e-5), b0)


@pytest.mark.parametrize("even", [False, True])
def test_every_entry(spark, even):
    asked = spark.createDataFrame([(r[0], number(cc)) for r in REGIONS for cc in (NEUTRAL, MOVED)] * 2, "region long, variant long")
    kind = "linear" if even else "exponential"
    got = params.grid(laid(spark), asked, Config(decay_curve=kind, release_curve=kind)).collect()
    by = {(r["place"], r["variant"]): r for r in got}
    at, n = 0, 0
    for r in REGIONS:
        keys = range(128) if r[4] or r[5] else [60]
        vels = [r[1] + i for i in range(max(r[2] - r[1], 0) + 1)] if r[3] else [r[1]]
        for vel in vels:
            for key in keys:
                for cc in (NEUTRAL, MOVED):
                    e = by[at, number(cc)]
                    assert e["region"] == r[0]
                    assert [e[c] for c in ("attack_rate", "attack_end", "decay_coef", "release_coef", "decay_target", "b0")] == pytest.approx(constants(r, cc, key, vel, even), rel=1e-9)
                    n += 1
                at += 1
    assert len(got) == len(by) == n == 2 * (1 + 3 + 128 + 128 + 256)


def test_places_of_hits(spark):
    hits = [(0, NEUTRAL, 5, 11), (1, NEUTRAL, 5, 0), (1, MOVED, 5, 12), (1, MOVED, 5, 127), (2, MOVED, 7, 100), (9000, NEUTRAL, 127, 127), (9000, NEUTRAL, None, 127), (77, NEUTRAL, 1, 1)]
    df = spark.createDataFrame([(i, r, number(cc), k, v) for i, (r, cc, k, v) in enumerate(hits)], "id int, region long, variant long, key int, vel int")
    got = {r["id"]: r["place"] for r in params.resolve(df, laid(spark)).collect()}
    # Blocks begin at 0, 1, 4, 132 and 260; neither hit without key or region has a place.
    assert got == {0: 0, 1: 1, 2: 3, 3: 3, 4: 4 + 7, 5: 260 + 128 + 127}


def test_only_what_is_asked_and_without_filters(spark):
    asked = spark.createDataFrame([(2, number(NEUTRAL)), (2, None), (None, 1)], "region long, variant long")
    got = params.grid(laid(spark), asked, Config(filter_enabled=False, env_floor=0.25)).collect()
    assert len(got) == 128 and {(r["b0"], r["filtered"]) for r in got} == {(1.0, False)}
    assert params.grid(laid(spark, []), asked).count() == 0
    assert params.grid(laid(spark), asked.limit(0)).count() == 0


def test_variants_are_the_pool_s(spark):
    from tonemill.operators.performance import variant_of

    df = spark.createDataFrame([MOVED], "a int, b int, c int, d int, e int")
    got = df.select(params.variant(dict(zip(params.SOUND, map(df.__getitem__, "abcde"), strict=True)))).first()[0]
    assert got == variant_of(dict(enumerate(MOVED))) == number(MOVED)


def test_curves_are_checked():
    for bad in ({"decay_curve": "cubic"}, {"release_curve": ""}, {"env_floor": -1.0}):
        with pytest.raises(ValueError):
            Config(**bad)
