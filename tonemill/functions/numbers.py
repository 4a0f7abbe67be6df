"""Units, gains, fixed point and ranking keys as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M48 = 1 << 48


def timecents_to_seconds(tc: Column) -> Column:
    return F.when(tc <= -12000, 0.0).otherwise(F.pow(F.lit(2.0), tc / 1200))


def cents_to_hz(cents: Column) -> Column:
    return F.pow(F.lit(2.0), cents / 1200) * 8.176


def centibels_to_gain(cb: Column) -> Column:
    return F.pow(F.lit(10.0), -cb / 200)


def decibels(v: Column) -> Column:
    return F.when(v > 0, F.log10(v) * 20).otherwise(float("-inf"))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def velocity_attenuation(vel: Column, track: Column) -> Column:
    """Centibels of attenuation: the square of velocity at full tracking (in
    percent), blended with unity below, inverted where negative."""
    v, t = F.greatest(vel, F.lit(1)) / 127, clamp(track, -100, 100) / 100
    gain = F.when(t >= 0, 1 - t * (1 - v * v)).otherwise(1 + t * v * v)
    return F.when(gain <= 0, 960.0).otherwise(clamp(F.log10(gain) * -200, 0.0, 960.0))


def pitch_ratio(key: Column, root: Column, cents_a_key: Column, tune: Column, rate: float = 1.0) -> Column:
    return F.pow(F.lit(2.0), ((key - root) * cents_a_key + tune) / 1200) * rate


def pan_gains(pan: Column) -> tuple[Column, Column]:
    """Constant power; pan in -1..1."""
    theta = (clamp(pan, -1.0, 1.0) + 1) / 2 * (math.pi / 2)
    return F.cos(theta), F.sin(theta)


def controller(msb: Column, lsb: Column) -> Column:
    """0..1 from seven bits, or from fourteen where the fine half is sent."""
    return F.when(lsb == 0, msb / 127).otherwise((msb * 128 + lsb) / 16383)


def channel_gains(volume: Column, expression: Column, pan: Column, soft: Column, fine: tuple[Column, Column, Column] | None = None) -> tuple[Column, Column]:
    """Volume and expression squared, the soft pedal taking off up to half,
    constant-power pan with a centre of exactly one; ``fine`` are the fine
    halves of volume, expression and pan, 0 where none is sent."""
    fine = fine or (F.lit(0), F.lit(0), F.lit(0))
    v, e = controller(volume, fine[0]), controller(expression, fine[1])
    amp = v * v * e * e * (1 - soft / 254)
    theta, centre = controller(pan, fine[2]) * (math.pi / 2), (pan == 64) & (fine[2] == 0)
    left = F.when(centre, 1.0).otherwise(F.cos(theta) * math.sqrt(2))
    right = F.when(centre, 1.0).otherwise(F.sin(theta) * math.sqrt(2))
    return amp * left, amp * right


def bend_factor(bend: Column, semitones: Column) -> Column:
    """8.24 fixed-point factor of a bend of -8192..8191 over a range, held to
    32 bits and above 0; one where the bend isn't a finite number."""
    by = (bend / 8192 * semitones).cast("double")
    finite = ~(F.isnan(by) | F.abs(by).isin(float("inf")))
    factor = F.round(F.least(F.pow(F.lit(2.0), by / 12) * (1 << 24), F.lit(float((1 << 32) - 1))))
    return F.when(finite, F.greatest(factor.cast("long"), F.lit(1))).otherwise(F.lit(1 << 24)).cast("long")


def fixed(value: Column) -> Column:
    """32.32 fixed point, in the 64 bits of decimal(20,0): cut, not rounded,
    held to what the bits can say; 0 for what isn't positive or no number."""
    # Whole part and fraction apart: a double isn't cast to decimal by its bits.
    held = F.when(value < float(1 << 32), value).otherwise(0.0)
    whole = F.floor(held)
    bits = whole.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.floor((held - whole) * float(1 << 32)).cast("decimal(12,0)")
    out = F.when(value < float(1 << 32), bits).otherwise(F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"))
    return F.when((value > 0) & ~F.isnan(value), out).otherwise(F.lit(0)).cast("decimal(20,0)")


def fixed_parts(value: Column) -> tuple[Column, Column]:
    """(whole, fraction of 2^32) of a 32.32 number."""
    one = F.lit(1 << 32).cast("decimal(20,0)")
    low = F.pmod(value, one)
    return ((value - low) / one).cast("long"), low.cast("long")


def fixed_add(a: Column, b: Column) -> Column:
    """Sum of two 32.32 numbers, wrapped at 64 bits."""
    return F.pmod(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def vibrato(mod: Column, depth: Column, phase: Column) -> Column:
    """Cents of vibrato: 50 at a full wheel (0..1) and neutral depth (64)."""
    return mod * depth / 64 * 50 * F.sin(phase * (2 * math.pi))


def tremolo(value: Column, phase: Column) -> Column:
    """Gain of tremolo, which takes off up to half at its controller's top."""
    t = value / 127 * 0.25
    return 1 - t + t * F.sin(phase * (2 * math.pi))


def lfo_rate(value: Column) -> Column:
    """Turns a second, 5 at a neutral controller (64)."""
    return F.pow(F.lit(2.0), (value - 64) / 32) * 5


def fixed_scale(value: Column, factor: Column) -> Column:
    """value * factor / 2^24 in whole numbers, cut towards 0, without overflow.
    A quotient of decimals would be rounded to six digits before it is cut."""
    product = value.cast("decimal(20,0)") * factor.cast("decimal(18,0)")
    return F.call_function("div", product, F.lit(1 << 24).cast("decimal(10,0)"))


def gain_rank(gain: Column) -> Column:
    """The 15 bits below the sign of a gain as a 32-bit float: a logarithmic
    rank. Worked out from the binary exponent, as SQL can't see a float's bits;
    0 for what isn't positive."""
    guess = F.floor(F.log2(gain))
    exponent = guess + F.when(F.pow(F.lit(2.0), guess + 1) <= gain, 1).when(F.pow(F.lit(2.0), guess) > gain, -1).otherwise(0)
    rank = (exponent + 127) * 128 + F.floor((gain / F.pow(F.lit(2.0), exponent) - 1) * 128)
    return F.when(gain > 0, rank.cast("long")).otherwise(F.lit(0).cast("long"))


def mix48(index: Column) -> Column:
    """A bijective scrambling of 48-bit numbers, for ties without pattern."""
    # The odd multipliers.
    times = lambda z, m: F.pmod(z.cast("decimal(38,0)") * F.lit(m).cast("decimal(18,0)"), F.lit(M48).cast("decimal(38,0)")).cast("long")
    z = index.bitwiseAND(M48 - 1)
    z = times(z.bitwiseXOR(F.shiftright(z, 24)), 0x9E37_79B9_7F4B)
    z = times(z.bitwiseXOR(F.shiftright(z, 23)), 0xBF58_476D_1CE5)
    return z.bitwiseXOR(F.shiftright(z, 25))


def bytes_text(n: Column) -> Column:
    """1536 as 1.50 KiB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1 << 10 * i, F.concat(F.format_string("%.2f", n / float(1 << 10 * i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def key_scaled(seconds: Column, timecents: Column, key: Column) -> Column:
    """An envelope time that changes by ``timecents`` a key, key 60 neutral."""
    return seconds * F.pow(F.lit(2.0), timecents * (60 - key) / 1200)


def envelope(attack: Column, hold: Column, decay: Column, release: Column, rate: float, base: tuple[Column, Column] | None = None, linear: tuple[bool, bool] = (False, False), least: float = 0.004) -> dict[str, Column]:
    """Per-frame constants of an envelope given in seconds. Decay and release
    fall by 100 dB in their time, or to nothing in even steps where ``linear``;
    neither is shorter than ``least``, or than its time in ``base`` (that
    without controllers) if that is less."""
    base = base or (decay, release)
    frames = lambda t, b: F.greatest(F.greatest(t, F.least(b, F.lit(least))) * rate, F.lit(1.0))
    fall = lambda n, even: 1 / n if even else F.pow(F.lit(10.0), -5 / n)
    attack_rate = F.when(attack * rate < 1, 1.0).otherwise(1 / (attack * rate))
    return {
        "attack_rate": attack_rate,
        "attack_end": 1 + hold * rate * attack_rate,
        "decay_coef": fall(frames(decay, base[0]), linear[0]),
        "release_coef": fall(frames(release, base[1]), linear[1]),
    }


def lowpass(cents: Column, q_cb: Column, rate: float) -> dict[str, Column]:
    """Coefficients of a two-pole low-pass (b2 is b0), normalised so that the
    default resonance passes at unity; a pass-through where the cutoff is out of
    the useful range, or at 13,500 cents or more, which asks for no filter."""
    hz = cents_to_hz(cents)
    q = F.greatest(F.pow(F.lit(10.0), (q_cb / 10 - 3.01) / 20), F.lit(0.001))
    w = clamp(hz / rate, 1e-5, 0.49) * (2 * math.pi)
    alpha = F.sin(w) / (q * 2)
    a0, level = 1 + alpha, F.sqrt(F.lit(math.sqrt(0.5)) / q)
    used = (cents < 13_500) & (hz > 20) & (hz < rate * 0.49)
    of = lambda c, idle: F.when(used, c / a0).otherwise(idle)
    return {"b0": of(level * (1 - F.cos(w)) / 2, 1.0), "b1": of(level * (1 - F.cos(w)), 0.0), "a1": of(F.cos(w) * -2, 0.0), "a2": of(1 - alpha, 0.0)}


def time_controller(seconds: Column, value: Column) -> Column:
    """A controller on an envelope time, 64 neutral: halved each eight steps
    below, lengthened by the cube of the steps above."""
    d = (value - 64).cast("double")
    return F.when(d <= 0, seconds * F.pow(F.lit(2.0), d / 8)).otherwise(seconds + d * d * d * 6e-5)


def to_pcm16(v: Column) -> Column:
    return F.round(clamp(v, -1.0, 1.0) * 32767).cast("long")
