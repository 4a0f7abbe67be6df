"""What controllers do to a whole channel: pedals and controller state.

Both are ordered folds: rows are dealt by channel and sorted, a task reads them
batch by batch and carries a channel's state, which has a fixed size (16 x 128
counters at the most). ``channel`` may be any number that tells channels of all
tracks or files apart; that many tasks can share the work.

An event here is (channel, seq, kind, a, b): note_on and note_off with the key
in a; controller with its number in a and its value in b; program with its
number in a; bend with -8192..8191 in a.

Defined cases: a note-off with nothing to end is ignored; a pedal that is pressed
or lifted twice counts once; unknown kinds and controllers change nothing; values
are not checked; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import in_order

# Controller numbers, and where a channel starts.
SUSTAIN, SOSTENUTO, SOUND_OFF, RESET, NOTES_OFF = 64, 66, 120, 121, range(123, 128)
BANK, MOD, DATA, VOLUME, PAN, EXPRESSION, SOFT = 0, 1, 6, 7, 10, 11, 67
FINE, UP, DOWN, NRPN, RPN_FINE, RPN_COARSE = 32, 96, 97, (98, 99), 100, 101
SOUND = {"resonance": 71, "release": 72, "attack": 73, "cutoff": 74, "decay": 75}
VIBRATO_RATE, VIBRATO_DEPTH, TREMOLO = 76, 77, 92
DEFAULT_VOLUME, DEFAULT_RANGE, DRUMS, DRUM_BANK = 127, 2.0, 9, 128
_KEYS = ["channel", "seq", "kind", "a", "b"]


class Gates:
    """The gates of a channel's keys: how many notes began, how many ended, how
    many ends a pedal defers, and how many notes sostenuto has caught."""

    def __init__(self) -> None:
        self.keys: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        self.sustain = self.sostenuto = False

    def publish(self) -> list[int]:
        """Deferred ends take effect, unless a pedal still holds them."""
        if self.sustain or self.sostenuto:
            return []
        ended = [k for k, g in self.keys.items() if g[2]]
        for k in ended:
            g = self.keys[k]
            g[1], g[2] = g[1] + g[2], 0
        return sorted(ended)

    def end(self, key: int) -> list[int]:
        g = self.keys[key]
        caught = self.sostenuto and g[3] > 0
        if not (caught or self.sustain):
            # What a pedal defers stays deferred, but never more than is left.
            if g[1] == g[0]:
                return []
            g[1] += 1
            g[2] = min(g[2], g[0] - g[1])
            return [key]
        if g[1] + g[2] < g[0]:
            g[2] += 1
            g[3] -= caught
        return []

    def controller(self, number: int, value: int) -> list[int]:
        """Keys whose number of ends changes."""
        if number == SUSTAIN and self.sustain != (value >= 64):
            self.sustain = value >= 64
            return self.publish()
        if number == SOSTENUTO and self.sostenuto != (value >= 64):
            self.sostenuto = value >= 64
            for g in self.keys.values():
                g[3] = g[0] - g[1] - g[2] if self.sostenuto else 0
            return self.publish()
        if number == RESET:
            return sorted(self.controller(SOSTENUTO, 0) + self.controller(SUSTAIN, 0))
        if number == SOUND_OFF or number in NOTES_OFF:
            ended = sorted(k for k, g in self.keys.items() if g[1] < g[0])
            for g in self.keys.values():
                if number == SOUND_OFF:
                    g[1:] = [g[0], 0, 0]
                elif self.sustain:
                    g[2] = g[0] - g[1]
                else:
                    g[1:3] = [g[0], 0]
            return [] if number != SOUND_OFF and self.sustain else ended
        return []


def pedalled(ev: DataFrame) -> DataFrame:
    """(channel, key, seq, ons, offs): how many notes of a key have begun, and
    how many have ended for the listener, at each event that changes either.
    Sustain defers the ends of all notes while it is down, sostenuto those of
    the notes that sounded when it went down; ends come out when no pedal holds
    them any more."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, gates = None, Gates()
        for b in batches:
            rows = []
            for channel, seq, kind, a, value in b[_KEYS].itertuples(index=False):
                if channel != last:
                    last, gates = channel, Gates()
                if kind == "note_on":
                    gates.keys[a][0] += 1
                    changed = [a]
                elif kind == "note_off":
                    changed = gates.end(a)
                else:
                    changed = gates.controller(a, value) if kind == "controller" else []
                rows += [(channel, k, seq, *gates.keys[k][:2]) for k in changed]
            yield pd.DataFrame(rows, columns=["channel", "key", "seq", "ons", "offs"]).astype("int64")

    used = ev.filter(F.col("kind").isin("note_on", "note_off", "controller")).select(*_KEYS)
    return in_order(used.fillna(0, ["a", "b"]), "channel", "seq").mapInPandas(fold, "channel long, key long, seq long, ons long, offs long")


def note_spans(gates: DataFrame) -> DataFrame:
    """(channel, key, ordinal, on_seq, off_seq) of each note, from `pedalled`:
    the n-th note of a key ends where its ends reach n, null if they never do."""
    from pyspark.sql import Window

    w = Window.partitionBy("channel", "key").orderBy("seq")
    was = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    steps = gates.withColumns({"ons_was": was("ons"), "offs_was": was("offs")})
    on = steps.filter("ons > ons_was").select("channel", "key", F.col("ons").alias("ordinal"), F.col("seq").alias("on_seq"))
    off = steps.filter("offs > offs_was").select("channel", "key", F.explode(F.sequence(F.col("offs_was") + 1, F.col("offs"))).alias("ordinal"), F.col("seq").alias("off_seq"))
    return on.join(off, ["channel", "key", "ordinal"], "left")


class Controls:
    """A channel's controllers. Coarse values reset their fine halves; data
    entry reaches the bend range only while registered parameter 0 is chosen,
    which any choice of another, or of an unregistered one, ends. The bank that
    is chosen counts when a program is: the preset is fixed there, from the
    coarse half alone, and on a drum channel from the drum bank."""

    OUT = ["bank", "program", "mod", "volume", "pan", "expression", "soft", "bend", "bend_range", *SOUND, "vibrato_rate", "vibrato_depth", "tremolo"]

    def __init__(self, channel: int = 0) -> None:
        self.drums = channel % 16 == DRUMS
        self.reset()
        self.choose(0)
        self.chosen = (0, 0)

    def reset(self) -> None:
        self.bank, self.bend, self.bend_range, self.chosen = 0, 0, DEFAULT_RANGE, None
        self.coarse = {MOD: 0, VOLUME: DEFAULT_VOLUME, PAN: 64, EXPRESSION: 127, SOFT: 0}
        self.fine = dict.fromkeys(self.coarse, 0)
        self.sound = dict.fromkeys(SOUND.values(), 64)
        self.vibrato_rate = self.vibrato_depth = 64
        self.tremolo = 0

    def choose(self, program: int) -> None:
        self.preset = (DRUM_BANK if self.drums else self.bank, program)

    def controller(self, number: int, value: int) -> None:
        if number == BANK:
            self.bank = value
        elif number in self.coarse:
            self.coarse[number], self.fine[number] = value, 0
        elif number - FINE in self.fine and number - FINE != SOFT:
            self.fine[number - FINE] = value
        elif number in self.sound:
            self.sound[number] = value
        elif number == VIBRATO_RATE:
            self.vibrato_rate = value
        elif number == VIBRATO_DEPTH:
            self.vibrato_depth = value
        elif number == TREMOLO:
            self.tremolo = value
        elif number in NRPN:
            self.chosen = None
        elif number in (RPN_FINE, RPN_COARSE):
            coarse, fine = self.chosen or (0, 0)
            self.chosen = (value, fine) if number == RPN_COARSE else (coarse, value)
        elif number == RESET:
            self.reset()
        elif self.chosen == (0, 0):
            if number == DATA:
                self.bend_range = float(value)
            elif number == DATA + FINE:
                self.bend_range = int(self.bend_range) + value / 100
            elif number in (UP, DOWN):
                self.bend_range = min(self.bend_range + 1, 127.0) if number == UP else max(self.bend_range - 1, 0.0)

    def take(self, kind: str, a: int, b: int) -> None:
        """A controller, program or bend event; others change nothing."""
        if kind == "controller":
            self.controller(a, b)
        elif kind == "program":
            self.choose(a)
        elif kind == "bend":
            self.bend = a

    def part(self, number: int) -> float:
        """0..1: from seven bits, or from fourteen where the fine half is sent."""
        coarse, fine = self.coarse[number], self.fine[number]
        return (coarse * 128 + fine) / 16383 if fine else coarse / 127

    def wheel(self) -> float:
        """The modulation wheel is read from fourteen bits always."""
        return (self.coarse[MOD] * 128 + self.fine[MOD]) / 16383

    def gains(self) -> tuple[float, float]:
        """What the channel multiplies its voices by, left and right."""
        amp = self.part(VOLUME) ** 2 * self.part(EXPRESSION) ** 2 * (1 - 0.5 * self.coarse[SOFT] / 127)
        if self.coarse[PAN] == 64 and not self.fine[PAN]:
            return amp, amp
        turn = self.part(PAN) * math.pi / 2
        return amp * math.cos(turn) * math.sqrt(2), amp * math.sin(turn) * math.sqrt(2)

    def now(self) -> tuple:
        return (*self.preset, self.wheel(), self.part(VOLUME), self.part(PAN), self.part(EXPRESSION), self.coarse[SOFT], self.bend / 8192 * self.bend_range, self.bend_range, *self.sound.values(), self.vibrato_rate, self.vibrato_depth, self.tremolo)


def dispatched(ev: DataFrame) -> DataFrame:
    """(channel, seq, *Controls.OUT): a channel's state after each event that can
    change it; bank and program are the preset's, bend is in semitones, mod,
    volume, pan and expression go from 0 to 1, the rest from 0 to 127."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, Controls()
        for b in batches:
            rows = []
            for channel, seq, kind, a, value in b[_KEYS].itertuples(index=False):
                if channel != last:
                    last, state = channel, Controls(channel)
                state.take(kind, a, value)
                rows.append((channel, seq, *state.now()))
            yield pd.DataFrame(rows, columns=["channel", "seq", *Controls.OUT])

    used = ev.filter(F.col("kind").isin("controller", "program", "bend")).select(*_KEYS)
    real = {"mod", "volume", "pan", "expression", "bend", "bend_range"}
    out = ", ".join(f"{c} {'double' if c in real else 'long'}" for c in ["channel", "seq", *Controls.OUT])
    return in_order(used.fillna(0, ["a", "b"]), "channel", "seq").mapInPandas(fold, out)
