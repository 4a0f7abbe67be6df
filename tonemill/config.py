"""Tunables of the event-to-signal operators, checked when made.

Only those that mean something to Spark jobs are here; sizes of device work
groups have no counterpart.
"""

from __future__ import annotations

from dataclasses import dataclass

TILE = 4


@dataclass(frozen=True)
class Config:
    sample_rate: int = 48_000
    channels: int = 2
    block_frames: int = 4096
    gate_frames: int = 32
    max_voices: int = 1_048_576
    max_steal_percent: int = 25
    steal_fade_frames: int = 96
    max_layers: int = 2
    admit: str = "loudest"
    steal: str = "quietest"
    interpolation: str = "linear"
    decay_curve: str = "exponential"
    release_curve: str = "exponential"
    env_floor: float = 1e-5
    filter_enabled: bool = True
    limiter_ceiling_db: float = -0.3
    limiter_lookahead_ms: float = 5.0
    limiter_release_ms: float = 50.0
    limiter_sustain_ms: float = 0.0

    def __post_init__(self) -> None:
        ranges = {
            "sample_rate": (8_000, 768_000),
            "channels": (2, 2),
            "block_frames": (1, 65_535),
            "max_voices": (1, None),
            "max_steal_percent": (1, 100),
            "steal_fade_frames": (1, self.block_frames - 1),
            "max_layers": (1, 255),
            "env_floor": (0.0, 1.0),
            "limiter_ceiling_db": (-24.0, 0.0),
            "limiter_lookahead_ms": (0.05, 100.0),
            "limiter_release_ms": (0.1, 5000.0),
            "limiter_sustain_ms": (0.0, 10_000.0),
        }
        for name, (low, high) in ranges.items():
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} {value} is not in {low}..{'' if high is None else high}")
        for name, of in (("block_frames", TILE), ("gate_frames", TILE), ("block_frames", self.gate_frames)):
            if self.gate_frames <= 0 or getattr(self, name) % of:
                raise ValueError(f"{name} {getattr(self, name)} is not a multiple of {of}")
        choices = {"admit": ("loudest", "even"), "steal": ("quietest", "oldest", "none"), "interpolation": ("nearest", "linear", "cubic"), "decay_curve": ("exponential", "linear"), "release_curve": ("exponential", "linear")}
        for name, known in choices.items():
            if getattr(self, name) not in known:
                raise ValueError(f"{name} {getattr(self, name)!r} is none of {', '.join(known)}")

    @property
    def limiter_ceiling(self) -> float:
        return 10 ** (self.limiter_ceiling_db / 20)

    @property
    def max_steal(self) -> int:
        return max(self.max_voices * self.max_steal_percent // 100, 1)

    @property
    def pool_slots(self) -> int:
        """Voices that a block may hold while stolen ones still fade."""
        return self.max_voices + self.max_steal

    @property
    def steal_span(self) -> int:
        """Frames of a block in which a fade may begin and still end."""
        return max(self.block_frames - self.steal_fade_frames, 1)

    @property
    def block_bytes(self) -> int:
        return self.block_frames * self.channels * 4
