"""Measurement policy: every operator takes its numbers from here, so small fixtures can use small windows."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Closes in a quadratic fit window, by root.
ICM_WINDOWS = {"NQ": 60, "ES": 70, "RTY": 70, "ZT": 140, "ZN": 140, "6E": 110, "6J": 120, "6B": 110}


@dataclass(frozen=True)
class Policy:
    """Clocks in minutes, windows in bars or sessions. The defaults are the frozen production values."""

    fast: int = 5
    medium: int = 30
    atr_bars: int = 24
    atr_floor: float = 1e-6
    value_area: float = 0.70
    rolling: tuple[int, ...] = (30, 60, 120)
    icm_windows: dict = field(default_factory=lambda: dict(ICM_WINDOWS))
    z_cap: float = 4.5
    regime_ratio: float = 1.5
    tod_sessions: int = 30
    tod_min: int = 20
    gap_max_age: int = 48
    min_z_displacement: float = 1.5
    min_efficiency: float = 0.6
    min_z_gap: float = 0.3
    min_wick: float = 0.5
    score_threshold: float = 2.1
    decay: float = 0.05
    volume_z_floor: float = 0.1
    rsi_alpha: float = 1.0 / 14.0
    imsi_tod_min: int = 30
    ewma_decay: float = 0.96
    shrink: tuple[float, float] = (0.05, 0.95)
    max_states: int = 300
    min_states: int = 30
    min_rarity: int = 30
    neighbours: int = 15
    embargo: int = 7
    max_condition: float = 1000.0
    epsilon: float = 1e-12
    closes_kept: int = 300


PRODUCTION = Policy()
#: For sparse tapes, such as the one made from the events table.
SPARSE = Policy(
    fast=30, medium=120, atr_bars=8, rolling=(120, 240, 480), icm_windows=dict.fromkeys(ICM_WINDOWS, 12), tod_min=5, imsi_tod_min=5, min_states=10, min_rarity=5,
    min_z_displacement=0.3, min_efficiency=0.3, min_z_gap=0.05, score_threshold=1.0,
)
