"""Settings of the bar analysis. Fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

#: Seconds of each interval token.
INTERVAL_SECONDS = {
    "1m": 60, "2m": 120, "5m": 300, "15m": 900, "30m": 1800, "60m": 3600, "90m": 5400, "1h": 3600,
    "1d": 86400, "5d": 432000, "1wk": 604800, "1mo": 2592000, "3mo": 7776000,
}
#: Session segments that each mode keeps.
SESSION_MODES = {
    "regular": ("regular",),
    "extended": ("premarket", "regular", "afterhours"),
    "premarket": ("premarket",),
    "regular-and-afterhours": ("regular", "afterhours"),
}


@dataclass(frozen=True)
class PatternConfig:
    """Thresholds of features and detectors."""

    window: int = 20
    range_floor: float = 0.8
    strong_ratio: float = 1.2
    doji_body: float = 0.08
    wick_ratio: float = 0.55
    small_body: float = 0.35
    star_body: float = 0.45
    gap_ratio: float = 0.10
    tolerance_range: float = 0.15
    tolerance_price: float = 0.001
    tolerance_floor: float = 0.01
    level_window: int = 30
    pivot_bars: int = 2
    double_min_gap: int = 4
    double_max_gap: int = 24
    double_price_ratio: float = 0.006
    double_depth: float = 0.008

    def __post_init__(self):
        if self.window < 2 or self.level_window < 1 or self.pivot_bars < 1:
            raise ValueError("windows are counts of bars")
        if not 0 < self.doji_body < 1 or not 0 < self.wick_ratio < 1:
            raise ValueError("ratios lie between 0 and 1")
        if self.double_min_gap > self.double_max_gap:
            raise ValueError("the smallest gap is larger than the largest")


@dataclass(frozen=True)
class EvaluationConfig:
    """What a signal is held against afterwards."""

    horizons: tuple[int, ...] = (1, 3, 6)
    target_return: float = 0.01
    stop_return: float = 0.005
    same_bar: str = "ambiguous"

    def __post_init__(self):
        if not self.horizons or min(self.horizons) < 1:
            raise ValueError("horizons are positive")
        if self.same_bar not in ("ambiguous", "target_first", "stop_first"):
            raise ValueError("unknown rule for bars that touch both")
