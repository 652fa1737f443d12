"""Parameters of the panel engine; every operator takes them as arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The window of the panel and the constants that are part of the semantics."""

    start: str = "2024-01-01 00:00:00"
    hours: int = 720
    zones: int = 25
    holidays: tuple[str, ...] = ("2024-01-01",)
    base_seed: int = 20250901
    warmup: int = 168
    n_folds: int = 4
    test_hours: int = 72
    min_train: int = 240
    horizons: tuple[int, ...] = (1, 6, 24)
    window: int = 168
    reference: int = 168
    spill_decay_m: float = 2000.0


# Lags at the origin, lags of the neighbours' mean, rolling windows, rounding of the ceiling.
LAGS = (0, 1, 2, 23, 24, 47, 167)
NEIGHBOUR_LAGS = (0, 23)
WINDOWS = (24, 168)
CEILING = 0.999
FLAT_RUN = 4
MEASURES = ("occupancy", "volume", "volume_11kw", "duration", "e_price", "s_price")

DEFAULT = Settings()
