"""Screen configuration and the volume/turnover switch."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from updraft.functions import wording as say

METRICS = ("volume", "turnover")
VOL_MODES = ("all", "avg")


@dataclass(frozen=True)
class ScreenConfig:
    """Everything that shapes one screen. Frozen, so it can key stored results.

    The defaults are fixed values: screens run without arguments must give the
    results existing users know.
    """

    metric: str = "volume"
    streak_min: int = 2
    streak_top: int = 3
    base_window: int = 10
    vol_mult: float = 1.3
    vol_mult_short: float = 2.0
    turnover_vol_mult: float = 1.5
    turnover_vol_mult_short: float = 2.5
    vol_mode: str = "all"
    min_volume: float = 10_000
    min_turnover: float = 0
    w_vol: float = 0.5
    w_rise: float = 0.5

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}, got {self.metric!r}")
        # An unknown mode would match no row at all; an error is kinder.
        if self.vol_mode not in VOL_MODES:
            raise ValueError(f"vol_mode must be one of {VOL_MODES}, got {self.vol_mode!r}")
        if self.streak_min < 0 or self.streak_top < 0:
            raise ValueError("streak lengths must not be negative")
        if self.base_window < 1:
            raise ValueError("base_window must be at least 1")

    @classmethod
    def interactive(
        cls,
        *,
        metric: str = "volume",
        vol_mode: str = "all",
        streak_min: int = 2,
        streak_top: int | None = None,
        mult: float | None = None,
        mult_short: float | None = None,
        base_window: int = 10,
        min_volume: float = 10_000,
        min_turnover_oku: float = 0.0,
        w_vol: float = 0.5,
    ) -> ScreenConfig:
        """Build a config from user-facing knobs and reject values off their scale.

        ``min_turnover_oku`` is in units of 10^8; ``w_rise`` follows from
        ``w_vol`` so that the weights add up to one.
        """
        default = cls()
        if streak_top is None:
            streak_top = max(default.streak_top, streak_min)
        base = (
            (default.vol_mult, default.vol_mult_short)
            if metric == "volume"
            else (default.turnover_vol_mult, default.turnover_vol_mult_short)
        )
        mult = base[0] if mult is None else mult
        mult_short = base[1] if mult_short is None else mult_short

        scales = [
            ("streak_min", streak_min, 1, 10),
            ("streak_top", streak_top, streak_min, 10),
            ("mult", mult, 1.0, 5.0),
            ("mult_short", mult_short, 1.0, 10.0),
            ("base_window", base_window, 5, 30),
            ("min_volume", min_volume, 0, float("inf")),
            ("min_turnover_oku", min_turnover_oku, 0, float("inf")),
            ("w_vol", w_vol, 0.0, 1.0),
        ]
        for name, value, low, high in scales:
            if not low <= value <= high:
                raise ValueError(f"{name} must lie in [{low}, {high}], got {value}")

        own = (
            {"vol_mult": mult, "vol_mult_short": mult_short}
            if metric == "volume"
            else {"turnover_vol_mult": mult, "turnover_vol_mult_short": mult_short}
        )
        return cls(
            metric=metric,
            vol_mode=vol_mode,
            streak_min=streak_min,
            streak_top=streak_top,
            base_window=base_window,
            min_volume=min_volume,
            min_turnover=min_turnover_oku * 1e8,
            w_vol=w_vol,
            w_rise=round(1.0 - w_vol, 2),
            **own,
        )

    @property
    def digest(self) -> str:
        """Short stable key of this config, usable as a partition value."""
        # Equal numbers, 10000 and 10000.0, are one key.
        values = {k: v if isinstance(v, str) else float(v) for k, v in asdict(self).items()}
        text = json.dumps(values, sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class MetricInfo:
    """Thresholds and display facts of the chosen metric."""

    name: str
    mult: float
    mult_short: float
    label: str
    unit: str
    div: float
    suffix: str

    def value(self) -> Column:
        """The measured quantity of one bar."""
        return bar_turnover() if self.name == "turnover" else F.col("volume")


def bar_turnover() -> Column:
    return F.col("close") * F.col("volume")


def metric_info(cfg: ScreenConfig) -> MetricInfo:
    if cfg.metric == "turnover":
        return MetricInfo(
            "turnover", cfg.turnover_vol_mult, cfg.turnover_vol_mult_short,
            say.TURNOVER_LABEL, say.TURNOVER_UNIT, 1e6, "_turnover",
        )
    return MetricInfo(
        "volume", cfg.vol_mult, cfg.vol_mult_short, say.VOLUME_LABEL, say.VOLUME_UNIT, 1, ""
    )


def options_from_flags(flags: Iterable[str]) -> tuple[ScreenConfig, bool]:
    """Read command-line flags into (config, whether to ingest first).

    Known: ``--metric=volume``, ``--metric=turnover``, ``--turnover`` and
    ``--no-fetch``; the last metric flag wins, others are ignored.
    """
    metric, ingest = "volume", True
    for flag in flags:
        if flag in ("--turnover", "--metric=turnover"):
            metric = "turnover"
        elif flag == "--metric=volume":
            metric = "volume"
        elif flag == "--no-fetch":
            ingest = False
    return ScreenConfig(metric=metric), ingest
