"""The screen, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from updraft.config import ScreenConfig
from updraft.operators.screening import find_hits, rank_hits
from updraft.operators.streaks import recent_first_metrics, streak_metrics
from updraft.operators.universe import publish


def screen(prices: DataFrame, cfg: ScreenConfig | None = None) -> DataFrame:
    """Rank the codes whose newest bars rise on unusual volume or turnover."""
    cfg = cfg or ScreenConfig()
    return _ranked(streak_metrics(prices, cfg), cfg)


def screen_recent_first(
    recent: DataFrame, older: DataFrame, cfg: ScreenConfig | None = None
) -> DataFrame:
    """The same screen over ``recent`` and ``older`` bars together.

    For long histories split by date, such as ``store.read(since=day)`` and
    ``store.read(before=day)``: older bars are shuffled only for codes their
    recent bars do not settle.
    """
    cfg = cfg or ScreenConfig()
    return _ranked(recent_first_metrics(recent, older, cfg), cfg)


def _ranked(metrics: DataFrame, cfg: ScreenConfig) -> DataFrame:
    return rank_hits(find_hits(metrics, cfg), cfg).orderBy("rank")


def published_screen(
    prices: DataFrame,
    universe: DataFrame,
    cfg: ScreenConfig | None = None,
    name_fallback: bool = True,
) -> DataFrame:
    """The screen with names and markets; unknown codes are named by
    themselves, or NULL without ``name_fallback``."""
    return publish(screen(prices, cfg), universe, name_fallback).orderBy("rank")
