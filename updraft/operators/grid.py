"""Many configurations over one pass of the bars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft.config import ScreenConfig, bar_turnover, metric_info
from updraft.operators.screening import rank_hits, with_ratios
from updraft.operators.streaks import edge_values, in_base, in_streak, with_streak


def _grid_metrics(prices: DataFrame, configs: list[ScreenConfig]) -> DataFrame:
    """Streak figures per code for every metric and baseline length in use."""
    windows = sorted({c.base_window for c in configs})
    shortest = min(c.streak_min for c in configs)
    streak = in_streak()
    bases = {window: in_base(window) for window in windows}
    figures = []
    for metric, value in (("volume", F.col("volume")), ("turnover", bar_turnover())):
        risen = F.when(streak, value)
        figures.append(F.avg(risen).alias(f"avg_{metric}"))
        figures.append(F.min(risen).cast("double").alias(f"min_{metric}"))
        for window, base in bases.items():
            figures.append(F.median(F.when(base, value)).alias(f"base_{metric}_{window}"))
    relevant = (F.col("streak_len") >= shortest) & (
        F.col("age") <= F.col("streak_len") + max(windows)
    )
    return (
        with_streak(prices).filter(relevant)
        .groupBy("code", "streak_len").agg(*figures, *edge_values())
    )


def _trial(name: str, cfg: ScreenConfig) -> Column:
    """What one config sees of a code."""
    info = metric_info(cfg)
    base_volume = F.col(f"base_volume_{cfg.base_window}")
    base_turnover = F.col(f"base_turnover_{cfg.base_window}")
    return F.struct(
        F.lit(name).alias("config"),
        F.lit(cfg.streak_min).alias("streak_min"),
        F.when(F.col("streak_len") >= cfg.streak_top, 1).otherwise(2).alias("tier"),
        F.col(f"avg_{cfg.metric}").alias("avg_m"),
        F.col(f"min_{cfg.metric}").alias("min_m"),
        (base_turnover if cfg.metric == "turnover" else base_volume).alias("base_med"),
        F.lit(cfg.vol_mode).alias("vol_mode"),
        F.lit(float(info.mult)).alias("mult"),
        F.lit(float(info.mult_short)).alias("mult_short"),
        base_volume.alias("base_vol_med"), base_turnover.alias("base_turnover"),
        F.lit(float(cfg.min_volume)).alias("min_volume"),
        F.lit(float(cfg.min_turnover)).alias("min_turnover"),
        F.lit(float(cfg.w_vol)).alias("w_vol"), F.lit(float(cfg.w_rise)).alias("w_rise"),
    )


def config_grid(
    prices: DataFrame, configs: Mapping[str, ScreenConfig], limit: int | None = None
) -> DataFrame:
    """Ranked hits under every named config, told apart by ``config``.

    The bars are shuffled once whatever the number of configs; each code is
    then tried against the handful of configs in place, without a join.
    """
    if not configs:
        raise ValueError("no configs given")
    metrics = _grid_metrics(prices, list(configs.values()))
    trials = F.array(*[_trial(name, cfg) for name, cfg in configs.items()])
    tried = metrics.withColumn("_trial", F.explode(trials)).select(
        "code", "streak_len", "last_date", "last_close", "pre_close", "_trial.*"
    )
    measured = F.when(F.col("vol_mode") == "all", F.col("min_m")).otherwise(F.col("avg_m"))
    factor = F.when(F.col("tier") == 1, F.col("mult")).otherwise(F.col("mult_short"))
    hits = tried.filter(
        (F.col("streak_len") >= F.col("streak_min"))
        & (F.col("base_med") > 0)
        & (F.col("pre_close") > 0)
        & ((F.col("min_volume") <= 0) | (F.col("base_vol_med") > F.col("min_volume")))
        & ((F.col("min_turnover") <= 0) | (F.col("base_turnover") > F.col("min_turnover")))
        & (measured >= F.col("base_med") * factor)
    )
    weights = (F.col("w_vol"), F.col("w_rise"))
    return rank_hits(with_ratios(hits), weights, by=["config"], limit=limit)
