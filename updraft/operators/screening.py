"""From streak metrics to ranked hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft.config import ScreenConfig, metric_info
from updraft.functions.numeric import ratio, round_scaled, to_bigint
from updraft.operators import ranking
from updraft.session import materialize

RESULT_COLUMNS = (
    "rank", "code", "streak_len", "tier", "last_date", "last_close", "rise_pct",
    "avg_vol3", "min_vol3", "base_med", "avg_ratio", "min_ratio", "score",
)


def above_limit(value: Column, limit: float) -> Column:
    """Liquidity: a value at or below the limit is out; no limit at zero."""
    return F.lit(True) if limit <= 0 else value > F.lit(float(limit))


def tier_of(cfg: ScreenConfig) -> Column:
    return F.when(F.col("streak_len") >= cfg.streak_top, 1).otherwise(2)


def is_hit(cfg: ScreenConfig) -> Column:
    """Positive base, liquid enough, and far enough above the baseline.

    The comparison uses unrounded figures; ``all`` mode tests the lowest bar
    of the streak, ``avg`` mode their mean.
    """
    info = metric_info(cfg)
    measured = F.col("min_m") if cfg.vol_mode == "all" else F.col("avg_m")
    factor = F.when(F.col("tier") == 1, float(info.mult)).otherwise(float(info.mult_short))
    return (
        (F.col("base_med") > 0)
        & (F.col("pre_close") > 0)
        & above_limit(F.col("base_vol_med"), cfg.min_volume)
        & above_limit(F.col("base_turnover"), cfg.min_turnover)
        & (measured >= F.col("base_med") * factor)
    )


def with_ratios(df: DataFrame) -> DataFrame:
    """Rise and ratios, rounded before they are ranked: ties are intended."""
    gain = ratio(F.col("last_close") - F.col("pre_close"), F.col("pre_close"))
    return df.withColumns(
        {
            "rise_pct": round_scaled(gain * 100, 2),
            "avg_ratio": round_scaled(ratio(F.col("avg_m"), F.col("base_med")), 2),
            "min_ratio": round_scaled(ratio(F.col("min_m"), F.col("base_med")), 2),
        }
    )


def find_hits(metrics: DataFrame, cfg: ScreenConfig) -> DataFrame:
    return with_ratios(metrics.withColumn("tier", tier_of(cfg)).filter(is_hit(cfg)))


def rank_hits(
    hits: DataFrame,
    weights: ScreenConfig | tuple[Column, Column],
    by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Score and rank hits, within each ``by`` group if given.

    The hits, far fewer than the bars, are stored once; their checked size
    then decides between the built-in windows and the distributed ranks.
    ``limit`` overrides the largest group one task may rank.
    """
    limit = ranking.SINGLE_TASK_ROWS if limit is None else limit
    if isinstance(weights, ScreenConfig):
        w_vol, w_rise = F.lit(float(weights.w_vol)), F.lit(float(weights.w_rise))
    else:
        w_vol, w_rise = weights
    hits = materialize(hits)
    single_task = ranking.largest_group(hits, by) <= limit

    ranked = ranking.percent_ranks(
        hits, {"min_ratio": "_pr_vol", "rise_pct": "_pr_rise"},
        by, unique="code", single_task=single_task,
    ).withColumn("_score", w_vol * F.col("_pr_vol") + w_rise * F.col("_pr_rise"))
    # The code closes the order, so equal hits get a reproducible rank.
    order = [
        F.col("tier").asc(), F.col("_score").desc(), F.col("rise_pct").desc(),
        F.col("min_ratio").desc(), F.col("code").asc(),
    ]
    numbered = ranking.row_numbers(ranked, order, "rank", by, single_task=single_task)
    lowest = F.col("min_m")
    if hits.schema["min_m"].dataType.typeName() != "long":
        lowest = to_bigint(lowest)
    return numbered.select(
        *by, "rank", "code", F.col("streak_len").cast("bigint").alias("streak_len"),
        F.col("tier").cast("int").alias("tier"), "last_date", "last_close", "rise_pct",
        to_bigint(F.col("avg_m")).alias("avg_vol3"),
        lowest.alias("min_vol3"),
        to_bigint(F.col("base_med")).alias("base_med"),
        "avg_ratio", "min_ratio",
        round_scaled(F.col("_score"), 3).alias("score"),
    )
