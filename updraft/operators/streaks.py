"""Rising streaks at the newest bar of each code, and their baseline.

Input is ``prices(code, date, open, close, volume)`` with one row per
(code, date); the bar builder and the upsert both guarantee that. A window per
code therefore holds at most one row per calendar day, however many trades a
hot code had: trades are reduced to bars before they reach this module.

Both window passes use one descending order, so Spark plans one exchange, one
sort and no join, and the grouping afterwards reuses the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.config import ScreenConfig, bar_turnover, metric_info
from updraft.session import BROADCAST_ROWS, materialize


def is_up(previous_close: Column) -> Column:
    """Closed above the previous close and above its own open, both strictly.

    Unknown (the oldest bar has no previous close) counts as not up.
    """
    close = F.col("close")
    return F.coalesce((close > previous_close) & (close > F.col("open")), F.lit(False))


def with_streak(prices: DataFrame) -> DataFrame:
    """Add ``age`` (1 = newest bar of the code), ``up`` and ``streak_len``.

    Neighbours are stored rows, not calendar days, and each code is measured
    at its own newest bar.
    """
    newest_first = Window.partitionBy("code").orderBy(F.col("date").desc())
    whole_code = Window.partitionBy("code")
    flagged = prices.select(
        "code", "date", "open", "close", "volume",
        F.row_number().over(newest_first).cast("bigint").alias("age"),
        F.lead("close").over(newest_first).alias("_previous_close"),
    ).withColumn("up", is_up(F.col("_previous_close")))
    first_break = F.min(F.when(~F.col("up"), F.col("age"))).over(whole_code)
    return flagged.drop("_previous_close").withColumn(
        "streak_len", F.coalesce(first_break - 1, F.lit(0)).cast("bigint")
    )


def streak_lengths(prices: DataFrame) -> DataFrame:
    """One row per code: (code, streak_len)."""
    return (
        with_streak(prices)
        .filter(F.col("age") == 1)
        .select("code", "streak_len")
    )


def in_streak() -> Column:
    return F.col("age") <= F.col("streak_len")


def in_base(window: int) -> Column:
    """The ``window`` bars just before the streak, fewer on a short history."""
    return F.col("age").between(F.col("streak_len") + 1, F.col("streak_len") + window)


def edge_values() -> list[Column]:
    """Aggregates that pick single bars: the newest, and the last before the streak."""
    newest = F.col("age") == 1
    before = F.col("age") == F.col("streak_len") + 1
    return [
        F.max(F.when(newest, F.col("date"))).alias("last_date"),
        F.max(F.when(newest, F.col("close"))).alias("last_close"),
        F.max(F.when(before, F.col("close"))).alias("pre_close"),
    ]


def summarize(marked: DataFrame, cfg: ScreenConfig, *extra_keys: str) -> DataFrame:
    """Streak and baseline figures per code of bars marked by ``with_streak``.

    All three medians are kept: liquidity is judged on volume and turnover
    whichever metric is screened. Medians hold at most ``base_window`` values.
    """
    value = metric_info(cfg).value()
    streak, base = in_streak(), in_base(cfg.base_window)
    streak_value = F.when(streak, value)
    return (
        marked.filter(F.col("age") <= F.col("streak_len") + cfg.base_window)
        .groupBy("code", "streak_len", *extra_keys)
        .agg(
            F.avg(streak_value).alias("avg_m"),
            F.min(streak_value).alias("min_m"),
            F.median(F.when(base, value)).alias("base_med"),
            F.median(F.when(base, F.col("volume"))).alias("base_vol_med"),
            F.median(F.when(base, bar_turnover())).alias("base_turnover"),
            *edge_values(),
        )
    )


def streak_metrics(prices: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Figures of every code with a long enough streak; other codes and bars
    older than the baseline are dropped before grouping."""
    marked = with_streak(prices).filter(F.col("streak_len") >= cfg.streak_min)
    return summarize(marked, cfg)


def recent_first_metrics(recent: DataFrame, older: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """``streak_metrics`` of ``recent`` and ``older`` bars together, shuffling
    older bars only for the codes that need them.

    Every older bar must precede every recent one. A code is settled by its
    recent bars when they reach past its baseline; the first bar beyond it also
    proves the bar that ends the streak. Left over are codes with few recent
    bars or a long streak, and codes with none: of older bars only the code
    column is read to find the latter, and a filter on the codes left over,
    broadcast if counted small, runs before the shuffle.
    """
    bars = F.count(F.lit(1)).over(Window.partitionBy("code"))
    reach = F.col("streak_len") + cfg.base_window
    marked = with_streak(recent).withColumn("settled", bars > reach)
    per_code = materialize(summarize(marked, cfg, "settled"))

    silent = older.select("code").distinct().join(per_code.select("code"), "code", "left_anti")
    left_over = materialize(per_code.filter("NOT settled").select("code").unionByName(silent))
    count = left_over.count()
    settled = per_code.filter(F.col("settled") & (F.col("streak_len") >= cfg.streak_min))
    settled = settled.drop("settled")
    if count == 0:
        return settled
    if count <= BROADCAST_ROWS:
        left_over = F.broadcast(left_over)
    rest = recent.unionByName(older).join(left_over, "code", "left_semi")
    return settled.unionByName(streak_metrics(rest, cfg))
