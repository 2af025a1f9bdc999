"""The screen as of every date in history, in one pass.

Replays the nightly screen: the row of (code, date) carries the streak ending
there and its baseline. A streak's baseline is the trailing median at the last
bar that was not up, so it can be carried forward instead of searched for.

One exchange on the code serves all windows; a window holds at most one bar
per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.config import ScreenConfig, metric_info
from updraft.operators.screening import find_hits, rank_hits
from updraft.operators.streaks import is_up


def _median(values: Column) -> Column:
    """Interpolated median of an array without NULLs; NULL if it is empty."""
    ordered = F.array_sort(values)
    size = F.size(ordered)
    low = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(size / 2).cast("int"))
    return (low.cast("double") + high.cast("double")) / 2


def sweep_metrics(prices: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Streak metrics for every bar that ends a long enough streak.

    Same columns as ``streak_metrics`` plus ``next_date``, the date of the
    code's following bar. The trailing bars are gathered once as short arrays,
    and medians are taken only at rows a streak starts from.
    """
    info = metric_info(cfg)
    in_time = Window.partitionBy("code").orderBy("date")
    trailing = in_time.rowsBetween(1 - cfg.base_window, Window.currentRow)
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    flagged = prices.select(
        "code", "date", "open", "close", "volume",
        F.lag("close").over(in_time).alias("_previous_close"),
        F.lead("date").over(in_time).alias("next_date"),
        F.row_number().over(in_time).alias("_position"),
    ).withColumn("up", is_up(F.col("_previous_close")))
    gathered = flagged.withColumns(
        {
            "_next_up": F.coalesce(F.lead("up").over(in_time), F.lit(False)),
            "_bars": F.collect_list(F.struct("volume", "close")).over(trailing),
        }
    )

    def known(value) -> Column:
        return F.filter(F.transform("_bars", value), lambda v: v.isNotNull())

    volumes = known(lambda bar: bar["volume"])
    turnovers = known(lambda bar: bar["close"] * bar["volume"])
    base = F.when(
        ~F.col("up") & F.col("_next_up"),
        F.struct(
            _median(turnovers if cfg.metric == "turnover" else volumes).alias("base_med"),
            _median(volumes).alias("base_vol_med"),
            _median(turnovers).alias("base_turnover"),
            F.col("close").alias("pre_close"),
            F.col("_position").alias("position"),
        ),
    )
    carried = (
        gathered.withColumn("_base", base).drop("_bars")
        .withColumn("_base", F.last("_base", ignorenulls=True).over(so_far))
        .filter("up")
    )
    # The rows left are streak rows; (code, start) identifies a streak.
    inside = (
        Window.partitionBy("code", "_start").orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    value = info.value()
    return (
        carried.withColumn("_start", F.col("_base.position"))
        .withColumns({"avg_m": F.avg(value).over(inside), "min_m": F.min(value).over(inside)})
        .withColumn("streak_len", (F.col("_position") - F.col("_start")).cast("bigint"))
        .filter(F.col("streak_len") >= cfg.streak_min)
        .select(
            "code", "streak_len", "avg_m", "min_m",
            "_base.base_med", "_base.base_vol_med", "_base.base_turnover",
            F.col("date").alias("last_date"), F.col("close").alias("last_close"),
            "_base.pre_close", "next_date",
        )
    )


def sweep_screen(
    prices: DataFrame,
    cfg: ScreenConfig,
    carry_forward: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Ranked hits of every as-of date.

    By default a date's population is the bars of that date. With
    ``carry_forward`` a code also competes, with its newest bar so far, on
    dates it has no bar for - what a screen run on that date would have seen.
    """
    hits = find_hits(sweep_metrics(prices, cfg), cfg)
    if carry_forward:
        hits = _valid_until_next(hits, prices)
    else:
        hits = hits.withColumn("as_of", F.col("last_date"))
    return rank_hits(hits.drop("next_date"), cfg, by=["as_of"], limit=limit)


def _valid_until_next(hits: DataFrame, prices: DataFrame) -> DataFrame:
    """One copy of a hit per data date up to the code's next bar.

    The data dates, bounded by the calendar, are one sorted array; each hit is
    expanded over its slice of them and no other day.
    """
    days = prices.agg(F.sort_array(F.collect_set("date"))).scalar()
    first = F.array_position(days, F.col("last_date"))
    after = F.coalesce(F.array_position(days, F.col("next_date")), F.size(days) + 1)
    return hits.withColumn("as_of", F.explode(F.slice(days, first.cast("int"), (after - first).cast("int"))))
