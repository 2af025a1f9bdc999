"""Missing bars: open days of the calendar on which a code has no bar.

Open days are numbered, so a gap is a jump in the numbers of neighbouring bars and a run is a
constant difference between number and position. Nothing is exploded by day: the work grows
with the bars, whatever the length of a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def open_days(calendar: DataFrame) -> DataFrame:
    """(day, ordinal, previous_open, next_open, last_ordinal, last_open) of the open days of a ``trading_calendar``."""
    in_order = Window.orderBy("day")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return calendar.where("is_open").select(
        "day", F.row_number().over(in_order).alias("ordinal"),
        F.lag("day").over(in_order).alias("previous_open"), F.lead("day").over(in_order).alias("next_open"),
        F.count(F.lit(1)).over(whole).alias("last_ordinal"), F.max("day").over(whole).alias("last_open"),
    )


def _numbered(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars with the number of their day; bars on closed days or outside the calendar are left out."""
    # One row per calendar day: safe to send everywhere.
    return bars.select("code", "date").join(F.broadcast(open_days(calendar)), F.col("date") == F.col("day")).drop("day")


def bar_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(code, gap_from, gap_to, missing, trailing): each stretch of open days without a bar of the code.

    Counted from the code's first bar to the calendar's last open day; a gap that ends there is
    ``trailing``. ``bars`` hold one row per (code, date).
    """
    by_date = Window.partitionBy("code").orderBy("date")
    rows = _numbered(bars, calendar).withColumns({
        "_next": F.lead("ordinal").over(by_date), "_until": F.lead("previous_open").over(by_date),
    })
    missing = F.coalesce("_next", F.col("last_ordinal") + 1) - F.col("ordinal") - 1
    return rows.where(missing > 0).select(
        "code", F.col("next_open").alias("gap_from"), F.coalesce("_until", "last_open").alias("gap_to"),
        missing.cast("bigint").alias("missing"), F.col("_next").isNull().alias("trailing"),
    )


def bar_runs(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(code, run_from, run_to, bars): the stretches of open days on each of which the code has a bar."""
    position = F.row_number().over(Window.partitionBy("code").orderBy("date"))
    islands = _numbered(bars, calendar).withColumn("_island", F.col("ordinal") - position)
    return islands.groupBy("code", "_island").agg(
        F.min("date").alias("run_from"), F.max("date").alias("run_to"), F.count(F.lit(1)).alias("bars")
    ).drop("_island")
