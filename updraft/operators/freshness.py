"""Trading calendar, freshness tests and the incremental-load plan.

``now`` and ``today`` are always parameters: results must not depend on when
a task happens to run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from updraft.functions import wording as say

# The hour from which today's data is expected to be complete,
# days re-read before the newest stored bar, the gap that forces a reload, and
# the months a full load reads.
FRESH_CUTOFF_HOUR = 21
OVERLAP_DAYS = 5
FULL_RELOAD_DAYS = 180
FULL_LOAD_MONTHS = 6


def moment(now: dt.datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def day(today: dt.date | Column) -> Column:
    return today if isinstance(today, Column) else F.lit(today)


def candidate_day(now: Column) -> Column:
    """Today once the data should be complete, yesterday before that."""
    return F.date_sub(F.to_date(now), F.when(F.hour(now) < FRESH_CUTOFF_HOUR, 1).otherwise(0))


def last_weekday(date: Column) -> Column:
    """The date itself, or the Friday before a weekend."""
    return F.date_sub(date, F.greatest(F.weekday(date) - 4, F.lit(0)))


def trading_calendar(
    spark: SparkSession, first: dt.date, last: dt.date, holidays: DataFrame | None = None
) -> DataFrame:
    """(day, is_open, last_open_day) for every day of the range.

    Give a ``first`` early enough to have an open day before any day looked
    up. One row per calendar day: the window below is bounded by the range.
    """
    bounds = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))
    return _open_days(spark.range(1).select(F.explode(bounds).alias("day")), holidays)


# Days before the first date in which some day is open, whatever the holidays.
LEAD_DAYS = 15


def calendar_of(
    df: DataFrame, date: Column, holidays: DataFrame | None = None, lead_days: int = LEAD_DAYS
) -> DataFrame:
    """The ``trading_calendar`` of the dates in ``df``, from ``lead_days`` before the first to the last.

    Without dates it is empty.
    """
    ends = df.agg(F.min(date.cast("date")).alias("a"), F.max(date.cast("date")).alias("b"))
    bounds = F.sequence(F.date_sub("a", lead_days), F.col("b"), F.expr("interval 1 day"))
    return _open_days(ends.select(F.explode(bounds).alias("day")), holidays)


def _open_days(days: DataFrame, holidays: DataFrame | None) -> DataFrame:
    if holidays is None:
        days = days.withColumn("is_open", F.weekday("day") < 5)
    else:
        closed = holidays.select(F.col("day").cast("date"), F.lit(True).alias("_closed")).distinct()
        days = days.join(closed, "day", "left").select(
            "day", ((F.weekday("day") < 5) & F.col("_closed").isNull()).alias("is_open")
        )
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn(
        "last_open_day", F.max(F.when(F.col("is_open"), F.col("day"))).over(so_far)
    )


def with_latest_trading_day(
    df: DataFrame, now: Column, calendar: DataFrame | None = None, out: str = "target_day"
) -> DataFrame:
    """Add the newest day whose data should be complete at ``now``.

    Without a calendar only weekends are closed, which needs no join. With
    one, the as-of lookup is an equality join on the precomputed open day; outside
    it, and before its first open day, the weekend rule holds.
    """
    if calendar is None:
        return df.withColumn(out, last_weekday(candidate_day(now)))
    lookup = calendar.select(F.col("day").alias("_day"), F.col("last_open_day").alias(out))
    # A calendar holds one row per day, so it is safe to send everywhere.
    return (
        df.withColumn("_day", candidate_day(now))
        .join(F.broadcast(lookup), "_day", "left").drop("_day")
        .withColumn(out, F.coalesce(F.col(out), last_weekday(candidate_day(now))))
    )


def latest_date(prices: DataFrame) -> DataFrame:
    """One row: the newest date, NULL when there are no rows."""
    return prices.agg(F.max("date").alias("latest"))


def data_freshness(
    prices: DataFrame,
    now: dt.datetime | Column,
    calendar: DataFrame | None = None,
    by_code: bool = False,
) -> DataFrame:
    """(latest, target_day, is_fresh) overall, or per code.

    No data counts as not fresh.
    """
    latest = (
        prices.groupBy("code").agg(F.max("date").alias("latest")) if by_code else latest_date(prices)
    )
    judged = with_latest_trading_day(latest, moment(now), calendar)
    return judged.withColumn(
        "is_fresh", F.coalesce(F.col("latest") >= F.col("target_day"), F.lit(False))
    )


def stale_note(latest: Column, today: dt.date | Column) -> Column:
    """Warning text when the newest data is not today's, else empty."""
    today = day(today)
    note = F.lit(say.STALE_NOTE)
    for name, date in (("{latest}", latest), ("{today}", today)):
        note = F.replace(note, F.lit(name), F.date_format(date, "yyyy-MM-dd"))
    return F.when(latest.isNotNull() & (latest != today), note).otherwise(F.lit(""))


def with_stale_flags(df: DataFrame, latest: Column, today: dt.date | Column) -> DataFrame:
    """Add ``is_stale``, ``is_current`` and ``stale_note``, compared with the
    calendar day ``today``. Downstream jobs run only on current rows."""
    current = F.coalesce(latest == day(today), F.lit(False))
    return df.withColumns(
        {
            "is_stale": latest.isNotNull() & ~current,
            "is_current": current,
            "stale_note": stale_note(latest, today),
        }
    )


def fetch_plan(prices: DataFrame, today: dt.date | Column, by_code: bool = False) -> DataFrame:
    """What the next load must read: (full, start, read_from), overall or per code.

    ``start`` overlaps the newest stored bar to pick up late corrections; it is
    NULL for a full load, planned when there is no data or a long gap.
    ``read_from`` is the first day to read either way.
    """
    latest = (
        prices.groupBy("code").agg(F.max("date").alias("latest")) if by_code else latest_date(prices)
    )
    start = F.date_sub("latest", OVERLAP_DAYS)
    full = F.coalesce(F.datediff(day(today), start) >= FULL_RELOAD_DAYS, F.lit(True))
    return (
        latest.withColumn("full", full)
        .withColumn("start", F.when(~full, start))
        .withColumn("read_from", F.coalesce("start", _full_load_start(today)))
    )


def _full_load_start(today: dt.date | Column) -> Column:
    return F.add_months(day(today), -FULL_LOAD_MONTHS)


def planned_quotes(quotes: DataFrame, plan: DataFrame, today: dt.date | Column) -> DataFrame:
    """The quotes a plan asks for.

    An overall plan becomes a date bound that prunes the scan. A plan per code
    is looked up by code; codes it does not know are loaded in full.
    """
    if "code" not in plan.columns:
        return quotes.filter(F.col("date") >= plan.select("read_from").scalar())
    asked = quotes.join(plan.select("code", "read_from"), "code", "left")
    first = F.coalesce("read_from", _full_load_start(today))
    return asked.filter(F.col("date") >= first).select(*quotes.columns)
