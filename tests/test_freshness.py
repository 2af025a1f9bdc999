import datetime as dt

import pytest
from conftest import series
from pyspark.sql import functions as F

from updraft.operators import freshness


def target(spark, now, calendar=None):
    clock = spark.createDataFrame([(now,)], "now timestamp_ntz")
    return freshness.with_latest_trading_day(clock, F.col("now"), calendar).first()["target_day"]


CASES = [
    (dt.datetime(2026, 6, 24, 10, 0), dt.date(2026, 6, 23)),  # before the cutoff
    (dt.datetime(2026, 6, 24, 20, 59), dt.date(2026, 6, 23)),
    (dt.datetime(2026, 6, 24, 21, 0), dt.date(2026, 6, 24)),  # cutoff included
    (dt.datetime(2026, 6, 24, 22, 0), dt.date(2026, 6, 24)),
    (dt.datetime(2026, 6, 28, 22, 0), dt.date(2026, 6, 26)),  # Sunday
    (dt.datetime(2026, 6, 27, 23, 0), dt.date(2026, 6, 26)),  # Saturday
    (dt.datetime(2026, 6, 29, 9, 0), dt.date(2026, 6, 26)),  # Monday morning
]


@pytest.mark.parametrize("now,expected", CASES)
def test_latest_trading_day(spark, now, expected):
    calendar = freshness.trading_calendar(spark, dt.date(2026, 6, 1), dt.date(2026, 7, 1))
    assert target(spark, now) == expected
    assert target(spark, now, calendar) == expected


def test_holidays_are_skipped(spark):
    holidays = spark.createDataFrame([("2026-06-26",), ("2026-06-25",)], "day string")
    calendar = freshness.trading_calendar(spark, dt.date(2026, 6, 1), dt.date(2026, 7, 1), holidays)
    assert target(spark, dt.datetime(2026, 6, 28, 22, 0), calendar) == dt.date(2026, 6, 24)
    assert calendar.count() == 31


def test_data_freshness(prices):
    bars = prices(series("A", [1] * 3, []) + series("B", [1] * 2, []))  # to Jan 7 / Jan 6
    now = dt.datetime(2026, 1, 7, 22, 0)
    row = freshness.data_freshness(bars, now).first()
    assert row["is_fresh"] and row["latest"] == dt.date(2026, 1, 7)
    fresh = {r["code"]: r["is_fresh"] for r in freshness.data_freshness(bars, now, by_code=True).collect()}
    assert fresh == {"A": True, "B": False}
    empty = freshness.data_freshness(prices([]), now).first()
    assert empty["latest"] is None and empty["is_fresh"] is False


@pytest.mark.parametrize(
    "gap,full,start_gap", [(None, True, None), (10, False, 15), (174, False, 179), (175, True, None)]
)
def test_fetch_plan(prices, gap, full, start_gap):
    today = dt.date(2026, 6, 24)
    rows = [] if gap is None else [("A", today - dt.timedelta(days=gap), 1.0, 1.0, 1)]
    plan = freshness.fetch_plan(prices(rows), today).first()
    assert plan["full"] is full
    start = None if start_gap is None else today - dt.timedelta(days=start_gap)
    assert plan["start"] == start
    assert plan["read_from"] == (start or dt.date(2025, 12, 24))


def test_planned_quotes_by_plan_and_by_code(prices):
    today = dt.date(2026, 1, 20)
    stored = prices(series("A", [1] * 10, []))  # to Jan 14
    quotes = prices(series("A", [1] * 15, []) + series("NEW", [1] * 15, []))
    overall = freshness.planned_quotes(quotes, freshness.fetch_plan(stored, today), today)
    assert overall.agg(F.min("date")).first()[0] == dt.date(2026, 1, 9)
    per_code = freshness.fetch_plan(stored, today, by_code=True)
    read = freshness.planned_quotes(quotes, per_code, today)
    firsts = {r["code"]: r["d"] for r in read.groupBy("code").agg(F.min("date").alias("d")).collect()}
    assert firsts == {"A": dt.date(2026, 1, 9), "NEW": dt.date(2026, 1, 5)}


def test_stale_flags(spark):
    rows = spark.createDataFrame([("A", dt.date(2026, 1, 7)), ("B", None)], "code string, latest date")
    def flags(today):
        out = freshness.with_stale_flags(rows, F.col("latest"), today)
        return {r["code"]: (r["is_stale"], r["is_current"], r["stale_note"]) for r in out.collect()}
    assert flags(dt.date(2026, 1, 7)) == {"A": (False, True, ""), "B": (False, False, "")}
    stale, current, note = flags(dt.date(2026, 1, 8))["A"]
    assert stale and not current and "2026-01-07" in note and "2026-01-08" in note
