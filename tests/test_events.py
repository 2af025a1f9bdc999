"""Gaps on the calendar, as-of lookups and bars from a stream in event time."""

import datetime as dt
import random

from pyspark.sql import functions as F

from updraft.operators.asof import asof_lookup
from updraft.operators.freshness import calendar_of, trading_calendar
from updraft.operators.gaps import bar_gaps, bar_runs
from updraft.sinks.price_store import PriceStore
from updraft.streaming.bars import bar_stream, late_rows, store_bars


def d(text):
    return dt.date.fromisoformat(text)


def test_gaps_and_runs_skip_closed_days(spark):
    holidays = spark.createDataFrame([("2026-01-07",)], "day string")
    calendar = trading_calendar(spark, d("2026-01-01"), d("2026-01-16"), holidays)
    # A: Fri, Mon, Tue, then after a holiday Thu; B: one day; C: a Saturday only; D: has all.
    dates = {"A": ["2026-01-02", "2026-01-05", "2026-01-06", "2026-01-08", "2026-01-14"], "B": ["2026-01-16"], "C": ["2026-01-10"]}
    dates["D"] = [r["day"].isoformat() for r in calendar.where("is_open").collect()]
    bars = spark.createDataFrame([(c, d(x), 1) for c, own in dates.items() for x in own], "code string, date date, extra int")
    gaps = {tuple(r) for r in bar_gaps(bars, calendar).collect()}
    assert gaps == {("A", d("2026-01-09"), d("2026-01-13"), 3, False), ("A", d("2026-01-15"), d("2026-01-16"), 2, True)}
    runs = {tuple(r) for r in bar_runs(bars, calendar).collect() if r["code"] != "D"}
    assert runs == {("A", d("2026-01-02"), d("2026-01-08"), 4), ("A", d("2026-01-14"), d("2026-01-14"), 1), ("B", d("2026-01-16"), d("2026-01-16"), 1)}
    assert bar_gaps(bars.limit(0), calendar).count() == 0
    plan = bar_gaps(bars, calendar)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Generate" in plan  # the calendar's days alone are generated


def test_calendar_of_dates(spark):
    days = spark.createDataFrame([(d("2026-01-05"),), (None,), (d("2026-01-09"),)], "x date")
    got = calendar_of(days, F.col("x"), lead_days=2).orderBy("day").collect()
    assert (got[0]["day"], got[-1]["day"], len(got)) == (d("2026-01-03"), d("2026-01-09"), 7)
    assert calendar_of(days.limit(0), F.col("x")).count() == 0


def test_asof_equals_brute_force(spark):
    rnd = random.Random(6)
    # A third of all events ask for one key; rows are rare, so values are carried over several months.
    stamp = lambda n: d("2025-01-01") + dt.timedelta(days=n)
    known = {(k, n): rnd.randrange(99) for k in ("hot", "b", "c") for n in rnd.sample(range(600), 9)}
    events = [(i, rnd.choice(["hot", "hot", "b", "c", "none"]), stamp(rnd.randrange(600))) for i in range(300)] + [(900, None, stamp(5)), (901, "b", None), (901, "b", None)]
    rows = [(k, stamp(n), v if v % 5 else None) for (k, n), v in known.items()] + [(None, stamp(1), 1), ("b", None, 2)]
    got = asof_lookup(
        spark.createDataFrame(events, "id int, code string, at date"), spark.createDataFrame(rows, "code string, since date, value int"),
        "code", "at", "since", ["value"],
    )
    assert got.columns == ["id", "code", "at", "since", "value"]
    want = []
    for i, code, at in events:
        own = [(s, v) for k, s, v in rows if code is not None and at is not None and k == code and s is not None and s <= at]
        want.append((i, code, at, *(max(own, key=lambda x: x[0]) if own else (None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


TRADES = "id long, ts timestamp, code string, price double, quantity long"


def test_stream_drops_late_trades_and_goes_on_after_a_restart(spark, tmp_path):
    source, store = str(tmp_path / "in"), PriceStore(spark, str(tmp_path / "store"))
    at = lambda day, hour: dt.datetime(2026, 1, day, hour)

    def run(rows):
        spark.createDataFrame(rows, TRADES).coalesce(1).write.mode("append").parquet(source)
        trades = spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(source)
        bars = bar_stream(trades, code=F.col("code"), ts=F.col("ts"), key=F.col("id"), price=F.col("price"), quantity=F.col("quantity"), delay="12 hours")
        query = store_bars(bars, store, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return late_rows(query)

    assert run([(1, at(5, 9), "A", 10.0, 5), (2, at(5, 15), "A", 12.0, 5), (2, at(5, 15), "A", 12.0, 5)]) == 0
    # within the delay: an earlier trade of the first day, and one seen already
    assert run([(3, at(5, 8), "A", 9.0, 1), (2, at(5, 15), "A", 12.0, 5), (4, at(6, 9), "A", 13.0, 2)]) == 0
    assert run([(5, at(8, 9), "B", 7.0, 1)]) == 0
    assert run([(6, at(9, 9), "B", 8.0, 1)]) == 0
    # days too late, twice
    assert run([(7, at(5, 16), "A", 99.0, 9), (8, at(6, 10), "A", 99.0, 9), (9, at(9, 10), "B", 9.0, 1)]) == 2
    got = {(r["code"], r["date"].day): (r["open"], r["close"], r["volume"]) for r in store.read().collect()}
    assert got == {("A", 5): (9.0, 12.0, 11), ("A", 6): (13.0, 13.0, 2), ("B", 8): (7.0, 7.0, 1), ("B", 9): (8.0, 9.0, 2)}
