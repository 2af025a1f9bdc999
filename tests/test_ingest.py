import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from updraft.operators import ingest, universe
from updraft.operators.upsert import latest_rows, merge_batch, touched_periods
from updraft.sources.universe import read_listing, read_universe

TODAY = dt.date(2026, 6, 24)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_wide_frames_of_many_tickers(spark):
    fields = [f"{n}'.T|{field}" for n in range(1000) for field in ingest.QUOTE_FIELDS]
    wide = spark.range(2).select(F.lit("2026-01-05").cast("date").alias("Date"), *[F.lit(float(n)).alias(c) for n, c in enumerate(fields)])
    start = time.perf_counter()
    long = ingest.wide_to_long(wide)
    assert long.columns == ["code", "date", "open", "close", "volume"]
    assert time.perf_counter() - start < 8
    last = long.filter("code = \"999'\"").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in last] == [(2997.0, 2998.0, 2999.0)] * 2


def test_wide_frames_become_long(spark):
    wide = spark.createDataFrame(
        [(TODAY, 1.0, 2.0, 30.9, 4.0, None, 60.0, 7.0)],
        "Date date, `7203.T|Open` double, `7203.T|Close` double, `7203.T|Volume` double, "
        "`141A.T|Open` double, `141A.T|Close` double, `141A.T|Volume` double, `9999.T|Open` double",
    )
    long = ingest.wide_to_long(wide)
    assert rows_of(long, "code") == [("141A",), ("7203",)]  # 9999 lacks fields
    bars = ingest.clean_quotes(long, dt.datetime(2026, 6, 24, 20, 0))
    assert rows_of(bars, "code", "date", "open", "close", "volume") == [("7203", TODAY, 1.0, 2.0, 30)]
    assert dict(bars.dtypes)["volume"] == "bigint"


def test_flat_single_ticker_frame(spark):
    flat = spark.createDataFrame(
        [(TODAY, 1.0, 2.0, 3.0)], "Date date, Open double, Close double, Volume double"
    )
    assert rows_of(ingest.wide_to_long(flat, single_ticker="7203.T"), "code", "close") == [("7203", 2.0)]
    with pytest.raises(ValueError):
        ingest.wide_to_long(flat)


@pytest.mark.parametrize("hour,minute,kept", [(15, 59, 1), (16, 0, 2)])
def test_unfinished_bars_are_left_out(spark, hour, minute, kept):
    quotes = spark.createDataFrame(
        [("A", TODAY, 1.0, 1.0, 1.0), ("A", TODAY - dt.timedelta(days=1), 1.0, 1.0, 1.0),
         ("A", TODAY - dt.timedelta(days=2), 1.0, float("nan"), 1.0),
         ("A", TODAY - dt.timedelta(days=3), None, 1.0, 1.0)],
        "code string, date date, open double, close double, volume double",
    )
    now = dt.datetime(2026, 6, 24, hour, minute)
    assert ingest.clean_quotes(quotes, now).count() == kept


def test_later_rows_win_and_upserts_repeat(spark, prices):
    day = dt.date(2026, 3, 31)
    stored = prices([("A", day, 1.0, 1.0, 1), ("B", day, 2.0, 2.0, 2)])
    batch = spark.createDataFrame(
        [("A", day, 9.0, 9.0, 9, 1), ("A", day, 5.0, 5.0, 5, 2), ("C", day, 3.0, 3.0, 3, 0)],
        "code string, date date, open double, close double, volume bigint, seq long",
    )
    once = merge_batch(stored, batch, "seq")
    assert rows_of(once, "code", "volume") == [("A", 5), ("B", 2), ("C", 3)]
    twice = merge_batch(once, batch, "seq")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert rows_of(touched_periods(batch), "period", "rows") == [(dt.date(2026, 3, 1), 3)]


def test_copies_of_a_hot_key_collapse_before_the_shuffle(spark):
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("code"),
        F.lit(TODAY).alias("date"), F.col("id").alias("seq"),
    )
    kept = latest_rows(rows, ["code", "date"], [F.col("seq")])
    assert kept.filter("code = 'hot'").first()["seq"] == 8_997
    assert kept.count() == 6_001
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.count("Exchange hashpartitioning") == 1


def test_universe_csv(spark, tmp_path):
    path = tmp_path / "tickers.csv"
    path.write_text(
        "﻿Code,name,market\n141A, First ,グロース\n0012,　Zero　,プライム\n141A,Last,NA\n,Nobody,x\n",
        encoding="utf-8",
    )
    got = rows_of(read_universe(spark, str(path)), "code", "name", "market")
    assert got == [("0012", "Zero", "プライム"), ("141A", "Last", None)]


@pytest.mark.parametrize(
    "header,expected",
    [
        ("銘柄コード,会社名", ("7203", "7203", "")),  # a code column may double as the name
        ("コード", ("7203", "7203", "")),
        ("stock_code,Full_Name,市場区分", ("7203", "Toyo", "P")),
    ],
)
def test_universe_columns_are_found_by_name(spark, tmp_path, header, expected):
    cells = ["7203", "Toyo", "P"][: header.count(",") + 1]
    path = tmp_path / "u.csv"
    path.write_text(header + "\n" + ",".join(cells) + "\n", encoding="utf-8")
    assert rows_of(read_universe(spark, str(path)), "code", "name", "market") == [expected]


def test_universe_needs_a_code_column(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("name\nx\n", encoding="utf-8")
    with pytest.raises(ValueError):
        read_universe(spark, str(path))


def test_exchange_listing(spark, tmp_path):
    path = tmp_path / "listing.csv"
    path.write_text(
        "日付,コード,銘柄名,市場・商品区分\n"
        "1,1301, 極洋 ,プライム（内国株式）\n1,1305,投信,ETF・ETN\n1,141A,新興,グロース(内国株式)\n"
        "1,9999,外国,プライム（外国株式）\n",
        encoding="utf-8",
    )
    assert rows_of(read_listing(spark, str(path)), "code", "name", "market") == [
        ("1301", "極洋", "プライム"), ("141A", "新興", "グロース"),
    ]


def test_lookup_of_missing_codes(spark):
    hits = spark.createDataFrame([("A",), ("B",), ("C",)], "code string")
    names = spark.createDataFrame(
        [("A", "Alpha", None), ("B", None, "M")], "code string, name string, market string"
    )
    assert rows_of(universe.enrich(hits, names), "code", "name", "market") == [
        ("A", "Alpha", ""), ("B", "B", "M"), ("C", "C", ""),
    ]
    plain = universe.enrich(hits, names, name_fallback=False)
    assert [r["name"] for r in plain.orderBy("code").collect()] == ["Alpha", None, None]
