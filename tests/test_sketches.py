"""Sketched counts and ranks against exact ones."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from updraft.operators import sketches
from updraft.sinks.code_sketches import CodeSketches
from updraft.sinks.price_store import PriceStore

BARS = "code string, date date, open double, close double, volume bigint, seq long"


def bars(spark, rows):
    return spark.createDataFrame([(c, dt.date.fromisoformat(d), 1.0, 1.0, 1, 0) for c, d in rows], BARS)


@pytest.mark.parametrize("unit", ["month", "day"])
def test_ranges_from_stored_sketches(spark, tmp_path, unit):
    store = PriceStore(spark, str(tmp_path / "store"), unit)
    kept = CodeSketches(store, str(tmp_path / "codes"))
    empty = kept.between(dt.date(2026, 1, 1), dt.date(2026, 4, 1)).first()
    assert tuple(empty) == (None, None, 0, 0)
    first = bars(spark, [("A", "2026-01-10"), ("B", "2026-01-31"), ("A", "2026-02-03"), ("C", "2026-03-31")])
    store.upsert(first, 1, "seq")
    assert len(kept.refresh(first)) == (3 if unit == "month" else 4)
    second = bars(spark, [("D", "2026-02-28"), ("A", "2026-02-03")])
    store.upsert(second, 2, "seq")
    untouched = sorted((tmp_path / "codes" / ("period=2026-03-01" if unit == "month" else "period=2026-03-31")).glob("*.parquet"))
    kept.refresh(second)
    kept.refresh(second)
    assert sorted((tmp_path / "codes" / ("period=2026-03-01" if unit == "month" else "period=2026-03-31")).glob("*.parquet")) == untouched
    assert kept.refresh(second.limit(0)) == []
    day = dt.date.fromisoformat
    for since, before, rows, codes in (
        ("2026-01-01", "2026-04-01", 5, 4), ("2026-01-11", "2026-03-31", 3, 3), ("2026-02-01", "2026-03-01", 2, 2),
        ("2026-01-12", "2026-01-20", 0, 0), ("2026-02-02", "2026-02-04", 1, 1), ("2027-01-01", "2027-05-01", 0, 0),
    ):
        found = kept.between(day(since), day(before)).first()
        exact = store.read(day(since), day(before)).agg(F.min("date"), F.max("date")).first()
        assert tuple(found) == (*exact, rows, codes), (since, before)


def test_whole_periods_are_answered_without_the_bars(spark, tmp_path, monkeypatch):
    store = PriceStore(spark, str(tmp_path / "store"))
    kept = CodeSketches(store, str(tmp_path / "codes"))
    batch = bars(spark, [("A", "2026-01-10"), ("B", "2026-02-28")])
    store.upsert(batch, 1, "seq")
    kept.refresh(batch)
    monkeypatch.setattr(PriceStore, "read", lambda *a: pytest.fail("bars were read"))
    assert kept.between(dt.date(2026, 1, 1), dt.date(2026, 3, 1)).first()["codes"] == 2


def test_many_codes_are_within_the_stated_error(spark):
    prices = spark.range(200_000).select(
        (F.col("id") % 50_000).cast("string").alias("code"), F.expr("date_add(DATE '2026-01-01', CAST(id % 300 AS INT))").alias("date")
    )
    found = sketches.united(sketches.period_sketches(prices)).first()
    assert found["rows"] == 200_000
    assert abs(found["codes"] - 50_000) <= 50_000 * sketches.codes_error()


def test_sketched_ranks_with_a_hot_value(spark):
    ids = spark.range(60_000).select("id", (F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 7919 % 10_007 / 10).alias("v"))
    window = Window.partitionBy("g").orderBy("v")
    off = sketches.sketched_percent_ranks(ids, {"v": "est"}, ["g"]).withColumn("exact", F.percent_rank().over(window))
    assert off.columns == ["id", "g", "v", "est", "exact"]
    assert off.agg(F.max(F.abs(F.col("est") - F.col("exact")))).first()[0] <= 3 * sketches.rank_error()
    whole = sketches.sketched_percent_ranks(ids, {"v": "est"}).withColumn("exact", F.percent_rank().over(Window.orderBy("v")))
    assert whole.count() == 60_000
    assert whole.agg(F.max(F.abs(F.col("est") - F.col("exact")))).first()[0] <= 3 * sketches.rank_error()


def test_small_groups_are_ranked_exactly(spark):
    rows = [(None, 1.0), (None, 1.0), (None, 5.0), ("a", 3.0), ("b", 0.0), ("b", -0.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = sketches.sketched_percent_ranks(df, {"v": "r"}, ["g"])
    got = sorted((str(r["g"]), r["v"], round(r["r"], 9)) for r in found.collect())
    assert got == sorted([("None", 1.0, 0.0), ("None", 1.0, 0.0), ("None", 5.0, 1.0), ("a", 3.0, 0.0), ("b", 0.0, 0.0), ("b", -0.0, 0.0), ("b", 2.0, 1.0)])
    assert sketches.sketched_percent_ranks(df.limit(0), {"v": "r"}, ["g"]).count() == 0
