import datetime as dt
import json

import pytest
from conftest import series

from updraft import ScreenConfig, published_screen
from updraft.config import options_from_flags
from updraft.operators import views

RISE = [(99.5, 101.0), (101.0, 103.0), (103.0, 106.0)]


@pytest.fixture
def published(spark, prices):
    rows = []
    for n in range(24):
        days = 3 if n % 2 else 2
        rows += series(f"{n:04d}", [20_000] * 12, [(o, c, 50_000 + 1_500 * n) for o, c in RISE[:days]])
    names = spark.createDataFrame(
        [("0001", "Alpha Works", "プライム"), ("0002", "beta", "東証グロース")],
        "code string, name string, market string",
    )
    return published_screen(prices(rows), names)


def test_counts_and_search(published):
    assert [tuple(r) for r in views.tier_counts(published).orderBy("tier").collect()] == [(1, 12), (2, 12)]
    assert views.tier_counts(published.filter("false")).count() == 2
    found = lambda q: sorted(r["code"] for r in views.search(published, q).collect())
    assert found(" ALPHA ") == ["0001"]
    assert found("^000[12]$") == ["0001", "0002"]
    assert len(found("  ")) == 24 and len(found("")) == 24


def test_view_orders(published):
    rows = views.sort_view(published, "最小倍率が高い順").collect()
    assert [r["min_ratio"] for r in rows] == sorted((r["min_ratio"] for r in rows), reverse=True)
    assert [r["rank"] for r in views.sort_view(published).collect()] == list(range(1, 25))
    streaks = views.sort_view(published, "streak_len").collect()
    assert [(-r["streak_len"], r["rank"]) for r in streaks] == sorted(
        (-r["streak_len"], r["rank"]) for r in streaks
    )
    with pytest.raises(ValueError):
        views.sort_view(published, "price")


def test_report_rows(published):
    rows = {r["code"]: r for r in views.report_rows(published, ScreenConfig()).collect()}
    alpha = rows["0001"]
    assert (alpha["market_class"], alpha["market_chip"]) == ("prime", "prime")
    assert rows["0002"]["market_class"] == "growth"
    assert (rows["0003"]["market_class"], rows["0003"]["market_chip"]) == ("", "growth")
    assert alpha["streak"] == "3日連騰" and alpha["streak_class"] == "top"
    assert alpha["streak_avg"] == "51,500" and alpha["close"] == "106"
    assert alpha["rise"] == "▲ 7.07%" and alpha["avg_times"] == "2.58x"
    assert "基準中央値 20,000株" in alpha["tip"]


def test_report_header_with_and_without_hits(published, prices):
    bars = prices(series("X", [1] * 3, []))
    cfg = ScreenConfig()
    head = views.report_header(published, bars, cfg, dt.date(2026, 1, 7)).first()
    assert (head["hits"], head["tier1"], head["tier2"], head["message"]) == (24, 12, 12, "")
    assert head["base_date"] == "2026-01-19" and head["stale_note"] == ""
    none = views.report_header(published.filter("false"), bars, cfg, dt.date(2026, 1, 9)).first()
    assert none["base_date"] == "N/A" and none["message"] and none["stale_note"]


def test_report_captions(published):
    cfg = ScreenConfig(metric="turnover")
    some, none = (views.report_captions(df, cfg).first() for df in (published, published.filter("false")))
    assert some["tier1_caption"].endswith(f"× {cfg.turnover_vol_mult}") and some["message"] == ""
    assert some["tier2_caption"] == none["tier2_caption"] and none["hits"] == 0 and none["message"]


def test_notifications(published):
    cfg = ScreenConfig()
    rows = views.notification_rows(published, cfg).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 21))
    assert rows[0]["title"].startswith("🥇 1位 ") and rows[3]["title"].startswith("🔹 4位 ")
    message = json.loads(views.notification_payload(published, cfg, "2026-01-19 20:00").first()[0])
    assert len(message["embeds"][0]["fields"]) == 20 and "24 件" in message["embeds"][0]["description"]
    assert [f["name"] for f in message["embeds"][0]["fields"]] == [r["title"] for r in rows]
    empty = json.loads(
        views.notification_payload(published.filter("false"), cfg, "now", "late").first()[0]
    )
    assert "embeds" not in empty and "⚠️ late" in empty["content"]


def test_flags():
    assert options_from_flags([]) == (ScreenConfig(), True)
    assert options_from_flags(["--no-fetch", "--turnover"]) == (ScreenConfig(metric="turnover"), False)
    assert options_from_flags(["--metric=turnover", "--metric=volume"])[0].metric == "volume"
