"""Whole runs: nightly, interactive view, theme page."""

import datetime as dt
import json

from conftest import series

from updraft import ScreenConfig
from updraft.__main__ import main
from updraft.plans.nightly import run_nightly
from updraft.plans.pages import screener_view, theme_page
from updraft.plans.inputs import theme_reports
from updraft.sinks.price_store import PriceStore
from updraft.sinks.results import ResultStore

RISE = [(99.5, 101.0, 60_000), (101.0, 103.0, 60_000), (103.0, 106.0, 60_000)]
QUOTES = "code string, date date, open double, close double, volume bigint, seq long"
LAST = dt.date(2026, 1, 22)


def quotes(spark, rows):
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], QUOTES)


def names(spark):
    return spark.createDataFrame(
        [("AAAA", "Alpha", "プライム")], "code string, name string, market string"
    )


def test_nightly_run_sends_once_per_metric(spark, tmp_path):
    store, out = PriceStore(spark, str(tmp_path / "db")), str(tmp_path / "out")
    rows = series("AAAA", [20_000] * 15, RISE) + series("ZZZZ", [20_000] * 15, RISE)
    sent = []

    def send(text):
        sent.append(json.loads(text))
        return len(sent) != 1  # the first delivery fails

    def run(now, cfg=None, **kw):
        return run_nightly(store, names(spark), out, now, cfg, send=send, **kw)

    evening = dt.datetime(2026, 1, 22, 20, 0)
    first = run(evening, quotes=quotes(spark, rows), batch_id="b1")
    assert first.latest == LAST and first.is_current and not first.notified
    published = {r["code"]: r for r in first.published.collect()}
    assert published["AAAA"]["name"] == "Alpha" and published["ZZZZ"]["name"] is None
    assert first.report.count() == 2

    assert run(evening).notified  # retried after the failure
    assert not run(evening).notified  # sent before
    assert run(evening, ScreenConfig(metric="turnover")).notified
    assert run(evening, force=True).notified
    assert len(sent) == 4 and len(sent[1]["embeds"][0]["fields"]) == 2

    late = run(dt.datetime(2026, 1, 23, 20, 0), lookback_days=7)
    assert late.published.drop("name").exceptAll(first.published.drop("name")).count() == 0
    assert late.published.count() == 2
    assert not late.is_current and "2026-01-23" in late.header.first()["stale_note"]
    csv = spark.read.csv(f"{out}/screen_result.csv", header=True)
    assert csv.count() == 2
    assert spark.read.parquet(f"{out}/results").count() == 4  # two metrics, one date


def test_morning_run_ignores_the_open_day(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "db"))
    rows = series("AAAA", [20_000] * 15, RISE)
    run = run_nightly(
        store, names(spark), str(tmp_path / "out"), dt.datetime(2026, 1, 22, 15, 0),
        quotes=quotes(spark, rows),
    )
    assert run.latest == LAST - dt.timedelta(days=1) and not run.is_current
    assert run.header.first()["hits"] == 1 and run.published.first()["streak_len"] == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("updraft.__main__.build_session", lambda: spark)
    quotes(spark, series("AAAA", [20_000] * 15, RISE)).write.parquet(str(tmp_path / "quotes"))
    (tmp_path / "u.csv").write_text("code,name\nAAAA,Alpha\n")
    main([
        "--store", str(tmp_path / "db"), "--universe", str(tmp_path / "u.csv"),
        "--out", str(tmp_path / "out"), "--quotes", str(tmp_path / "quotes"),
        "--now", "2026-01-22T20:00", "--metric=turnover",
    ])
    assert "1 hits (tier 1: 1, tier 2: 0)" in capsys.readouterr().out
    assert (tmp_path / "out" / "screen_result_turnover.csv").exists()


def test_interactive_view(spark, prices, tmp_path):
    rows = prices(series("AAAA", [20_000] * 15, RISE) + series("ZZZZ", [20_000] * 15, RISE))
    reuse = ResultStore(spark, str(tmp_path))
    cfg = ScreenConfig.interactive(base_window=12)
    view = screener_view(rows, names(spark), cfg, "alp", "上昇率が高い順", reuse)
    assert [r["code"] for r in view.collect()] == ["AAAA"]
    again = screener_view(rows, names(spark), cfg, reuse=reuse)
    assert [(r["code"], r["name"]) for r in again.collect()] == [("AAAA", "Alpha"), ("ZZZZ", "ZZZZ")]
    assert reuse.get(cfg, LAST) is not None


def test_a_load_ends_the_reuse_of_results(spark, tmp_path):
    store, reuse = PriceStore(spark, str(tmp_path / "db")), ResultStore(spark, str(tmp_path / "kept"))
    rows = series("AAAA", [20_000] * 15, RISE)
    cfg = ScreenConfig()
    hits = lambda: screener_view(store, names(spark), cfg, reuse=reuse).count()
    assert store.version() == 0
    store.upsert(quotes(spark, rows), "one", "seq")
    assert hits() == 1 and store.version() == 1
    code, day, open_, _, volume = rows[-1]
    store.upsert(quotes(spark, [(code, day, open_, 1.0, volume)]), "two", "seq")
    assert hits() == 0 and store.version() == 2


def test_equal_configs_have_one_digest():
    assert ScreenConfig(min_volume=10_000).digest == ScreenConfig(min_volume=10_000.0).digest
    assert ScreenConfig(min_volume=10_001).digest != ScreenConfig().digest


def test_theme_page(spark):
    reports = theme_reports(spark, "/root/testdata/sf0.001")
    page = theme_page(reports, dt.datetime(2024, 2, 1, 20, 0))
    assert page.dates.first()["report_date"] == "2024-01-30"
    assert page.cards.first()["themes"] == page.rows.count() == 5
    assert page.history.count() == page.history_days.first()["days"] == 30
    assert len(page.history.columns) == 6
    assert page.staleness.first()["is_stale"] is True
    old = theme_page(reports, dt.datetime(2024, 2, 1, 20, 0), "2024-01-03", status="失速", picked=["view"])
    assert old.history.columns == ["date", "view"]
    assert {r["status"] for r in old.rows.collect()} <= {"失速", "⚡ 再点火"}
