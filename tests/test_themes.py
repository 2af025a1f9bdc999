import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from updraft.operators import themes
from updraft.sinks.theme_reports import write_theme_reports
from updraft.sources.theme_reports import malformed_cells, read_theme_report, read_theme_reports, theme_report_dates
from updraft.streaming import reports as reports_stream
from updraft.streaming.reports import read_stored_reports

HEADER = (
    "rank,theme,status,ignition,stage,confidence,participants,eligible_members,"
    "participation_rate,concentration,turnover_anomaly,mkt_rel_z,breadth_z,floor_pass,"
    "small_universe,top_contributors,registered_since,last_ignition"
)
DAY_ONE = [
    "1,AI,監視中,再点火,S2継続,2.0,5.0,8,0.625,0.25,1.2,-0.4,0.005,True,,A社,2026-05-01,",
    "2,Chips,初動,,S1点火,1.0,3.0,9,0.333,0.5,0.1,0.2,0.3,False,True,,,",
    "3,Ships,失速,,,-1.0,,4,0.25,1.0,0.0,0.0,0.0,,,,,2026-04-01",
    "4,Bank,,,,0.0,1.0,4,0.25,1.0,0.0,0.0,0.0,,,,,",
]
DAY_TWO = ["1,AI,監視中,,,3.0,5,8,0.6,0.2,1,1,1,True,,,,", "2,New,,,,0.5,5,8,0.6,0.2,1,1,1,True,,,,"]


@pytest.fixture
def folder(tmp_path):
    for date, lines in (("2026-06-23", DAY_ONE), ("2026-06-24", DAY_TWO)):
        text = "﻿" + "\n".join([HEADER, *lines]) + "\n"
        (tmp_path / f"daily_report_{date}.csv").write_text(text, encoding="utf-8")
    (tmp_path / "daily_report_2026-06-24.html").write_text("<html>")
    (tmp_path / "notes.csv").write_text("a\n1\n")
    return str(tmp_path)


def test_reports_are_dated_by_file_name(spark, folder):
    reports = read_theme_reports(spark, folder)
    assert [r[0] for r in themes.report_dates(reports).collect()] == ["2026-06-24", "2026-06-23"]
    assert themes.report_of(reports).count() == 2
    assert themes.report_of(reports, "2026-06-23").count() == 4
    one = read_theme_report(spark, folder, "2026-06-23")
    assert len(one.inputFiles()) == 1 and one.count() == 4
    first = one.orderBy("rank").first()
    assert (first["rank"], first["participants"], first["floor_pass"]) == (1, 5, True)
    assert [f.name for f in themes.REPORT_SCHEMA] == one.columns[:-1]


def test_no_reports(spark, tmp_path):
    empty = read_theme_reports(spark, str(tmp_path))
    assert empty.count() == 0 and "report_date" in empty.columns
    assert themes.theme_history(empty).columns == ["date", "theme", "confidence"]


def test_missing_folder(spark, tmp_path):
    nowhere = str(tmp_path / "none")
    assert read_theme_reports(spark, nowhere).count() == theme_report_dates(spark, nowhere).count() == 0


def test_headers_may_differ_and_cells_may_be_missing(spark, folder, tmp_path):
    (tmp_path / "daily_report_2026-06-25.csv").write_text("theme,rank,confidence\nAI,1.0,2.5\nNew,NaN,NaN\n")
    (tmp_path / "daily_report_2026-06-26.csv").write_text(HEADER + "\n")
    reports = read_theme_reports(spark, folder)
    assert reports.count() == 8 and len(reports.columns) == len(themes.REPORT_SCHEMA) + 1
    last = {r["theme"]: r for r in themes.report_of(reports).collect()}
    assert (last["AI"]["rank"], last["AI"]["confidence"], last["AI"]["status"]) == (1, 2.5, None)
    assert last["New"]["rank"] is None and last["New"]["confidence"] is None
    # A report without rows is listed all the same.
    assert [r[0] for r in theme_report_dates(spark, folder).collect()] == [f"2026-06-{d}" for d in (26, 25, 24, 23)]


def test_reports_are_written_as_dated_files(spark, folder, tmp_path):
    reports = read_theme_reports(spark, folder)
    out = tmp_path / "out"
    write_theme_reports(reports, str(out))
    write_theme_reports(reports.filter("report_date = '2026-06-24' and rank = 1"), str(out))
    assert sorted(p.name for p in out.glob("[!._]*")) == [f"daily_report_2026-06-{d}.csv" for d in (23, 24)]
    back = {(r["report_date"], r["rank"]): r for r in read_theme_reports(spark, str(out)).collect()}
    assert back == {(r["report_date"], r["rank"]): r for r in reports.collect() if (r["report_date"], r["rank"]) != ("2026-06-24", 2)}


def test_written_reports_are_whole_where_files_are_limited(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("limited"))
    reports = read_theme_reports(spark, folder)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    try:
        write_theme_reports(reports, out)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert read_theme_reports(spark, out).count() == reports.count() == 6


def test_malformed_cells_are_counted(spark, tmp_path):
    header = "rank,theme,confidence,participants,floor_pass\n"
    (tmp_path / "daily_report_2026-06-24.csv").write_text(header + "1,a,0.5,x7,True\nfirst,b,,3.0,maybe\n2,c,high,x3,False\n")
    (tmp_path / "daily_report_2026-06-25.csv").write_text("rank,theme\n1,a\n")
    (tmp_path / "daily_report_2026-06-26.csv").write_text("theme\na\n")
    found = sorted(map(tuple, malformed_cells(spark, str(tmp_path)).collect()))
    day = "2026-06-24"
    assert found == [(day, "confidence", 1, "high"), (day, "floor_pass", 1, "maybe"), (day, "participants", 2, "x3"), (day, "rank", 1, "first")]
    assert malformed_cells(spark, str(tmp_path / "none")).count() == 0


def test_stored_reports_open_new_files_only(spark, folder, tmp_path_factory, monkeypatch):
    source, base, seen = tmp_path_factory.mktemp("arriving"), tmp_path_factory.mktemp("stored"), []
    table, checkpoint = str(base / "table"), str(base / "checkpoint")
    assert read_stored_reports(spark, table).count() == 0
    read = reports_stream.read_listed
    monkeypatch.setattr(reports_stream, "read_listed", lambda session, listing: (seen.append(sorted(r["path"][-14:-4] for r in listing.select("path").collect())), read(session, listing))[1])
    names = sorted(p for p in Path(folder).glob("daily_report_*.csv"))
    for name in names:
        (source / name.name).write_bytes(name.read_bytes())
        assert reports_stream.ingest_reports(spark, str(source), table, checkpoint).awaitTermination(120)
    assert reports_stream.ingest_reports(spark, str(source), table, checkpoint).awaitTermination(120)
    assert seen == [[n.name[-14:-4]] for n in names]
    stored, all_read = read_stored_reports(spark, table), read_theme_reports(spark, str(folder))
    assert stored.schema.names == all_read.schema.names
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, all_read.collect()))


def test_reports_scale_by_themselves(spark, folder):
    rows = {(r["report_date"], r["theme"]): r["width"] for r in themes.theme_rows(read_theme_reports(spark, folder)).collect()}
    assert rows["2026-06-24", "AI"] == rows["2026-06-23", "AI"] == "100%" and rows["2026-06-24", "New"] == "0%"
    odd = spark.createDataFrame([("a", float("nan")), ("b", 2.0), ("c", 4.0)], "theme string, confidence double")
    assert {r["theme"]: r["width"] for r in themes.with_confidence_width(odd).collect() if r["theme"] != "a"} == {"b": 0.0, "c": 100.0}


def test_history_reads_two_columns(spark, folder):
    history = themes.theme_history(read_theme_reports(spark, folder))
    assert history.count() == 6
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<theme:string,confidence:string>" in plan


def test_cards(spark, folder):
    cards = themes.theme_cards(read_theme_report(spark, folder, "2026-06-23")).first()
    assert tuple(cards) == (2, 1, 1, 1, 4)


def test_filters(spark, folder):
    report = read_theme_report(spark, folder, "2026-06-23")
    names = lambda df: sorted(r["theme"] for r in df.collect())
    assert names(themes.filter_themes(report)) == ["AI", "Bank", "Chips", "Ships"]
    assert names(themes.filter_themes(report, "失速")) == ["Ships"]
    assert names(themes.filter_themes(report, floor_only=True)) == ["AI"]


def test_rows(spark, folder):
    rows = {r["theme"]: r for r in themes.theme_rows(read_theme_report(spark, folder, "2026-06-23")).collect()}
    ai, chips, ships, bank = (rows[t] for t in ("AI", "Chips", "Ships", "Bank"))
    assert [r["status"] for r in (ai, chips, ships, bank)] == ["⚡ 再点火", "⚡ 初動", "失速", "圏外"]
    assert [r["stage"] for r in (ai, chips, ships)] == ["S2継続", "S1点火", "—"]
    assert [r["width"] for r in (ai, chips, ships)] == ["100%", "67%", "0%"]
    assert ai["confidence"] == "+2.00" and ships["confidence"] == "-1.00" and ships["negative"]
    assert ai["participation"] == "5/8社" and ai["breadth_z"] == "+0.01" and ai["mkt_rel_z"] == "-0.40"
    assert ai["floor"] == "✓" and chips["floor"] == "—" and ships["floor"] == "—"
    assert chips["warning"] and not ai["warning"]
    assert ai["tip"] == "参加率 62.5% / 集中度 0.25 / 初動登録 2026-05-01 / 直近点火 —"


def test_equal_confidences_scale_to_zero(spark):
    flat = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "theme string, confidence double")
    assert {r["width"] for r in themes.with_confidence_width(flat).collect()} == {0.0}


def test_default_themes_and_pivot(spark, folder):
    reports = read_theme_reports(spark, folder)
    history = themes.theme_history(reports)
    old = history.filter("date = '2026-06-23'")
    picks = [r["theme"] for r in themes.top_themes(themes.report_of(reports), old).collect()]
    assert picks == ["AI"]  # New has no history
    doubled = history.unionByName(
        history.filter("date = '2026-06-23'").withColumn("confidence", F.col("confidence") + 1)
    )
    pivot = {r["date"]: r for r in themes.pivot_history(doubled, ["AI", "Ships"]).collect()}
    assert pivot["2026-06-23"]["AI"] == 2.5 and pivot["2026-06-24"]["Ships"] is None
    assert themes.history_days(history).first()[0] == 2


def test_staleness(spark, folder):
    reports = read_theme_reports(spark, folder)
    at = lambda now: themes.report_staleness(reports, now).first()["is_stale"]
    assert at(dt.datetime(2026, 6, 25, 20, 0)) is False
    assert at(dt.datetime(2026, 6, 25, 21, 0)) is True


def test_page_notes_of_newest_old_and_filtered_reports(spark):
    days = [("2026-06-23", "A", True), ("2026-06-24", "A", True), ("2026-06-24", "B", None)]
    reports = spark.createDataFrame(days, "report_date string, theme string, floor_pass boolean")

    def notes(date, now, floor_only=False):
        report = themes.report_of(reports, date)
        return themes.page_notes(report, themes.filter_themes(report, floor_only=floor_only), reports, now).first()

    late, due = dt.datetime(2026, 6, 24, 22, 0), dt.datetime(2026, 6, 25, 22, 0)
    assert notes(None, late)[:] == ("2026-06-24", 2, 2, "", "", "", "theme_flow_2026-06-24.csv")
    stale = notes(None, due, floor_only=True)
    assert "2026-06-24 時点" in stale["stale_note"] and "2026-06-25 分" in stale["stale_note"]
    assert stale["shown_note"] == "絞り込み: 1 / 2 テーマ" and stale["message"] == ""
    assert notes("2026-06-23", due)["stale_note"] == ""
    report = themes.report_of(reports)
    assert themes.page_notes(report, report.limit(0), reports, late).first()["message"]
    none = themes.page_notes(report.limit(0), report.limit(0), reports.limit(0), late).first()
    assert none["report_date"] is None and none["file_name"] is None and none["stale_note"] == ""
