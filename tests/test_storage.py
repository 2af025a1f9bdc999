"""Price store, streaming ingest, results and the ledger on disk."""

import datetime as dt

import pytest
from conftest import by_code, series
from pyspark.sql import functions as F

from updraft import ScreenConfig, published_screen, screen
from updraft.operators.ingest import drop_incomplete
from updraft.operators.universe import PUBLISHED_COLUMNS
from updraft.sinks import ledger, price_store, results
from updraft.sinks.price_store import PriceStore
from updraft.sources.prices import PRICE_COLUMNS, read_prices, save_bucketed
from updraft.sources.universe import read_universe
from updraft.streaming.ingest import ingest_stream

BATCH = "code string, date date, open double, close double, volume bigint, seq long"
RISE = [(99.5, 101.0, 60_000), (101.0, 103.0, 60_000), (103.0, 106.0, 60_000)]


def bar(code, date, value, seq=0):
    return (code, dt.date.fromisoformat(date), float(value), float(value), value, seq)


def content(store):
    return sorted((r["code"], str(r["date"]), r["volume"]) for r in store.read().collect())


def test_store_upserts_by_month(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path))
    assert content(store) == []
    first = spark.createDataFrame(
        [bar("A", "2026-01-30", 1), bar("A", "2026-02-02", 2), bar("A", "2026-02-02", 3, 1)], BATCH
    )
    assert store.upsert(first, 1, "seq") == [dt.date(2026, 1, 1), dt.date(2026, 2, 1)]
    kept = [("A", "2026-01-30", 1), ("A", "2026-02-02", 3)]
    assert content(store) == kept
    january = sorted((tmp_path / "prices" / "period=2026-01-01").glob("*.parquet"))

    second = spark.createDataFrame([bar("A", "2026-02-02", 7), bar("B", "2026-02-03", 8)], BATCH)
    assert store.upsert(second, 2, "seq") == [dt.date(2026, 2, 1)]
    final = [("A", "2026-01-30", 1), ("A", "2026-02-02", 7), ("B", "2026-02-03", 8)]
    assert content(store) == final
    # untouched months keep their files
    assert sorted((tmp_path / "prices" / "period=2026-01-01").glob("*.parquet")) == january

    # an old batch arriving again changes nothing
    assert store.upsert(first, 1, "seq") == []
    assert content(store) == final
    assert store.upsert(first.filter("false"), 3, "seq") == []


def test_interrupted_swap_is_finished_first(spark, tmp_path, monkeypatch):
    store = PriceStore(spark, str(tmp_path))
    store.upsert(spark.createDataFrame([bar("A", "2026-02-02", 1)], BATCH), 1, "seq")

    monkeypatch.setattr(PriceStore, "_apply", lambda self, batch: (_ for _ in ()).throw(OSError()))
    with pytest.raises(OSError):
        store.upsert(spark.createDataFrame([bar("A", "2026-02-02", 2)], BATCH), 2, "seq")
    monkeypatch.undo()
    assert content(store) == [("A", "2026-02-02", 1)]

    store.upsert(spark.createDataFrame([bar("B", "2026-02-02", 3)], BATCH), 3, "seq")
    assert content(store) == [("A", "2026-02-02", 2), ("B", "2026-02-02", 3)]


def test_recent_reads_prune_months(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path))
    rows = [bar("A", f"2026-0{m}-15", m) for m in range(1, 7)]
    store.upsert(spark.createDataFrame(rows, BATCH), 1, "seq")
    recent = read_prices(spark, store.prices_path, dt.date(2026, 5, 10))
    assert recent.columns == PRICE_COLUMNS and recent.count() == 2
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "PushedFilters: [IsNotNull(date)" in plan


def test_daily_periods_touch_only_their_days(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path), unit="day")
    store.upsert(spark.createDataFrame([bar("A", f"2026-02-0{d}", d) for d in (1, 2, 3)], BATCH), 1, "seq")
    batch = spark.createDataFrame([bar("A", "2026-02-02", 20), bar("B", "2026-02-02", 21)], BATCH)
    assert store.upsert(batch, 2, "seq") == [dt.date(2026, 2, 2)]
    assert [v for _, _, v in content(store)] == [1, 20, 3, 21]
    assert sorted(r["volume"] for r in store.read(since=dt.date(2026, 2, 2)).collect()) == [3, 20, 21]
    assert [r["volume"] for r in store.read(before=dt.date(2026, 2, 2)).collect()] == [1]
    with pytest.raises(ValueError):
        PriceStore(spark, str(tmp_path / "x"), unit="hour").upsert(batch, 1, "seq")


def test_stream_of_quotes_ends_in_the_store(spark, tmp_path):
    landing, store = tmp_path / "landing", PriceStore(spark, str(tmp_path / "store"))
    schema = "code string, date date, open double, close double, volume double, seq long"
    seen = []

    def run():
        quotes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(landing))
        query = ingest_stream(
            quotes, store, "seq", str(tmp_path / "checkpoint"),
            dt.datetime(2026, 2, 4, 10, 0), on_batch=seen.append,
        )
        assert query.awaitTermination(120)

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(landing))

    day = dt.date(2026, 2, 3)
    land(("A", day, 1.0, 1.0, 1.9, 0), ("A", day, 1.0, None, 5.0, 1), ("A", dt.date(2026, 2, 4), 1.0, 1.0, 9.0, 2))
    run()
    assert content(store) == [("A", "2026-02-03", 1)]
    land(("A", day, 2.0, 2.0, 6.0, 0), ("B", day, 2.0, 2.0, 7.0, 1))  # late correction
    run()
    assert content(store) == [("A", "2026-02-03", 6), ("B", "2026-02-03", 7)]
    assert seen == [[dt.date(2026, 2, 1)], [dt.date(2026, 2, 1)]]
    # batches are named by query, so another stream's batch 0 is not mistaken for this one's
    names = {r["batch"] for r in spark.read.parquet(store.log_path).collect()}
    assert len(names) == 2 and not any(n.startswith("None") for n in names)


def test_log_is_compacted_to_the_last_state_of_each_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(price_store, "LOG_FILES", 4)
    store = PriceStore(spark, str(tmp_path / "a b"))
    batches = [spark.createDataFrame([bar("A", "2026-02-02", n)], BATCH) for n in range(5)]
    for n in range(3):
        store.upsert(batches[n], n, "seq")
        assert len(list((tmp_path / "a b" / "log").glob("*.parquet"))) <= 4
    assert store.version() == 3
    # a compaction that dies before the old files go changes nothing
    with monkeypatch.context() as m:
        m.setattr(PriceStore, "_delete", lambda self, files: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            store.upsert(batches[3], 3, "seq")
    assert store.version() == 4 and content(store) == [("A", "2026-02-02", 3)]
    assert all(store.upsert(batches[n], n, "seq") == [] for n in range(4))
    store.upsert(batches[4], 4, "seq")
    assert len(list((tmp_path / "a b" / "log").glob("*.parquet"))) == 1
    assert store.version() == 5 and content(store) == [("A", "2026-02-02", 4)]
    rows = sorted(map(tuple, spark.read.parquet(store.log_path).collect()))
    assert rows == [(str(n), "applied") for n in range(5)]


def test_csv_results(spark, prices, tmp_path):
    names = spark.createDataFrame([("AAAA", "Alpha", "プライム")], "code string, name string, market string")
    published = published_screen(prices(series("AAAA", [20_000] * 15, RISE)), names)
    cfg = ScreenConfig()
    assert results.result_name(cfg) == "screen_result.csv"
    assert results.result_name(ScreenConfig(metric="turnover")) == "screen_result_turnover.csv"
    name = results.result_name(cfg, dt.date(2026, 1, 22))
    assert name == "screen_result_volume_2026-01-22.csv"
    path = tmp_path / name
    results.write_csv(published, str(path))
    text = next(p for p in path.glob("part-*") if p.stat().st_size).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfrank,code,name,market,")
    back = spark.read.csv(str(path), header=True)
    assert tuple(back.columns) == PUBLISHED_COLUMNS and back.first()["name"] == "Alpha"

    table = str(tmp_path / "results")
    for _ in range(2):
        results.write_parquet(published, table, cfg, dt.date(2026, 1, 22))
    stored = spark.read.parquet(table)
    assert stored.count() == 1 and stored.first()["metric"] == "volume"
    # The next night, with an older last date still in: the first night's rows stay.
    results.write_parquet(published, table, cfg, dt.date(2026, 1, 23))
    assert spark.read.parquet(table).count() == 2
    results.write_parquet(published.limit(0), table, cfg, dt.date(2026, 1, 23))
    assert [r["data_date"] for r in spark.read.parquet(table).collect()] == [dt.date(2026, 1, 22)]


def test_quotes_in_csv_both_ways(spark, tmp_path):
    import csv

    name = 'He said "x", ok'
    (tmp_path / "u.csv").write_text(f'code,name,market\n0001,"{name.replace(chr(34), chr(34) * 2)}",m\n', encoding="utf-8")
    universe = read_universe(spark, str(tmp_path / "u.csv"))
    assert universe.first()["name"] == name and universe.first()["market"] == "m"
    row = {c: F.lit(1).alias(c) for c in PUBLISHED_COLUMNS} | {"name": F.lit(name).alias("name")}
    results.write_csv(spark.range(1).select(*row.values()), str(tmp_path / "out"))
    rows = [r for p in (tmp_path / "out").glob("part-*") for r in csv.reader(p.read_text("utf-8-sig").splitlines())]
    assert any(name in r for r in rows)


def test_rows_without_keys_and_other_faults(spark, prices, tmp_path):
    from pyspark.errors import AnalysisException

    store = PriceStore(spark, str(tmp_path / "s"))
    rows = series("AAAA", [20_000] * 3, [])
    quotes = prices([*rows, ("BBBB", None, 1.0, 1.0, 1), (None, rows[0][1], 1.0, 1.0, 1)])
    assert drop_incomplete(quotes).count() == 3
    store.upsert(drop_incomplete(quotes), 1, "volume")
    with pytest.raises(AnalysisException):
        store.upsert(prices(rows), 2, "no_such_column")
    assert store.read().count() == 3


def test_result_reuse(spark, prices, tmp_path):
    store = results.ResultStore(spark, str(tmp_path))
    calls = []

    def compute(rows):
        def run():
            calls.append(1)
            return screen(prices(rows))
        return run

    day = dt.date(2026, 1, 22)
    rows = series("AAAA", [20_000] * 15, RISE)
    cfg = ScreenConfig()
    assert store.get_or_compute(cfg, day, compute(rows)).count() == 1
    assert store.get_or_compute(cfg, day, compute([])).count() == 1 and len(calls) == 1
    assert store.get_or_compute(cfg, day, compute([]), version=1).count() == 0
    assert store.get_or_compute(cfg, day, compute(rows), version=1).count() == 0
    assert store.get_or_compute(ScreenConfig(base_window=5), day, compute(rows)).count() == 1
    assert len(calls) == 3


def test_ledger_sends_once_per_metric(spark, tmp_path):
    path = str(tmp_path / "ledger")
    today = spark.createDataFrame(
        [("volume", dt.date(2026, 1, 22)), ("turnover", dt.date(2026, 1, 22))], "metric string, data_date date"
    )
    pending = ledger.pending(today, ledger.read_ledger(spark, path))
    assert pending.count() == 2
    ledger.record_sent(today.filter("metric = 'volume'"), path, dt.datetime(2026, 1, 22, 20, 0))
    sent = ledger.read_ledger(spark, path)
    assert [r["metric"] for r in ledger.pending(today, sent).collect()] == ["turnover"]
    assert ledger.pending(today, sent, force=True).count() == 2
    newer = today.withColumn("data_date", F.date_add("data_date", 1))
    assert ledger.pending(newer, sent).count() == 2
    unknown = today.withColumn("data_date", F.lit(None).cast("date"))
    assert ledger.pending(unknown, sent).count() == 2


def test_bucketed_tables_screen_without_shuffling_bars(spark, prices):
    rows = series("AAAA", [20_000] * 15, RISE) + series("DOWN", [20_000] * 15, [])
    save_bucketed(prices(rows), "bucketed_prices", 4)
    try:
        from updraft.operators.streaks import streak_metrics

        table = spark.table("bucketed_prices")
        metrics = streak_metrics(table, ScreenConfig())
        assert "Exchange" not in metrics._jdf.queryExecution().executedPlan().toString()
        assert set(by_code(screen(table))) == {"AAAA"}
    finally:
        spark.sql("DROP TABLE bucketed_prices")
