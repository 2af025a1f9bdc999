"""Adjustment bases of loads, and the streak state that batches refresh."""

import datetime as dt
import random

from pyspark.sql import functions as F

from updraft import ScreenConfig, screen
from updraft.operators.adjustment import LOAD_SCHEMA, adjusted_bars, overlap_factors, reaching
from updraft.operators.upsert import merge_batch
from updraft.sinks.load_log import LoadLog, read_adjusted, upsert_rebased
from updraft.sinks.price_store import PriceStore
from updraft.sinks.streak_state import StreakState
from updraft.sources.prices import PRICE_SCHEMA

DAY = dt.date(2026, 1, 5)


def day(n):
    return DAY + dt.timedelta(days=n)


def flat(spark, code, days, close, volume=100):
    return spark.createDataFrame([(code, day(n), close, close, volume) for n in days], PRICE_SCHEMA)


def figures(df):
    return {(r["code"], (r["date"] - DAY).days): (r["open"], r["close"], r["volume"]) for r in df.collect()}


def test_factors_of_an_overlap(spark):
    stored = flat(spark, "A", range(10), 100.0).unionByName(flat(spark, "B", range(10), 50.0)).unionByName(flat(spark, "C", range(10), 10.0))
    batch = flat(spark, "A", range(7, 12), 50.2)
    # B: one bar of three corrected; C: rounding only; D: new; E: no closes.
    batch = batch.unionByName(flat(spark, "B", (7, 8), 50.0)).unionByName(flat(spark, "B", (9,), 25.0))
    batch = batch.unionByName(flat(spark, "C", range(8, 11), 10.01)).unionByName(flat(spark, "D", (11,), 5.0))
    batch = batch.unionByName(spark.createDataFrame([("E", day(3), None, None, 1), ("E", day(4), 0.0, 0.0, 1)], PRICE_SCHEMA))
    got = {r["code"]: (r["factor"], r["bars"], (r["start"] - DAY).days) for r in overlap_factors(stored, batch).collect()}
    assert got == {"A": (50.2 / 100, 3, 7), "B": (1.0, 3, 7), "C": (1.0, 2, 8), "D": (1.0, 0, 11), "E": (1.0, 0, 3)}
    assert overlap_factors(stored, batch.limit(0)).count() == 0


def test_a_reload_reaches_behind_an_earlier_change(spark):
    loads = spark.createDataFrame([(1, "A", day(0), 1.0), (2, "A", day(8), 0.5), (3, "A", day(4), 0.25), (4, "A", day(9), 1.0)], LOAD_SCHEMA)
    assert {((r["date"] - DAY).days, r["factor"]) for r in reaching(loads).collect()} == {(4, 0.5), (4, 0.25)}
    got = figures(adjusted_bars(flat(spark, "A", range(10), 80.0), loads))
    assert all(got["A", n] == ((10.0, 10.0, 800) if n < 4 else (80.0, 80.0, 100)) for n in range(10))
    plan = adjusted_bars(flat(spark, "A", range(10), 80.0), loads)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_loads_through_the_store(spark, tmp_path):
    store, log = PriceStore(spark, str(tmp_path / "s")), LoadLog(spark, str(tmp_path / "l"))
    assert read_adjusted(store, log).count() == 0
    with_seq = lambda df: df.withColumn("seq", F.lit(1))
    upsert_rebased(store, log, with_seq(flat(spark, "A", range(6), 100.0)), 1, "seq")
    second = with_seq(flat(spark, "A", range(4, 8), 50.0, 200))
    upsert_rebased(store, log, second, 2, "seq")
    want = {("A", n): (50.0, 50.0, 200) for n in range(8)}
    assert figures(read_adjusted(store, log)) == want
    # logged and upserted once, also when it arrives again
    upsert_rebased(store, log, second, 2, "seq")
    assert figures(read_adjusted(store, log)) == want and log.read().count() == 2
    # logged, then died before the upsert: the batch comes again
    third = with_seq(flat(spark, "A", range(6, 9), 25.0, 400))
    log.record(store.read(), third.drop("seq"), 3)
    upsert_rebased(store, log, third, 3, "seq")
    assert figures(read_adjusted(store, log)) == {("A", n): (25.0, 25.0, 400) for n in range(9)}


def hits(df):
    return sorted(tuple(r) for r in df.collect())


def test_state_equals_the_full_screen_after_random_batches(spark, tmp_path):
    rnd = random.Random(11)
    cfg = ScreenConfig(streak_min=1, streak_top=2, vol_mult=1.0, vol_mult_short=1.0, min_volume=0, base_window=3)

    def bars(codes, days, at_most):
        rows = {(c, n) for c in codes for n in days if rnd.random() < 0.8}
        rows = rnd.sample(sorted(rows), min(len(rows), at_most))
        return [(c, day(n), float(rnd.randrange(8, 12)), float(rnd.randrange(8, 13)), rnd.randrange(1, 9), i) for i, (c, n) in enumerate(rows)]

    schema = "code string, date date, open double, close double, volume bigint, seq int"
    names = [f"c{i}" for i in range(12)]
    full = spark.createDataFrame(bars(names, range(20), 999), schema)
    state = StreakState(spark, str(tmp_path / "state"), base_window=4, buckets=5)
    state.rebuild(full.drop("seq"))
    full = spark.createDataFrame(full.drop("seq").collect(), PRICE_SCHEMA)
    for codes, days, n in ((names[:3], range(20, 23), 9), (names[2:7], range(0, 23), 40), ([*names[5:], "new"], range(15, 26), 60), (names, range(10, 30), 80), ([], [], 0)):
        batch = spark.createDataFrame(bars(codes, days, n), schema)
        full = spark.createDataFrame(merge_batch(full, batch, "seq").collect(), PRICE_SCHEMA)
        state.refresh(batch, "seq", lambda: full)
        assert hits(screen(state.read(), cfg)) == hits(screen(full, cfg))
        # the same batch again, as after a failure, changes nothing
        before = sorted(map(tuple, state.read().collect()))
        state.refresh(batch, "seq", lambda: full)
        assert sorted(map(tuple, state.read().collect())) == before


def test_untouched_codes_are_not_read(spark, tmp_path):
    rising = spark.createDataFrame([("A", day(n), 10.0 + n, 10.5 + n, 5) for n in range(12)], PRICE_SCHEMA)
    # B's streak is broken by one bar, which a correction joins to the streak before it.
    broken = spark.createDataFrame([("B", day(n), 10.0 + n, 10.5 + n if n != 9 else 1.0, 5) for n in range(12)], PRICE_SCHEMA)
    full = rising.unionByName(broken)
    state = StreakState(spark, str(tmp_path / "state"), base_window=2, buckets=64)
    state.rebuild(full)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").glob("bucket=*/*.parquet")}
    assert len(files) == 2 and state.read().where("code = 'B'").count() == 5
    later = spark.createDataFrame([("B", day(12), 30.0, 31.0, 9)], PRICE_SCHEMA).withColumn("seq", F.lit(0))

    def unread():
        raise AssertionError("history was read")

    assert state.refresh(later, "seq", unread) == 0
    kept = [p for p in files if p.exists()]
    assert len(kept) == 1 and kept[0].stat().st_mtime_ns == files[kept[0]]
    mended = spark.createDataFrame([("B", day(9), 19.0, 19.5, 5)], PRICE_SCHEMA).withColumn("seq", F.lit(0))
    history = merge_batch(merge_batch(full, later, "seq"), mended, "seq")
    assert state.refresh(mended, "seq", lambda: history) == 1
    assert state.read().where("code = 'B'").count() == 13
