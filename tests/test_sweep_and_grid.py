"""The sweep and the grid against plain screens."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from updraft import ScreenConfig, screen
from updraft.operators.grid import config_grid
from updraft.operators.sweep import sweep_screen
from updraft.plans.screening import screen_recent_first

CONFIGS = {
    "loose": ScreenConfig(streak_min=1, streak_top=2, vol_mult=1.0, vol_mult_short=1.0, min_volume=0),
    "avg": ScreenConfig(vol_mode="avg", vol_mult=1.1, vol_mult_short=1.2, min_volume=300, base_window=5),
    "turnover": ScreenConfig(metric="turnover", streak_min=1, turnover_vol_mult=1.0,
                             turnover_vol_mult_short=1.1, min_volume=0, min_turnover=30_000.5),
}


def random_rows(codes=60, days=40, seed=3):
    """Random walks with gaps; some codes stop early, some bars lack values."""
    rng = random.Random(seed)
    rows = []
    for c in range(codes):
        price, stop = 100.0, days if c % 5 else rng.randint(5, days)
        for d in range(stop):
            if rng.random() < 0.15:
                continue
            close = round(max(price * rng.uniform(0.96, 1.05), 1.0), 2)
            open_ = None if rng.random() < 0.01 else round(rng.uniform(0.98, 1.0) * close + (rng.random() < 0.4), 2)
            rows.append((f"c{c:02d}", dt.date(2026, 1, 1) + dt.timedelta(days=d), open_, close, rng.randint(100, 900)))
            price = close
    return rows


@pytest.fixture(scope="module")
def rows():
    return random_rows()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("name", CONFIGS)
def test_carried_sweep_equals_a_screen_of_each_date(prices, rows, name):
    cfg = CONFIGS[name]
    swept = sweep_screen(prices(rows), cfg, carry_forward=True).persist()
    assert swept.count() > 50
    for day in (3, 17, 39):
        as_of = dt.date(2026, 1, 1) + dt.timedelta(days=day)
        expected = screen(prices([r for r in rows if r[1] <= as_of]), cfg)
        assert same(swept.filter(F.col("as_of") == as_of).drop("as_of"), expected), as_of


def test_plain_sweep_ranks_the_bars_of_a_date(prices, rows):
    cfg = CONFIGS["loose"]
    swept = sweep_screen(prices(rows), cfg)
    as_of = dt.date(2026, 1, 21)
    present = {r[0] for r in rows if r[1] == as_of}
    expected = screen(prices([r for r in rows if r[1] <= as_of and r[0] in present]), cfg)
    assert same(swept.filter(F.col("as_of") == as_of).drop("as_of"), expected)


@pytest.mark.parametrize(
    "name,broadcast_rows", [("loose", 1_000), ("loose", 0), ("avg", 1_000), ("turnover", 0)]
)
def test_recent_first_equals_the_plain_screen(prices, rows, monkeypatch, name, broadcast_rows):
    from updraft.operators import streaks

    monkeypatch.setattr(streaks, "BROADCAST_ROWS", broadcast_rows)
    cfg, everything = CONFIGS[name], prices(rows)
    expected = screen(everything, cfg)
    for day in (0, 12, 20, 60):
        cut = dt.date(2026, 1, 1) + dt.timedelta(days=day)
        recent, older = everything.filter(F.col("date") >= cut), everything.filter(F.col("date") < cut)
        assert same(screen_recent_first(recent, older, cfg), expected), cut


def test_grid_equals_separate_screens(prices, rows):
    grid = config_grid(prices(rows), CONFIGS).persist()
    sliced = config_grid(prices(rows), CONFIGS, limit=0)
    assert same(grid, sliced)
    for name, cfg in CONFIGS.items():
        assert same(grid.filter(F.col("config") == name).drop("config"), screen(prices(rows), cfg)), name


def test_grid_needs_configs(prices):
    with pytest.raises(ValueError):
        config_grid(prices([]), {})


def test_a_hot_code_changes_nothing_for_others(spark):
    """Trades of one code outnumber all others; bars and screens stay the same."""
    from updraft.operators.bars import build_bars

    def bars(trades):
        return build_bars(
            trades, code=F.col("code"), date=F.col("day"), price=F.col("price"),
            quantity=F.col("qty"), order=[F.col("at")],
        )

    trades = spark.range(6_000).select(
        F.concat(F.lit("c"), (F.col("id") % 20).cast("string")).alias("code"),
        F.date_add(F.lit(dt.date(2026, 1, 1)), (F.col("id") / 20 % 30).cast("int")).alias("day"),
        F.col("id").alias("at"), (100 + F.col("id") % 97 / 10).alias("price"),
        (1 + F.col("id") % 13).alias("qty"),
    )
    hot = spark.range(12_000).select(
        F.lit("hot").alias("code"), F.lit(dt.date(2026, 1, 9)).alias("day"),
        F.col("id").alias("at"), F.col("id").cast("double").alias("price"), F.lit(1).alias("qty"),
    )
    both = bars(trades.unionByName(hot, allowMissingColumns=False))
    row = both.filter("code = 'hot'").first()
    assert (row["open"], row["close"], row["volume"]) == (0.0, 11_999.0, 12_000)
    cfg = replace(CONFIGS["loose"], base_window=5)
    assert same(screen(both.filter("code <> 'hot'"), cfg), screen(bars(trades), cfg))
