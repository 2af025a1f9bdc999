"""The screen on small hand-made series."""

import datetime as dt
from dataclasses import replace

import pytest
from conftest import by_code, series

from updraft import ScreenConfig, screen
from updraft.operators.streaks import streak_lengths, streak_metrics

RISE = [(99.5, 101.0), (101.0, 103.0), (103.0, 106.0)]
ANY = ScreenConfig(min_volume=0)


def rising(volume, days=3):
    return [(o, c, volume) for o, c in RISE[:days]]


def test_streak_with_surge_is_a_tier_one_hit(prices):
    hit = by_code(screen(prices(series("AAAA", [20_000] * 15, rising(60_000)))))["AAAA"]
    assert hit["rank"] == 1 and hit["streak_len"] == 3 and hit["tier"] == 1
    assert hit["min_ratio"] == 3.0 and hit["avg_ratio"] == 3.0
    assert hit["rise_pct"] == 7.07
    assert hit["last_date"] == dt.date(2026, 1, 22) and hit["last_close"] == 106.0
    assert hit["avg_vol3"] == hit["min_vol3"] == 60_000 and hit["base_med"] == 20_000
    assert hit["score"] == 0.0  # a population of one


def test_misses(prices):
    falling = [("DOWN", dt.date(2026, 1, 5) + dt.timedelta(days=n), 100.0, 98.0, 50_000)
               for n in range(20)]
    thin = series("THIN", [500] * 15, rising(1_500))
    flat = series("FLAT", [20_000] * 15, rising(21_000))
    assert screen(prices(falling + thin + flat)).count() == 0


def test_thresholds_are_inclusive_and_liquidity_is_exclusive(prices):
    rows = (
        series("EXACT", [20_000] * 15, rising(26_000))
        + series("BELOW", [20_000] * 15, rising(25_999))
        + series("LIMIT", [10_000] * 15, rising(60_000))
        + series("OVER", [10_001] * 15, rising(60_000))
    )
    assert set(by_code(screen(prices(rows)))) == {"EXACT", "OVER"}


def test_short_streaks_need_the_higher_factor(prices):
    rows = series("IN", [20_000] * 15, rising(40_000, 2)) + series(
        "OUT", [20_000] * 15, rising(38_000, 2)
    )
    hits = by_code(screen(prices(rows)))
    assert set(hits) == {"IN"} and hits["IN"]["tier"] == 2


def test_average_mode_admits_what_all_mode_rejects(prices):
    volumes = [21_000, 60_000, 60_000]
    rows = prices(series("MIX", [20_000] * 15, [(o, c, v) for (o, c), v in zip(RISE, volumes)]))
    assert screen(rows).count() == 0
    hit = by_code(screen(rows, ScreenConfig(vol_mode="avg")))["MIX"]
    assert hit["avg_vol3"] == 47_000 and hit["min_vol3"] == 21_000
    assert hit["avg_ratio"] == 2.35 and hit["min_ratio"] == 1.05


def test_turnover_metric_has_its_own_thresholds(prices):
    # base turnover 99 * 20000 = 1.98e6; first streak day 101 * v
    low, high = 29_405, 29_406  # 101 * v against 1.5 * 1.98e6 = 2.97e6
    rows = prices(
        series("LOW", [20_000] * 15, rising(low)) + series("HIGH", [20_000] * 15, rising(high))
    )
    hits = by_code(screen(rows, ScreenConfig(metric="turnover")))
    assert set(hits) == {"HIGH"} and hits["HIGH"]["base_med"] == 1_980_000


def test_turnover_limit_applies_to_the_volume_metric(prices):
    rows = prices(series("AAAA", [20_000] * 15, rising(60_000)))
    assert screen(rows, replace(ANY, min_turnover=1_980_000)).count() == 0
    assert screen(rows, replace(ANY, min_turnover=1_979_999)).count() == 1


def test_baseline_is_the_window_before_the_streak(prices):
    base = [1] * 5 + [10, 20] * 5
    figures = by_code(streak_metrics(prices(series("EVEN", base, rising(100))), ANY))["EVEN"]
    assert figures["base_med"] == 15.0  # even count: mean of the middle two
    assert figures["pre_close"] == 99.0
    short = by_code(streak_metrics(prices(series("FEW", [7, 9, 30], rising(100))), ANY))["FEW"]
    assert short["base_med"] == 9.0  # fewer bars than the window


def test_all_up_history(prices):
    rows = [("UP", dt.date(2026, 1, 1 + n), 10.0 + n, 11.0 + n, 100 * (n + 1)) for n in range(6)]
    figures = by_code(streak_metrics(prices(rows), ANY))["UP"]
    assert figures["streak_len"] == 5 and figures["base_med"] == 100.0
    assert figures["pre_close"] == 11.0


def test_equal_prices_break_a_streak(prices):
    base = [20_000] * 12
    rows = (
        series("OPEN", base, [(99.5, 101.0, 9), (102.0, 102.0, 9), (102.0, 103.0, 9)])
        + series("PREV", base, [(99.5, 101.0, 9), (100.0, 101.0, 9), (101.0, 103.0, 9)])
        + [("NULLS", dt.date(2026, 1, 5), None, 9.0, 5), ("NULLS", dt.date(2026, 1, 6), None, 10.0, 5)]
    )
    lengths = {r["code"]: r["streak_len"] for r in streak_lengths(prices(rows)).collect()}
    assert lengths == {"OPEN": 1, "PREV": 1, "NULLS": 0}


def test_gaps_do_not_break_and_suspended_codes_compete(prices):
    old = [
        (code, date - dt.timedelta(days=400) - dt.timedelta(days=3 * n), o, c, v)
        for n, (code, date, o, c, v) in enumerate(reversed(series("OLD", [20_000] * 15, rising(60_000))))
    ]
    new = series("NEW", [20_000] * 15, rising(60_000))
    hits = by_code(screen(prices(old + new)))
    assert set(hits) == {"OLD", "NEW"}
    assert hits["OLD"]["last_date"] < dt.date(2025, 1, 1)


def test_ranking_rounds_first_then_breaks_ties_by_code(prices):
    rows = []
    for code, volume in [("C", 60_001), ("B", 60_000), ("A", 60_049), ("TOP", 80_000)]:
        rows += series(code, [20_000] * 15, rising(volume))
    rows += series("T2", [20_000] * 15, rising(200_000, 2))
    hits = by_code(screen(prices(rows)))
    # 3.0, 3.0 and 3.00245 tie after rounding; tier 2 comes last whatever its score
    assert [hits[c]["rank"] for c in ("TOP", "A", "B", "C", "T2")] == [1, 2, 3, 4, 5]
    assert hits["A"]["score"] == hits["B"]["score"] == hits["C"]["score"]
    # min_ratio ranks: A,B,C = 0, TOP = 0.75, T2 = 1; rise: T2 = 0, others 0.25
    assert hits["TOP"]["score"] == 0.5 and hits["T2"]["score"] == 0.5
    assert hits["A"]["score"] == 0.125


def test_integer_outputs_round_half_to_even(prices):
    rows = series("HALF", [10, 11] * 5, [(99.5, 101.0, 31), (101.0, 103.0, 32)])
    hit = by_code(screen(prices(rows), ANY))["HALF"]
    assert hit["base_med"] == 10  # 10.5
    assert hit["avg_vol3"] == 32  # 31.5


def test_result_schema(prices):
    result = screen(prices([]))
    assert result.count() == 0
    assert dict(result.dtypes) == {
        "rank": "bigint", "code": "string", "streak_len": "bigint", "tier": "int",
        "last_date": "date", "last_close": "double", "rise_pct": "double",
        "avg_vol3": "bigint", "min_vol3": "bigint", "base_med": "bigint",
        "avg_ratio": "double", "min_ratio": "double", "score": "double",
    }


def test_bad_configurations_are_rejected():
    with pytest.raises(ValueError):
        ScreenConfig(vol_mode="median")
    with pytest.raises(ValueError):
        ScreenConfig(metric="price")
    with pytest.raises(ValueError):
        ScreenConfig(base_window=0)
    with pytest.raises(ValueError):
        ScreenConfig.interactive(base_window=31)
    with pytest.raises(ValueError):
        ScreenConfig.interactive(streak_min=5, streak_top=4)


def test_interactive_configuration():
    cfg = ScreenConfig.interactive(metric="turnover", mult=2.0, min_turnover_oku=1.5, w_vol=0.35)
    assert cfg.turnover_vol_mult == 2.0 and cfg.turnover_vol_mult_short == 2.5
    assert cfg.vol_mult == 1.3 and cfg.min_turnover == 1.5e8 and cfg.w_rise == 0.65
    assert ScreenConfig.interactive(streak_min=4).streak_top == 4
    assert cfg.digest != ScreenConfig().digest and ScreenConfig().digest == ScreenConfig().digest
