"""Random price tables with gaps, ties and NULLs: screens against SQL."""

import datetime as dt
import itertools
import random

import duckdb
import pandas as pd
import pytest

from updraft import ScreenConfig, screen
from updraft.plans.oracles import screen_sql

CONFIGS = [
    ScreenConfig(
        metric=metric, vol_mode=mode, streak_min=low, streak_top=low + 1, base_window=window,
        vol_mult=1.0, vol_mult_short=1.2, turnover_vol_mult=1.0, turnover_vol_mult_short=1.2,
        min_volume=liquid, min_turnover=liquid * 90, w_vol=w, w_rise=round(1 - w, 2),
    )
    for (metric, mode), (low, window, liquid, w) in itertools.product(
        itertools.product(("volume", "turnover"), ("all", "avg")),
        ((1, 5, 0, 0.5), (2, 10, 400, 0.3)),
    )
]


def table(seed):
    """Few distinct prices and volumes, so equalities and ties are common."""
    rng = random.Random(seed)
    rows = []
    for c in range(150):
        close = 100.0
        for d in range(rng.randint(1, 30)):
            if rng.random() < 0.1:
                continue
            open_ = close + rng.choice([-1, 0, 0, 1])
            close = max(close + rng.choice([-1, 0, 1, 1, 2]), 1.0)
            volume = rng.choice([300, 500, 500, 700, 1100])
            bar = [open_, close, volume]
            if rng.random() < 0.03:
                bar[rng.randrange(3)] = None
            rows.append((f"c{c}", dt.date(2026, 1, 1) + dt.timedelta(days=d), *bar))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_screens_match_sql(spark, prices, seed):
    rows = table(seed)
    frame = prices(rows).persist()
    con = duckdb.connect()
    bars = pd.DataFrame(rows, columns=["code", "date", "open", "close", "volume"])
    bars["volume"] = bars["volume"].astype("Int64")
    con.register("bars_df", bars)
    source = """SELECT code, CAST(date AS DATE) AS date, CAST(open AS DOUBLE) AS open,
                CAST(close AS DOUBLE) AS close, CAST(volume AS BIGINT) AS volume FROM bars_df"""
    hits = 0
    for cfg in CONFIGS:
        cursor = con.execute(screen_sql(source, cfg) + " ORDER BY rank")
        columns = [d[0] for d in cursor.description]
        expected = cursor.fetchall()
        assert [tuple(r[c] for c in columns) for r in screen(frame, cfg).collect()] == expected, cfg
        hits += len(expected)
    assert hits > 100
