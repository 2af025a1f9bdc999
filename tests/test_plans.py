"""Physical plans: exchanges, pruning, no Python in the hot path."""

import re

import pytest
from pyspark.sql import functions as F

from updraft.operators import freshness, themes
from updraft.operators.streaks import recent_first_metrics, streak_lengths, streak_metrics
from updraft.operators.sweep import sweep_metrics
from updraft.plans import inputs
from updraft.plans.workload import LOOSE, QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "bars")
    inputs.part_month_bars(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_screen_metrics_take_one_exchange_and_no_join(stored):
    plan = plan_of(streak_metrics(stored, LOOSE))
    assert plan.count("Exchange") == 1 and "Join" not in plan
    # the window's sort serves both windows
    assert len(re.findall(r"Sort \[code#\d+ ASC NULLS FIRST, date", plan)) == 1
    assert "Python" not in plan


def test_sweep_takes_one_exchange_and_two_sorts(stored):
    plan = plan_of(sweep_metrics(stored, LOOSE))
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert len(re.findall(r"\+- \*?\(?\d*\)? ?Sort \[", plan)) == 2
    assert "Python" not in plan


def test_bars_aggregate_before_the_shuffle_and_prune_columns(spark):
    plan = plan_of(inputs.part_month_bars(spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
    assert "l_tax" not in plan and "l_discount" not in plan


def test_date_bounds_reach_the_scan(stored):
    plan = plan_of(streak_lengths(stored.filter(F.col("date") >= "2000-01-01")))
    assert "GreaterThanOrEqual(date,2000-01-01)" in plan


def test_narrow_operators_do_not_shuffle(spark):
    for name in ("ingest_guard",):
        assert "Exchange" not in plan_of(QUERIES[name](spark, SF))
    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = plan_of(freshness.with_latest_trading_day(events, F.col("ts")))
    assert "Exchange" not in plan


def test_scaling_reads_bounds_as_a_scalar(spark):
    plan = plan_of(themes.with_confidence_width(inputs.theme_reports(spark, SF)))
    assert "Subquery" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_recent_first_filters_older_bars_before_the_shuffle(stored):
    cut = F.lit("2001-06-01").cast("date")
    metrics = recent_first_metrics(
        stored.filter(F.col("date") >= cut), stored.filter(F.col("date") < cut), LOOSE
    )
    lines = plan_of(metrics).split("\n")
    semi = [i for i, line in enumerate(lines) if "BroadcastHashJoin" in line and "LeftSemi" in line]
    shuffle = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(code" in line]
    assert len(shuffle) == 1 and semi and min(semi) > shuffle[0]
    older = [line for line in lines if "LessThan(date,2001-06-01)" in line]
    assert older  # the date bound reaches the scan
