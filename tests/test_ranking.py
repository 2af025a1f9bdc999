"""Distributed ranks against the built-in windows, with hot values."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from updraft.operators import ranking
from updraft.operators.screening import rank_hits
from updraft.operators.sweep import sweep_screen
from updraft.plans.workload import LOOSE
from updraft.session import materialize


@pytest.fixture
def population(spark):
    """A third of the rows share one value and one group holds half of them."""
    random.seed(5)
    rows = [
        (
            f"c{n:05d}", "hot" if n % 2 else f"g{n % 7}",
            1.5 if n % 3 == 0 else round(random.uniform(-3, 9), 2),
            round(random.gauss(0, 2), 1),
        )
        for n in range(4_000)
    ]
    return materialize(spark.createDataFrame(rows, "code string, grp string, a double, b double"))


@pytest.mark.parametrize("by", [[], ["grp"]])
@pytest.mark.parametrize("broadcast_rows", [ranking.BROADCAST_ROWS, 0])
def test_percent_ranks_match_the_built_in(population, monkeypatch, by, broadcast_rows):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", broadcast_rows)
    columns = {"a": "ra", "b": "rb"}
    sliced = ranking.percent_ranks(population, columns, by, unique="code", single_task=False)
    plain = ranking.percent_ranks(population, columns, by, unique="code", single_task=True)
    assert sliced.count() == population.count()
    names = ["code", "grp", "a", "b", "ra", "rb"]
    assert sliced.select(names).exceptAll(plain.select(names)).count() == 0


@pytest.mark.parametrize("by", [[], ["grp"]])
def test_row_numbers_match_the_built_in(population, by):
    order = [F.col("a").desc(), F.col("b").asc(), F.col("code").asc()]
    sliced = ranking.row_numbers(population, order, "rank", by, single_task=False)
    plain = ranking.row_numbers(population, order, "rank", by, single_task=True)
    names = ["code", "rank"]
    assert sliced.select(names).exceptAll(plain.select(names)).count() == 0
    assert sliced.count() == plain.count()


def test_running_total_with_weights(population):
    out = ranking.running_total(
        population.withColumn("w", F.hash("code") % 5), [], [F.col("code").asc()], F.col("w"),
        "upto", "all",
    )
    window = Window.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    expected = population.withColumn("e", F.sum(F.hash("code") % 5).over(window))
    joined = out.join(expected.select("code", "e"), "code")
    assert joined.filter("upto <> e").count() == 0
    assert out.select("all").distinct().count() == 1


def _hits(spark, n, as_of=None):
    random.seed(11)
    rows = []
    for i in range(n):
        # a third of the hits are equal but for their code
        low, rise = (2.0, 5.0) if i % 3 == 0 else (round(random.uniform(1, 9), 2), i % 50 / 2)
        rows.append((f"c{i}", i % 4 + 1, 1 + i % 2, 10.0, 9.0, low * 100, low * 100, 100.0, low, low, rise))
    return spark.createDataFrame(
        rows,
        "code string, streak_len int, tier int, last_close double, pre_close double, avg_m double, "
        "min_m double, base_med double, avg_ratio double, min_ratio double, rise_pct double",
    ).withColumn("last_date", F.current_date())


def test_both_ways_to_rank_hits_agree(spark):
    hits = _hits(spark, 900)
    plain, sliced = rank_hits(hits, LOOSE), rank_hits(hits, LOOSE, limit=0)
    assert plain.count() == sliced.count() == 900
    assert plain.exceptAll(sliced).count() == 0
    assert [r["rank"] for r in sliced.select("rank").orderBy("rank").collect()] == list(range(1, 901))


def test_sweep_ranks_agree_both_ways(spark):
    from updraft.plans import inputs

    bars = inputs.part_month_bars(spark, "/root/testdata/sf0.001")
    plain, sliced = sweep_screen(bars, LOOSE), sweep_screen(bars, LOOSE, limit=0)
    assert plain.count() == sliced.count() > 0
    assert plain.exceptAll(sliced).count() == 0
