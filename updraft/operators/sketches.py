"""Mergeable sketches: distinct codes of any range, percent ranks of large groups.

Both give estimates with a stated error; the exact ways are ``views.data_period``
and ``ranking.percent_ranks``, which stay the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft.operators.upsert import period_of

# A sketch of 2^12 cells takes about 2.5 kB and errs by 1.6 % (one standard deviation).
LG_CELLS = 12
# Sketches of fewer values than this hold them all; larger ones take about 25 kB.
RANK_CELLS = 1024
# Quantiles taken of a sketch, and how many of them are looked through at a time.
QUANTILES, STEP = 1024, 32


def codes_error(lg_cells: int = LG_CELLS) -> float:
    """Relative error of an estimated number of codes, three standard deviations."""
    return 3 * 1.04 / 2 ** (lg_cells / 2)


def rank_error(cells: int = RANK_CELLS) -> float:
    """Error of an estimated rank as a part of the group, at 99 % confidence."""
    return 2.296 / cells**0.9723 + 1 / QUANTILES


def period_sketches(prices: DataFrame, unit: str = "month", lg_cells: int = LG_CELLS) -> DataFrame:
    """(period, codes, rows, first, last): a sketch of each period's codes.

    Bars collapse into one sketch per period and task before the shuffle.
    """
    return prices.groupBy(period_of(F.col("date"), unit).alias("period")).agg(
        F.hll_sketch_agg("code", F.lit(lg_cells)).alias("codes"), F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


def united(sketches: DataFrame) -> DataFrame:
    """One row: first and last date, rows and the estimated number of codes of all given periods."""
    whole = sketches.agg(
        F.min("first").alias("from"), F.max("last").alias("to"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.hll_sketch_estimate(F.hll_union_agg("codes")).alias("codes"),
    )
    return whole.withColumn("codes", F.when(F.col("rows") == 0, F.lit(0)).otherwise(F.col("codes")).cast("bigint"))


def sketched_percent_ranks(
    df: DataFrame, columns: dict[str, str], by: Sequence[str] = (), cells: int = RANK_CELLS
) -> DataFrame:
    """Add an estimated ``percent_rank`` of each value column: ``{value column: output}``.

    A group of any size is one sketch per task and one per group after the shuffle, where the
    exact way sorts it. Each value is then looked up among the quantiles of its group, first
    among every ``STEP``-th one. An estimate is off by ``rank_error`` of the group, and exact in
    groups of fewer than ``cells`` rows. Values are neither NULL nor NaN; NULL keys are one group.
    """
    by = list(by)
    # Adding zero makes the negative zero equal to the other one.
    number = {value: F.col(value).cast("double") + F.lit(0.0) for value in columns}
    at = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES + 1)])

    def quantiles(value: str) -> Column:
        return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(number[value], F.lit(cells)), at).alias(value)

    keys = {c: f"_by{i}" for i, c in enumerate(by)}
    groups = df.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(
        F.count(F.lit(1)).alias("_size"), F.struct(*[quantiles(value) for value in columns]).alias("_fine")
    )
    every = F.sequence(F.lit(STEP), F.lit(QUANTILES), F.lit(STEP))

    def coarse(value: str) -> Column:
        return F.transform(every, lambda i: F.element_at(F.col("_fine")[value], i)).alias(value)

    packed = groups.select(*keys.values(), F.struct("_size", "_fine", F.struct(*map(coarse, columns)).alias("_coarse")).alias("_group"))
    if by:
        joined = df.join(packed, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    else:
        joined = df.withColumn("_group", packed.scalar())
    group = F.col("_group")

    def rank(value: str) -> Column:
        lower = lambda x: x < number[value]
        steps = F.size(F.filter(group["_coarse"][value], lower))
        rest = F.size(F.filter(F.slice(group["_fine"][value], steps * STEP + 1, F.lit(STEP)), lower))
        # The quantiles below a value are as many as the part of the group below it, rounded down.
        below = F.ceil((steps * STEP + rest) * group["_size"] / F.lit(QUANTILES))
        return F.when(group["_size"] > 1, F.least(below / (group["_size"] - 1), F.lit(1.0))).otherwise(0.0)

    return joined.withColumns({out: rank(value) for value, out in columns.items()}).select(*df.columns, *columns.values())
