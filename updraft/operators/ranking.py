"""Ranks over a whole population, with no single-task window over it.

``percent_rank()`` and ``row_number()`` without a partition clause move every
row into one task. Here the population is range-partitioned on the sort key
(the key ends in a unique column, so equal values are split too), each slice
is numbered on its own, and slices are shifted by the totals before them.

Populations checked to be small use the built-in window: it is one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.session import BROADCAST_ROWS, materialize

# Largest group one task may number.
SINGLE_TASK_ROWS = 200_000
# Copies of the value table when it is joined to a population with hot values.
SALTS = 16


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    weight: Column,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` up to and including each row, in
    ``order`` within ``by``; and ``total``, the sum of the whole group.

    ``order`` must identify a row within ``by``. Slice numbers come from range
    partitioning, whose sampled bounds could differ between evaluations, so the
    sliced rows are materialized before totals are taken from them.
    """
    by = list(by)
    sliced = materialize(
        df.withColumn("_weight", weight.cast("bigint"))
        .repartitionByRange(*[F.col(c) for c in by], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    # One row per slice and group: within a group at most as many rows as
    # shuffle partitions, whatever the size of the group.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*by, "_slice").agg(F.sum("_weight").alias("_sum"))
        .select(
            *by, "_slice",
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_sum").over(group).alias("_total"),
        )
    )
    inside = (
        Window.partitionBy(*by, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = (
        sliced.withColumn("_inside", F.sum("_weight").over(inside))
        .join(offsets, [*by, "_slice"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
    )
    if total is not None:
        summed = summed.withColumn(total, F.col("_total"))
    return summed.drop("_inside", "_before", "_total", "_slice", "_weight")


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the biggest group of a materialized ``df``."""
    if not by:
        return df.count()
    counts = df.groupBy(*by).count()
    return counts.agg(F.max("count").alias("n")).first()["n"] or 0


def _value_ranks(df: DataFrame, values: Sequence[str], by: list[str]) -> DataFrame:
    """(by, _of, _value, _rank): percent rank of every distinct value of the
    columns ``values``, materialized.

    Equal values collapse before the shuffle, so a value shared by a third of
    the population costs one row per map task.
    """
    pairs = F.array(
        *[F.struct(F.lit(v).alias("_of"), F.col(v).cast("double").alias("_value")) for v in values]
    )
    histogram = (
        df.select(*by, F.inline(pairs))
        .groupBy(*by, "_of", "_value").agg(F.count(F.lit(1)).alias("_n"))
    )
    summed = running_total(
        histogram, [*by, "_of"], [F.col("_value").asc()], F.col("_n"), "_upto", "_size"
    )
    below = (F.col("_upto") - F.col("_n")).cast("double")
    rank = F.coalesce(F.try_divide(below, F.col("_size") - 1), F.lit(0.0))
    return materialize(summed.select(*by, "_of", "_value", rank.alias("_rank")))


def _join_ranks(df: DataFrame, ranks: DataFrame, keys: list[str], unique: str) -> DataFrame:
    """Look up ranks by value: broadcast when checked to be small, else with
    salt, since one value may belong to a third of the rows."""
    if ranks.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(ranks), keys)
    salted = ranks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(unique), F.lit(SALTS)).cast("int")
    return df.withColumn("_salt", salt).join(salted, [*keys, "_salt"]).drop("_salt")


def percent_ranks(
    df: DataFrame,
    columns: dict[str, str],
    by: Sequence[str] = (),
    *,
    unique: str,
    single_task: bool,
) -> DataFrame:
    """Add ``percent_rank`` of each value column: ``{value column: output}``.

    ``df`` must be materialized and its values not NULL; ``single_task`` says
    that its largest group was checked against ``SINGLE_TASK_ROWS``.
    """
    by = list(by)
    if single_task:
        group = Window.partitionBy(*by)
        return df.withColumns(
            {out: F.percent_rank().over(group.orderBy(value)) for value, out in columns.items()}
        )
    ranks = _value_ranks(df, list(columns), by)
    for value, out in columns.items():
        own = ranks.filter(F.col("_of") == value).select(
            *by, F.col("_value").alias(value), F.col("_rank").alias(out)
        )
        df = _join_ranks(df, own, [*by, value], unique)
    return df


def row_numbers(
    df: DataFrame,
    order: Sequence[Column],
    out: str,
    by: Sequence[str] = (),
    *,
    single_task: bool,
) -> DataFrame:
    """Add a bigint ``row_number`` in ``order``, which must end in a unique key."""
    by = list(by)
    if single_task:
        group = Window.partitionBy(*by)
        return df.withColumn(out, F.row_number().over(group.orderBy(*order)).cast("bigint"))
    return running_total(df, by, order, F.lit(1), out)
