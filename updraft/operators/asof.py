"""As-of lookup: for each event the last known row of its key at that moment.

Events and rows are united and the last row is carried forward in a window. A window per key would put
a hot key into one task, so keys are sliced by time: rows are carried within a slice, each
slice's last row is carried over the slices, a few rows for each key, and events that come before
the first row of their slice take that. No inequality join, and no row meets more than one partner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.session import materialize


def asof_lookup(
    events: DataFrame, known: DataFrame, key: str, at: str, known_at: str, values: Sequence[str], slice_of: Column | None = None
) -> DataFrame:
    """``events`` with ``values`` and ``known_at`` of the last row of ``known`` with the same key at or before ``at``.

    ``known`` holds one row per (key, known_at), whose columns carry other names than those of ``events``, the key apart.
    Events before the first row, and those without key or time, get NULLs. ``slice_of``: a rising function of the
    column ``_at``; a month by default.
    """
    columns = events.columns
    slice_of = F.trunc(F.col("_at"), "month") if slice_of is None else slice_of
    row = F.struct(F.col(known_at).alias(known_at), *values)
    rows = known.where(F.col(key).isNotNull() & F.col(known_at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(known_at).alias("_at"), row.alias("_row")
    ).withColumn("_slice", slice_of)
    asked = events.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(*columns).alias("_event")).withColumn("_slice", slice_of)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = rows.select("_key", "_slice", "_at", "_row", none(asked, "_event"), F.lit(0).alias("_side")).unionByName(
        asked.select("_key", "_slice", "_at", none(rows, "_row"), "_event", F.lit(1).alias("_side"))
    )
    # A row known at the very moment of an event counts.
    within = Window.partitionBy("_key", "_slice").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_row", F.last("_row", ignorenulls=True).over(within)).where("_side = 1").select("_key", "_slice", "_event", "_row")

    ends = rows.groupBy("_key", "_slice").agg(F.max_by("_row", "_at").alias("_end"))
    slices = ends.unionByName(asked.select("_key", "_slice").distinct().withColumn("_end", F.lit(None).cast(rows.schema["_row"].dataType)))
    over = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = slices.groupBy("_key", "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"))
    # Stored: Spark splits a large join partition only where both sides come straight from a shuffle.
    before = materialize(per_slice.select("_key", "_slice", F.last("_end", ignorenulls=True).over(over).alias("_before")).where("_before IS NOT NULL"))
    joined = carried.join(before, ["_key", "_slice"], "left").withColumn("_row", F.coalesce("_row", "_before"))
    return joined.select("_event.*", f"_row.{known_at}", *[f"_row.{v}" for v in values])
