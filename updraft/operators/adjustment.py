"""Bars loaded on different adjustment bases, brought to the newest one.

A vendor that adjusts history for a split gives prices on today's basis. An incremental load
re-reads a few days and leaves older bars as they were, so the store mixes bases. The
re-read overlap tells by how much: there the same bars are known on both.

A load is ``(load, code, start, factor)``: from ``start`` on it brought bars of the code, at
``factor`` times the prices before. Stored bars are kept as loaded and adjusted when read:
a bar takes the factors of all loads after the last one that brought it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.functions.numeric import to_bigint
from updraft.sources.prices import PRICE_COLUMNS

LOAD_SCHEMA = "load bigint, code string, start date, factor double"
# Vendors round prices, so ratios this close to each other, or to one, are the same.
TOLERANCE = 0.005


def overlap_factors(stored: DataFrame, batch: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(code, start, factor, bars) of each code of ``batch``, against what is stored.

    Both hold one row per (code, date), ``stored`` on one basis. The factor is the median ratio of
    the closes of bars known to both. It is one where nothing overlaps, where the ratio
    is one within ``tolerance``, and where ratios differ by more: then single bars were
    corrected, not the basis. One exchange, of the overlap's columns alone.
    """
    none = F.lit(None).cast("double")
    both = stored.select("code", "date", F.col("close").alias("_old"), none.alias("_new"), F.lit(False).alias("_in")).unionByName(
        batch.select("code", "date", none.alias("_old"), F.col("close").alias("_new"), F.lit(True).alias("_in"))
    )
    bars = both.repartition("code").groupBy("code", "date").agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"), F.bool_or("_in").alias("_in"))
    ratio = F.when((F.col("_old") > 0) & (F.col("_new") > 0), F.col("_new") / F.col("_old"))
    codes = bars.where("_in").withColumn("_ratio", ratio).groupBy("code").agg(
        F.min("date").alias("start"), F.median("_ratio").alias("_median"), F.count("_ratio").alias("bars"),
        (F.max("_ratio") - F.min("_ratio")).alias("_spread"),
    )
    moved = (F.abs(F.col("_median") - 1) > tolerance) & (F.col("_spread") <= tolerance * F.col("_median"))
    return codes.select("code", "start", F.when(moved, F.col("_median")).otherwise(1.0).alias("factor"), "bars")


def reaching(loads: DataFrame) -> DataFrame:
    """(code, date, factor): each load that changed a basis, and the first date it does not reach.

    A bar that a later load brought again is on that load's basis already, so a
    load reaches back from the earliest start of itself and all later ones.
    """
    later = Window.partitionBy("code").orderBy(F.col("load").desc())
    reach = loads.withColumn("date", F.min("start").over(later))
    return reach.where("factor <> 1").select("code", "date", "factor")


def cumulative_factor() -> Column:
    """Product of the factors dated after a bar, of rows (code, date, _event, _factor)."""
    # Events of a bar's own date come after the bar, as they reach older bars only.
    newest_first = Window.partitionBy("code").orderBy(F.col("date").desc(), F.col("_event").asc())
    return F.product("_factor").over(newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def adjusted_bars(bars: DataFrame, loads: DataFrame) -> DataFrame:
    """``bars`` on the basis of the newest load: prices times the factors, volumes divided by them.

    A reverse cumulative product per code over bars and changes together: no join, and the
    exchange by code serves a screen of the result as well.
    """
    values = [c for c in PRICE_COLUMNS if c not in ("code", "date")]
    rows = bars.select(*PRICE_COLUMNS, F.lit(0).alias("_event"), F.lit(1.0).alias("_factor"))
    changes = reaching(loads).select(
        "code", "date", *[F.lit(None).cast(bars.schema[c].dataType).alias(c) for c in values], F.lit(1).alias("_event"), F.col("factor").alias("_factor")
    )
    whole = rows.unionByName(changes).withColumn("_product", cumulative_factor()).where("_event = 0")
    return whole.select(
        "code", "date", (F.col("open") * F.col("_product")).alias("open"), (F.col("close") * F.col("_product")).alias("close"),
        F.when(F.col("_product") == 1, F.col("volume")).otherwise(to_bigint(F.col("volume") / F.col("_product"))).alias("volume"),
    )
