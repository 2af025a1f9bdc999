"""The universe: names and markets of codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft.functions import wording as say
from updraft.functions.text import before_bracket, missing_to_null, strip
from updraft.operators.upsert import latest_rows

PUBLISHED_COLUMNS = (
    "rank", "code", "name", "market", "streak_len", "tier", "last_date", "last_close",
    "rise_pct", "avg_vol3", "min_vol3", "base_med", "avg_ratio", "min_ratio", "score",
)


def _first(columns: Iterable[str], *parts: str) -> str | None:
    """First column whose lower-cased name contains one of ``parts``."""
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def normalize_universe(raw: DataFrame, order: Column) -> DataFrame:
    """(code, name, market) from a table whose columns are found by name.

    All columns must be strings. Without a name column the code is the name,
    without a market column the market is empty; of rows sharing a code the
    last by ``order`` wins.
    """
    columns = [c for c in raw.columns if not c.startswith("_")]
    code = _first(columns, "code", "コード")
    name = _first(columns, "name", "銘柄")
    market = _first(columns, "市場", "market")
    if code is None:
        raise ValueError("no column name contains 'code' or 'コード'")

    def cell(column: str) -> Column:
        return strip(missing_to_null(F.col(f"`{column}`")))

    listed = raw.select(
        cell(code).alias("code"),
        cell(name or code).alias("name"),
        (cell(market) if market else F.lit("")).alias("market"),
        order.alias("_order"),
    ).filter(F.col("code").isNotNull())
    return latest_rows(listed, ["code"], [F.col("_order")]).drop("_order")


def normalize_listing(
    listing: DataFrame,
    order: Column,
    *,
    code: str = "コード",
    name: str = "銘柄名",
    segment: str = "市場・商品区分",
) -> DataFrame:
    """(code, name, market) of the domestic shares in an exchange listing.

    The market is the segment's text before its bracket.
    """
    domestic = listing.filter(F.col(f"`{segment}`").contains(say.DOMESTIC_SHARES)).select(
        strip(F.col(f"`{code}`")).alias("code"),
        strip(F.col(f"`{name}`")).alias("name"),
        before_bracket(F.col(f"`{segment}`")).alias("market"),
        order.alias("_order"),
    )
    return latest_rows(domestic, ["code"], [F.col("_order")]).drop("_order")


def enrich(hits: DataFrame, universe: DataFrame, name_fallback: bool = True) -> DataFrame:
    """Left lookup of name and market by code.

    An unknown code is named by itself, or NULL without ``name_fallback``; an
    unknown market is empty. No broadcast hint: the universe grows with the
    data, so Spark decides by its measured size.
    """
    dimension = universe.select("code", "name", "market")
    name = F.coalesce("name", "code") if name_fallback else F.col("name")
    return hits.join(dimension, "code", "left").withColumns(
        {"name": name, "market": F.coalesce("market", F.lit(""))}
    )


def publish(hits: DataFrame, universe: DataFrame, name_fallback: bool = True) -> DataFrame:
    """Screen result with names, in the published column order."""
    return enrich(hits, universe, name_fallback).select(*PUBLISHED_COLUMNS)
