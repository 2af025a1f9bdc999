"""Display texts and bands of the report, the notification and the theme table.

``format_number`` is used throughout: it rounds a double by its exact value,
halves to even, which is also how the expected texts were produced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from updraft.config import MetricInfo
from updraft.functions import wording as say


def grouped(value: Column, digits: int = 0) -> Column:
    """Fixed decimals with thousands separators: 12,345.6"""
    return F.format_number(value, digits)


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals without separators: 12345.60"""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def signed(value: Column, digits: int) -> Column:
    """Like ``fixed`` with an explicit plus sign for values not below zero."""
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("")), fixed(value, digits))


def metric_text(value: Column, info: MetricInfo, with_unit: bool = False) -> Column:
    """Turnover in millions with one decimal, volume as a whole number."""
    if info.div > 1:
        text = grouped(value.cast("double") / F.lit(float(info.div)), 1)
    else:
        text = grouped(value.cast("bigint"), 0)
    return F.concat(text, F.lit(info.unit)) if with_unit else text


def pick(value: Column, texts: dict, otherwise: str, contains: bool = False) -> Column:
    """The text of the first key equal to, or contained in, ``value``."""
    chosen = F.lit(otherwise)
    for key, text in reversed(texts.items()):
        found = value.contains(key) if contains else value == key
        chosen = F.when(found, F.lit(text)).otherwise(chosen)
    return chosen


def market_class(market: Column, otherwise: str = "") -> Column:
    return pick(market, say.MARKET_CLASSES, otherwise, contains=True)


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 0.8, F.lit("high"))
        .when(score >= 0.5, F.lit("mid"))
        .otherwise(F.lit("low"))
    )


def rank_badge(rank: Column) -> Column:
    return F.when(rank <= 3, rank.cast("string")).otherwise(F.lit("other"))


def medal(rank: Column) -> Column:
    return pick(rank, say.MEDALS, say.NO_MEDAL)


def tier_mark(tier: Column) -> Column:
    return pick(tier, say.TIER_MARKS, say.TIER_MARKS[2])


def tier_class(tier: Column) -> Column:
    return F.when(tier == 1, F.lit("top")).otherwise(F.lit("short"))


def streak_text(streak_len: Column) -> Column:
    return F.concat(streak_len.cast("string"), F.lit(say.STREAK_SUFFIX))


def theme_status(status: Column, ignition: Column) -> Column:
    """The day's ignition event outranks the standing status."""
    event = F.when(ignition != "", ignition).when(status == say.IGNITED, status)
    standing = F.when(status.isin(say.WATCHED, say.STALLED), status)
    return F.coalesce(F.concat(F.lit(say.IGNITION_MARK), event), standing, F.lit(say.OUT_OF_RANGE))


def theme_stage(stage: Column) -> Column:
    return F.when(theme_stage_class(stage) != "none", stage).otherwise(F.lit(say.NONE_MARK))


def theme_stage_class(stage: Column) -> Column:
    return pick(stage, say.STAGE_CLASSES, "none", contains=True)
