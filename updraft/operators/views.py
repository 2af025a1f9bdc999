"""Summaries, views, report rows and notification rows of a screen result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft.config import ScreenConfig, metric_info
from updraft.functions import labels
from updraft.functions import wording as say
from updraft.functions.text import matches
from updraft.operators.freshness import stale_note

# Fixed value: the number of hits a notification lists.
NOTIFY_TOP = 20


def data_period(prices: DataFrame) -> DataFrame:
    """One row: first and last date and the number of codes."""
    return prices.agg(
        F.min("date").alias("from"), F.max("date").alias("to"),
        F.countDistinct("code").alias("codes"),
    )


def row_count(prices: DataFrame) -> DataFrame:
    return prices.agg(F.count(F.lit(1)).alias("rows"))


def tier_counts(hits: DataFrame) -> DataFrame:
    """(tier, hits) for both tiers, a tier without hits included."""
    counted = hits.agg(
        F.count_if(F.col("tier") == 1).alias("one"), F.count_if(F.col("tier") == 2).alias("two")
    )
    pairs = F.array(
        F.struct(F.lit(1).alias("tier"), F.col("one").alias("hits")),
        F.struct(F.lit(2).alias("tier"), F.col("two").alias("hits")),
    )
    return counted.select(F.inline(pairs))


def search(hits: DataFrame, query: str) -> DataFrame:
    """Hits whose code or name matches the query."""
    return hits.filter(matches(query, F.col("code"), F.col("name")))


def sort_view(hits: DataFrame, order: str = "総合順位") -> DataFrame:
    """One of ``say.VIEW_ORDERS``, by label or column; equal values go by rank."""
    by_column = {column: (column, ascending) for column, ascending in say.VIEW_ORDERS.values()}
    if order not in say.VIEW_ORDERS and order not in by_column:
        raise ValueError(f"unknown view order {order!r}")
    column, ascending = say.VIEW_ORDERS.get(order) or by_column[order]
    first = F.col(column).asc() if ascending else F.col(column).desc_nulls_last()
    return hits.orderBy(first, "rank")


def report_rows(hits: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Published hits as report texts and bands, one row per hit."""
    info = metric_info(cfg)
    unit_text = lambda name: labels.metric_text(F.col(name), info, with_unit=True)
    tip = F.concat(
        F.lit(f"{say.TIP_AVERAGE}{info.label} "), unit_text("avg_vol3"),
        F.lit(say.TIP_LOWEST), unit_text("min_vol3"),
        F.lit(say.TIP_BASE), unit_text("base_med"),
    )
    return hits.select(
        "rank", labels.rank_badge(F.col("rank")).alias("badge"), "code", "name", "market",
        labels.market_class(F.col("market")).alias("market_class"),
        labels.market_class(F.col("market"), "growth").alias("market_chip"),
        labels.streak_text(F.col("streak_len")).alias("streak"),
        labels.tier_class(F.col("tier")).alias("streak_class"),
        labels.grouped(F.col("last_close")).alias("close"),
        F.concat(F.lit(say.RISE_MARK), labels.fixed(F.col("rise_pct"), 2), F.lit("%")).alias("rise"),
        labels.metric_text(F.col("avg_vol3"), info).alias("streak_avg"),
        labels.metric_text(F.col("min_vol3"), info).alias("streak_min"),
        labels.metric_text(F.col("base_med"), info).alias("base"),
        F.concat(labels.fixed(F.col("avg_ratio"), 2), F.lit("x")).alias("avg_times"),
        F.concat(labels.fixed(F.col("min_ratio"), 2), F.lit("x")).alias("min_times"),
        labels.fixed(F.col("score"), 3).alias("score"),
        labels.score_band(F.col("score")).alias("score_band"),
        F.concat(labels.fixed(F.col("score") * 100, 0), F.lit("%")).alias("score_width"),
        tip.alias("tip"),
    )


def report_header(
    hits: DataFrame, prices: DataFrame, cfg: ScreenConfig, today: dt.date | Column
) -> DataFrame:
    """One row above the report: counts, base date, data period and notes.

    The base date is that of the first hit; without hits it reads N/A and
    ``message`` says so.
    """
    info = metric_info(cfg)
    summary = hits.agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("tier") == 1).alias("tier1"),
        F.count_if(F.col("tier") == 2).alias("tier2"),
        F.min_by("last_date", "rank").alias("_base"),
    )
    # One-row summaries, read as scalars instead of joined.
    period = data_period(prices).select(F.struct("from", "to", "codes").alias("period")).scalar()
    return summary.withColumn("_period", period).select(
        "hits", "tier1", "tier2",
        F.coalesce(F.date_format("_base", "yyyy-MM-dd"), F.lit("N/A")).alias("base_date"),
        F.col("_period.from").alias("from"), F.col("_period.to").alias("to"),
        F.col("_period.codes").alias("codes"),
        F.lit(say.MODE.format(label=info.label, vol_mode=cfg.vol_mode)).alias("mode"),
        F.when(F.col("hits") == 0, F.lit(say.NO_HITS)).otherwise(F.lit("")).alias("message"),
        stale_note(F.col("_period.to"), today).alias("stale_note"),
    )


def report_captions(hits: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """One row: what each tier asks for, and how to go on where there are no hits."""
    info = metric_info(cfg)
    tiers = (
        (say.TIER1_CAPTION, cfg.streak_top, info.mult, "tier1_caption"),
        (say.TIER2_CAPTION, cfg.streak_min, info.mult_short, "tier2_caption"),
    )
    return hits.agg(F.count(F.lit(1)).alias("hits")).select(
        "hits",
        *(F.lit(text.format(days=days, mult=mult)).alias(name) for text, days, mult, name in tiers),
        F.when(F.col("hits") == 0, F.lit(say.NO_HITS_PAGE)).otherwise(F.lit("")).alias("message"),
    )


def notification_rows(hits: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """The first hits by rank as notification texts."""
    info = metric_info(cfg)
    title = F.concat(
        labels.medal(F.col("rank")), F.lit(" "), F.col("rank").cast("string"),
        F.lit(say.RANK_SUFFIX + " "), F.col("code"), F.lit(" "), F.coalesce("name", F.lit("nan")),
        F.lit(" ("), F.coalesce("market", F.lit("")), F.lit(")"),
    )
    streak = F.concat(
        labels.tier_mark(F.col("tier")), F.lit(" "), labels.streak_text(F.col("streak_len"))
    )
    rise = F.concat(
        F.lit(say.NOTICE_RISE), labels.fixed(F.col("rise_pct"), 2), F.lit(say.NOTICE_RISE_END)
    )
    times = F.concat(
        F.lit(say.NOTICE_RATIO.format(label=info.label)), labels.fixed(F.col("avg_ratio"), 1),
        F.lit(say.NOTICE_RATIO_END),
    )
    body = F.concat_ws("\n", streak, rise, times)
    top = hits.orderBy("rank").limit(NOTIFY_TOP)
    return top.select("rank", title.alias("title"), body.alias("body"))


def notification_payload(
    hits: DataFrame, cfg: ScreenConfig, run_time: str, note: str = ""
) -> DataFrame:
    """One row with the JSON message: the listed hits, or the no-hits text."""
    info = metric_info(cfg)
    opening = {"run_time": run_time, "note": say.NOTE_LINE.format(note=note) if note else ""}
    head, no_hits = (t.format(**opening) for t in (say.NOTICE_TIME, say.NOTICE_NO_HITS_TITLE))
    field = F.struct(
        F.col("title").alias("name"), F.col("body").alias("value"), F.lit(False).alias("inline")
    )
    # At most NOTIFY_TOP fields are gathered.
    listed = notification_rows(hits, cfg).agg(
        F.array_sort(F.collect_list(F.struct("rank", field.alias("field")))).alias("listed")
    )
    total = hits.agg(F.count(F.lit(1))).scalar()
    embed = F.struct(
        F.lit(say.NOTICE_TITLE.format(label=info.label, top=NOTIFY_TOP)).alias("title"),
        F.concat(
            F.lit(f"{head}\n{say.NOTICE_COUNT}"), F.col("_total").cast("string"),
            F.lit(say.NOTICE_COUNT_UNIT),
        ).alias("description"),
        F.transform("listed", lambda item: item["field"]).alias("fields"),
    )
    empty = F.size("listed") == 0
    message = F.struct(
        F.when(empty, F.lit(f"{no_hits}\n{say.NOTICE_NO_HITS}")).alias("content"),
        F.when(~empty, F.array(embed)).alias("embeds"),
    )
    return listed.withColumn("_total", total).select(F.to_json(message).alias("payload"))
