"""Theme reports: cards, filters, labels, history and its pivot.

A report is one frame per report date; several dates may sit in one frame,
told apart by ``report_date``. NULL flags count as false everywhere.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from updraft.functions import labels
from updraft.functions import wording as say
from updraft.operators.freshness import moment, with_latest_trading_day

# Fixed value: the number of themes a history chart starts with.
DEFAULT_THEMES = 5

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("theme", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("ignition", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("participants", T.IntegerType()),
        T.StructField("eligible_members", T.IntegerType()),
        T.StructField("participation_rate", T.DoubleType()),
        T.StructField("concentration", T.DoubleType()),
        T.StructField("turnover_anomaly", T.DoubleType()),
        T.StructField("mkt_rel_z", T.DoubleType()),
        T.StructField("breadth_z", T.DoubleType()),
        T.StructField("floor_pass", T.BooleanType()),
        T.StructField("small_universe", T.BooleanType()),
        T.StructField("top_contributors", T.StringType()),
        T.StructField("registered_since", T.StringType()),
        T.StructField("last_ignition", T.StringType()),
    ]
)


def _true(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def report_dates(reports: DataFrame) -> DataFrame:
    """Dates with a report, newest first."""
    return reports.select("report_date").distinct().orderBy(F.col("report_date").desc())


def report_of(reports: DataFrame, date: str | dt.date | None = None) -> DataFrame:
    """One day's report; the newest without a date."""
    if date is None:
        newest = reports.agg(F.max("report_date").alias("newest"))
        return reports.filter(F.col("report_date") == newest.scalar())
    return reports.filter(F.col("report_date") == F.lit(str(date)))


def theme_cards(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts above the table: ignitions, S2 stages, stalls, floor passes, all."""
    counts = [
        F.count_if(F.col("ignition").isNotNull() | (F.col("status") == say.IGNITED)).alias("ignitions"),
        F.count_if(F.col("stage").contains("S2")).alias("stage2"),
        F.count_if(F.col("status") == say.STALLED).alias("stalled"),
        F.count_if(_true("floor_pass")).alias("floor_passes"),
        F.count(F.lit(1)).alias("themes"),
    ]
    return report.groupBy(*by).agg(*counts)


def filter_themes(
    report: DataFrame, status: str = say.ALL_STATUSES, floor_only: bool = False
) -> DataFrame:
    if status != say.ALL_STATUSES:
        report = report.filter(F.col("status") == status)
    if floor_only:
        report = report.filter(_true("floor_pass"))
    return report


def with_confidence_width(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``width``: confidence scaled to 0..100 over the report, NaN left out of the bounds.

    With ``by`` each group, such as one report date, has bounds of its own from a
    window. Else they are a one-row aggregate read as a scalar; no join is planned.
    """
    known = F.when(~F.isnan("confidence"), F.col("confidence"))
    low, high = F.min(known), F.max(known)
    if by:
        group = Window.partitionBy(*by)
        bounds = F.struct(low.over(group).alias("low"), high.over(group).alias("high"))
    else:
        bounds = report.agg(F.struct(low.alias("low"), high.alias("high"))).scalar()
    scaled = report.withColumn("_bounds", bounds)
    span = F.col("_bounds.high") - F.col("_bounds.low")
    span = F.when(span == 0, F.lit(1.0)).otherwise(span)
    return scaled.withColumn(
        "width", (F.col("confidence") - F.col("_bounds.low")) / span * 100
    ).drop("_bounds")


def theme_rows(report: DataFrame) -> DataFrame:
    """The reports as display texts, one row per theme, each report scaled by itself.

    ``report_date`` comes first where ``report`` has it.
    """
    by = [c for c in ("report_date",) if c in report.columns]
    none = F.lit(say.NONE_MARK)
    tip = F.concat(
        F.lit(say.TIP_PARTICIPATION), labels.fixed(F.col("participation_rate") * 100, 1),
        F.lit(say.TIP_CONCENTRATION), labels.fixed(F.col("concentration"), 2),
        F.lit(say.TIP_REGISTERED), F.coalesce("registered_since", none),
        F.lit(say.TIP_IGNITED), F.coalesce("last_ignition", none),
    )
    return with_confidence_width(report, by).select(
        *by, "rank", labels.rank_badge(F.col("rank")).alias("badge"), "theme",
        F.when(_true("small_universe"), F.lit(say.SMALL_UNIVERSE)).otherwise(F.lit("")).alias("warning"),
        labels.theme_status(F.col("status"), F.col("ignition")).alias("status"),
        labels.theme_stage(F.col("stage")).alias("stage"),
        labels.theme_stage_class(F.col("stage")).alias("stage_class"),
        F.concat(labels.fixed(F.col("width"), 0), F.lit("%")).alias("width"),
        (F.col("confidence") < 0).alias("negative"),
        labels.signed(F.col("confidence"), 2).alias("confidence"),
        F.concat_ws("/", F.col("participants").cast("string"),
                    F.concat(F.col("eligible_members").cast("string"), F.lit(say.MEMBER_UNIT)))
        .alias("participation"),
        labels.signed(F.col("turnover_anomaly"), 2).alias("turnover_anomaly"),
        labels.signed(F.col("mkt_rel_z"), 2).alias("mkt_rel_z"),
        labels.signed(F.col("breadth_z"), 2).alias("breadth_z"),
        F.when(_true("floor_pass"), F.lit(say.PASS_MARK)).otherwise(none).alias("floor"),
        F.coalesce("top_contributors", F.lit("")).alias("contributors"),
        tip.alias("tip"),
    )


def theme_history(reports: DataFrame) -> DataFrame:
    """(date, theme, confidence) over all reports by date; reads two report columns."""
    columns = reports.select(F.col("report_date").alias("date"), "theme", "confidence")
    return columns.orderBy("date")


def history_themes(history: DataFrame) -> DataFrame:
    return history.select("theme").distinct().orderBy("theme")


def history_days(history: DataFrame) -> DataFrame:
    return history.agg(F.countDistinct("date").alias("days"))


def top_themes(report: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(rank, theme) of the best themes, with ``history`` only those it knows.

    Themes missing from the history are not replaced by the next ones.
    """
    top = report.orderBy("rank", "theme").limit(DEFAULT_THEMES).select("rank", "theme")
    if history is None:
        return top
    return top.join(history.select("theme"), "theme", "left_semi").select("rank", "theme")


def pivot_history(history: DataFrame, themes: Sequence[str]) -> DataFrame:
    """Mean confidence per date, one column per picked theme.

    Only picked themes are read, and naming them spares Spark the pass that
    would look for pivot values.
    """
    picked = sorted(themes)
    return (
        history.filter(F.col("theme").isin(picked))
        .groupBy("date").pivot("theme", picked).agg(F.avg("confidence"))
    )


def report_staleness(
    reports: DataFrame, now: dt.datetime | Column, calendar: DataFrame | None = None
) -> DataFrame:
    """(newest, target_day, is_stale): is a newer report due at ``now``?"""
    newest = reports.agg(F.max("report_date").alias("newest"))
    return with_latest_trading_day(newest, moment(now), calendar).withColumn(
        "is_stale", F.date_format("target_day", "yyyy-MM-dd") > F.col("newest")
    )


def page_notes(
    report: DataFrame, shown: DataFrame, reports: DataFrame,
    now: dt.datetime | Column, calendar: DataFrame | None = None,
) -> DataFrame:
    """One row of texts around the report of one date, of which ``shown`` is what the filters leave.

    ``stale_note`` is empty unless the report is the newest and a newer one is due,
    ``shown_note`` unless themes are left out, ``message`` unless none is left.
    ``file_name`` names the export of the whole report; without rows there is none.
    """
    # One-row summaries, read as scalars instead of joined.
    left = shown.agg(F.count(F.lit(1))).scalar()
    newest = report_staleness(reports, now, calendar)
    state = newest.select(F.struct("newest", "target_day", "is_stale").alias("state")).scalar()
    summary = report.agg(F.max("report_date").alias("_date"), F.count(F.lit(1)).alias("themes"))
    summary = summary.withColumns({"shown": left, "_state": state})
    stale = F.lit(say.STALE_REPORT_NOTE)
    due = F.date_format("_state.target_day", "yyyy-MM-dd")
    for name, date in (("{latest}", F.col("_date")), ("{due}", due)):
        stale = F.replace(stale, F.lit(name), date)
    count = F.concat(
        F.lit(say.SHOWN_THEMES), F.col("shown").cast("string"), F.lit(say.SHOWN_OF),
        F.col("themes").cast("string"), F.lit(say.THEME_UNIT),
    )
    is_due = (F.col("_date") == F.col("_state.newest")) & F.col("_state.is_stale")
    return summary.select(
        F.col("_date").alias("report_date"), "themes", "shown",
        F.when(is_due, stale).otherwise(F.lit("")).alias("stale_note"),
        F.when(F.col("shown") != F.col("themes"), count).otherwise(F.lit("")).alias("shown_note"),
        F.when(F.col("shown") == 0, F.lit(say.NO_THEMES)).otherwise(F.lit("")).alias("message"),
        F.replace(F.lit(say.REPORT_FILE), F.lit("{date}"), F.col("_date")).alias("file_name"),
    )
