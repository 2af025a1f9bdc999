"""The data behind the two interactive pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from updraft.config import ScreenConfig
from updraft.functions.wording import ALL_STATUSES
from updraft.operators import themes, views
from updraft.operators.freshness import latest_date
from updraft.operators.universe import publish
from updraft.plans.screening import screen
from updraft.sinks.price_store import PriceStore
from updraft.sinks.results import ResultStore


def screener_view(
    prices: DataFrame | PriceStore,
    universe: DataFrame,
    cfg: ScreenConfig,
    query: str = "",
    order: str = "総合順位",
    reuse: ResultStore | None = None,
    version: int = 0,
) -> DataFrame:
    """Hits under ``cfg``, searched and sorted.

    With ``reuse`` the ranked hits of a config seen before, on the same newest
    date and ``version`` of the bars, are read back instead of screened again. A
    price store brings its own version, so that no load leaves an old result in use.
    """
    if isinstance(prices, PriceStore):
        prices, version = prices.read(), prices.version()
    if reuse is None:
        hits = screen(prices, cfg)
    else:
        as_of = latest_date(prices).first()["latest"]
        hits = reuse.get_or_compute(cfg, as_of, lambda: screen(prices, cfg), version)
    return views.sort_view(views.search(publish(hits, universe), query), order)


@dataclass(frozen=True)
class ThemePage:
    dates: DataFrame
    cards: DataFrame
    rows: DataFrame
    history: DataFrame
    history_days: DataFrame
    staleness: DataFrame
    notes: DataFrame


def theme_page(
    reports: DataFrame,
    now: dt.datetime,
    date: str | None = None,
    status: str = ALL_STATUSES,
    floor_only: bool = False,
    picked: Sequence[str] | None = None,
    calendar: DataFrame | None = None,
) -> ThemePage:
    """One report date, by default the newest, with the confidence history of
    the picked themes, by default the best of that date.

    Cards count the whole report, rows only what the filters leave.
    """
    report = themes.report_of(reports, date)
    shown = themes.filter_themes(report, status, floor_only)
    history = themes.theme_history(reports)
    if picked is None:
        # At most themes.DEFAULT_THEMES names.
        picked = [r["theme"] for r in themes.top_themes(report, history).collect()]
    return ThemePage(
        dates=themes.report_dates(reports),
        cards=themes.theme_cards(report),
        rows=themes.theme_rows(shown).orderBy("rank"),
        history=themes.pivot_history(history, picked).orderBy("date"),
        history_days=themes.history_days(history),
        staleness=themes.report_staleness(reports, now, calendar),
        notes=themes.page_notes(report, shown, reports, now, calendar),
    )
