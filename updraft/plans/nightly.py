"""The nightly run: ingest, screen, publish, notify."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.config import ScreenConfig
from updraft.operators import views
from updraft.operators.freshness import with_stale_flags
from updraft.operators.ingest import clean_quotes
from updraft.operators.universe import publish
from updraft.plans.screening import screen, screen_recent_first
from updraft.session import materialize
from updraft.sinks import ledger, results
from updraft.sinks.price_store import PriceStore


@dataclass(frozen=True)
class NightlyRun:
    """What a run produced: tables, the newest data date, and two flags."""

    published: DataFrame
    header: DataFrame
    report: DataFrame
    latest: dt.date | None
    is_current: bool
    notified: bool


def run_nightly(
    store: PriceStore,
    universe: DataFrame,
    out_dir: str,
    now: dt.datetime,
    cfg: ScreenConfig | None = None,
    *,
    quotes: DataFrame | None = None,
    batch_id: str | None = None,
    sequence: str = "seq",
    lookback_days: int | None = None,
    send: Callable[[str], bool] | None = None,
    force: bool = False,
) -> NightlyRun:
    """Ingest ``quotes`` if given, screen the stored bars, write the results.

    With ``lookback_days`` bars older than that are shuffled only for codes
    that need them; results are the same.

    ``send`` gets the notification as JSON and tells whether it was delivered;
    it is called once per metric and data date unless forced, and only a
    delivered notification is recorded. ``is_current`` says whether jobs that
    need today's data may follow.
    """
    cfg = cfg or ScreenConfig()
    spark = store.spark
    if quotes is not None:
        store.upsert(clean_quotes(quotes, now), batch_id or now.isoformat(), sequence)

    prices = store.read()
    if lookback_days is None:
        hits = screen(prices, cfg)
    else:
        cut = now.date() - dt.timedelta(days=lookback_days)
        hits = screen_recent_first(store.read(since=cut), store.read(before=cut), cfg)
    published = materialize(publish(hits, universe, name_fallback=False).orderBy("rank"))
    header = materialize(views.report_header(published, prices, cfg, now.date()))
    report = views.report_rows(published, cfg)

    results.write_csv(published, f"{out_dir}/{results.result_name(cfg)}")
    report.write.mode("overwrite").parquet(f"{out_dir}/report_{cfg.metric}")

    # One summary row.
    top = with_stale_flags(header.drop("stale_note"), F.col("to"), now.date()).first()
    if top["to"] is not None:
        results.write_parquet(published, f"{out_dir}/results", cfg, top["to"])
    notified = False
    if send is not None:
        dated = spark.createDataFrame([(cfg.metric, top["to"])], "metric string, data_date date")
        sent_path = f"{out_dir}/sent"
        if ledger.pending(dated, ledger.read_ledger(spark, sent_path), force).count():
            payload = views.notification_payload(
                published, cfg, f"{now:%Y-%m-%d %H:%M}", top["stale_note"]
            )
            notified = send(payload.first()["payload"])
            if notified:
                ledger.record_sent(dated, sent_path, now)
    return NightlyRun(published, header, report, top["to"], top["is_current"], notified)
