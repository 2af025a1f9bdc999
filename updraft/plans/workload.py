"""Every operator as a query over the driver tables.

Each query reads whole tables; fixed dates stand in for the clock.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from updraft.config import ScreenConfig
from updraft.operators import freshness, ingest, themes, views
from updraft.operators.asof import asof_lookup
from updraft.operators.gaps import bar_gaps, bar_runs
from updraft.operators.grid import config_grid
from updraft.operators.screening import find_hits, rank_hits
from updraft.operators.sketches import codes_error, rank_error, sketched_percent_ranks
from updraft.operators.streaks import streak_lengths, streak_metrics
from updraft.operators.sweep import sweep_metrics, sweep_screen
from updraft.operators.universe import enrich, normalize_listing, normalize_universe
from updraft.operators.upsert import latest_rows, merge_batch, touched_periods
from updraft.plans import inputs
from updraft.plans.nightly import run_nightly
from updraft.plans.pages import screener_view
from updraft.plans.screening import published_screen, screen, screen_recent_first
from updraft.session import materialize, scratch_dir
from updraft.sinks import ledger
from updraft.sinks.code_sketches import CodeSketches
from updraft.sinks.load_log import LoadLog, read_adjusted, upsert_rebased
from updraft.sinks.price_store import PriceStore
from updraft.sinks.results import ResultStore, result_name, write_csv, write_parquet
from updraft.sinks.streak_state import StreakState
from updraft.sinks.theme_reports import write_theme_reports
from updraft.sources.theme_reports import malformed_cells, read_theme_reports, theme_report_dates
from updraft.sources.universe import read_listing, read_universe
from updraft.streaming.bars import bar_stream, late_rows, store_bars
from updraft.streaming.ingest import ingest_stream
from updraft.streaming.reports import ingest_reports, read_stored_reports

Query = Callable[[SparkSession, str], DataFrame]

# The driver bars are sparse, so thresholds are lower than the defaults.
LOOSE = ScreenConfig(
    streak_min=1, streak_top=2, vol_mult=1.0, vol_mult_short=1.0,
    turnover_vol_mult=1.0, turnover_vol_mult_short=1.0, min_volume=0,
)
LOOSE_AVG = replace(LOOSE, vol_mode="avg")
NO_HITS = replace(LOOSE, min_volume=1e12)
TURNOVER = replace(LOOSE, metric="turnover")
TURNOVER_AVG = replace(TURNOVER, vol_mode="avg", base_window=7, w_vol=0.3, w_rise=0.7)
TWO_TIER = replace(LOOSE, vol_mult=1.3, vol_mult_short=2.0)
LIQUID = replace(LOOSE, min_volume=25, min_turnover=40_000)
GRID = {
    "avg": LOOSE_AVG, "liquid": LIQUID, "loose": LOOSE, "turnover": TURNOVER,
    "turnover_avg": TURNOVER_AVG, "two_tier": TWO_TIER,
}

TODAY = dt.date(2001, 11, 12)
NOW = dt.datetime(2001, 11, 12, 22, 0)
GUARD_NOW = dt.datetime(1998, 6, 15, 10, 0)
THEME_NOW = dt.datetime(2024, 2, 1, 20, 0)
# From this day on the first load of a corrected price history is wrong.
CORRECTED = dt.date(1998, 1, 1)
HOLIDAYS = ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-08")
BAR_HOLIDAYS = ("1996-01-01", "1997-01-01", "1998-01-01", "1998-05-04", "1998-05-05", "2001-01-01")
# Loads of bars as (id, from, before), each on its own basis: the prices of every so many codes fall to a part.
LOADS = (
    ("first", "1990-01-01", "1999-01-01"), ("second", "1998-01-01", "2000-06-01"),
    ("third", "1997-06-01", "2001-01-01"), ("fourth", "2000-09-01", "2100-01-01"),
)
SPLITS = {"second": (3, 0.5), "third": (4, 0.25), "fourth": (5, 0.5)}
# Bars that a first load of the delta query has wrong, and the dates at which it goes on.
WRONG_CODES, WRONG_FROM = 7, dt.date(1999, 6, 1)
DELTAS = (dt.date(2000, 1, 1), dt.date(2001, 1, 1))
# Ranges of dates that cut months, lie in one, hold whole ones only, or hold nothing.
RANGES = (("1990-01-01", "2005-01-01"), ("1994-03-15", "1995-07-02"), ("1996-05-03", "1996-05-20"), ("1997-02-01", "1997-04-01"), ("2050-01-15", "2051-01-15"))
FIRST_LOAD_BEFORE = dt.date(1996, 5, 12)
# A stream of events in parts of so many days, with trades that come a part too late.
PART_DAYS, PARTS, LATE_EVERY, AGAIN_EVERY, NEXT_EVERY = 8, 4, 50, 20, 7


def _bars(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(inputs.part_month_bars(spark, sf_dir))


def _weekly(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(inputs.supplier_week_bars(spark, sf_dir))


def _themes(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(inputs.theme_reports(spark, sf_dir))


def _published(spark: SparkSession, sf_dir: str, cfg: ScreenConfig = LOOSE) -> DataFrame:
    prices = inputs.part_month_bars(spark, sf_dir)
    return published_screen(prices, inputs.part_universe(spark, sf_dir), cfg)


def _on_published(
    query: Callable[[DataFrame], DataFrame], cfg: ScreenConfig = LOOSE
) -> Query:
    return lambda spark, sf_dir: query(_published(spark, sf_dir, cfg))


def _screen_sliced(prices: DataFrame) -> DataFrame:
    """The screen with its distributed ranks forced on."""
    return rank_hits(find_hits(streak_metrics(prices, LOOSE), LOOSE), LOOSE, limit=0)


def _screen_recent_first(prices: DataFrame) -> DataFrame:
    """The screen that shuffles bars before 2001 only where it must."""
    cut = F.lit(dt.date(2001, 1, 1))
    recent, older = prices.filter(F.col("date") >= cut), prices.filter(F.col("date") < cut)
    return screen_recent_first(recent, older, LOOSE)


def _enrich_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup where the codes of one market are unknown."""
    hits = screen(inputs.part_month_bars(spark, sf_dir), LOOSE).select("code", "rank")
    known = inputs.part_universe(spark, sf_dir).filter(F.col("market").isNotNull())
    named = enrich(hits, known).withColumnRenamed("name", "name_or_code").drop("market")
    return enrich(named, known, name_fallback=False).select(
        "code", "rank", "name_or_code", "name", "market"
    )


def _report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = inputs.part_month_bars(spark, sf_dir)
    return views.report_header(screen(prices, LOOSE), prices, LOOSE, TODAY)


def _theme_page_notes(reports: DataFrame) -> DataFrame:
    report = themes.report_of(reports)
    return themes.page_notes(report, themes.filter_themes(report, floor_only=True), reports, THEME_NOW)


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a universe file: one customer code on many rows."""
    raw = inputs.table(spark, sf_dir, "orders").select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit("　")).alias("CustCode"),
        F.concat(F.col("o_orderpriority"), F.lit("  ")).alias("display_name"),
        F.col("o_orderstatus").alias("Market"), "o_orderkey",
    )
    order = F.col("o_orderkey")
    return normalize_universe(raw.select("CustCode", "display_name", "Market", "o_orderkey"), order)


def _universe_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows through a CSV file, where the last line of a code wins."""
    folder = scratch_dir(spark, "universe")
    (
        inputs.table(spark, sf_dir, "orders").orderBy("o_orderkey")
        .select(
            F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("銘柄名"),
            F.col("o_orderstatus").alias("市場"),
        )
        .write.csv(folder, header=True)
    )
    return read_universe(spark, folder)


def _results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published hits written as CSV and read back."""
    published = _published(spark, sf_dir)
    folder = f"{scratch_dir(spark, 'result')}/{result_name(LOOSE)}"
    write_csv(published, folder)
    back = spark.read.csv(folder, header=True)
    # CSV keeps no difference between an empty text and a missing one.
    typed = back.select(*[F.col(f.name).cast(f.dataType) for f in published.schema])
    return typed.fillna("", ["market"])


def _results_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two nights, where old codes keep their own last dates, and of a run without hits."""
    prices, universe = inputs.part_month_bars(spark, sf_dir), inputs.part_universe(spark, sf_dir)
    folder = scratch_dir(spark, "results")
    nights = [
        (prices.filter(F.col("date") < F.lit(CORRECTED)), LOOSE), (prices, LOOSE),
        (prices, replace(NO_HITS, metric="turnover")),
    ]
    for bars, cfg in nights:
        newest = freshness.latest_date(bars).first()["latest"]
        write_parquet(published_screen(bars, universe, cfg), folder, cfg, newest)
    return spark.read.parquet(folder)


def _first_load(prices: DataFrame) -> DataFrame:
    """The bars as a load that knew no volumes from CORRECTED on."""
    unknown = F.col("date") >= F.lit(CORRECTED)
    return prices.withColumn("volume", F.when(unknown, F.lit(0)).otherwise(F.col("volume")).cast("bigint"))


def _screen_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen through the result store, correct the bars, screen again."""
    prices = inputs.part_month_bars(spark, sf_dir).withColumn("seq", F.lit(1))
    universe, folder = inputs.part_universe(spark, sf_dir), scratch_dir(spark, "reuse")
    store, reuse = PriceStore(spark, f"{folder}/store"), ResultStore(spark, f"{folder}/results")
    store.upsert(_first_load(prices), "first", "seq")
    screener_view(store, universe, LOOSE, reuse=reuse)
    store.upsert(prices.filter(F.col("date") >= F.lit(CORRECTED)), "correction", "seq")
    return screener_view(store, universe, LOOSE, reuse=reuse)


def _nightly_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nightly run over a store that holds a wrong load already."""
    prices = inputs.part_month_bars(spark, sf_dir).withColumn("seq", F.lit(1))
    folder = scratch_dir(spark, "nightly")
    store = PriceStore(spark, f"{folder}/store")
    store.upsert(_first_load(prices), "first", "seq")
    run_nightly(store, inputs.part_universe(spark, sf_dir), f"{folder}/out", NOW, LOOSE, quotes=prices)
    return spark.read.parquet(f"{folder}/out/results").drop("metric", "data_date")


def _theme_files(query: Callable[[SparkSession, str], DataFrame]) -> Query:
    """A query over a folder of report files; those of even days know no registrations."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, reports = scratch_dir(spark, "themes"), inputs.theme_reports(spark, sf_dir)
        even = F.substring("report_date", 10, 1).cast("int") % 2 == 0
        write_theme_reports(reports.filter(~even), folder)
        write_theme_reports(reports.filter(even).drop("registered_since"), folder)
        return query(spark, folder)

    return run


def _listing_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same listing through a CSV file."""
    folder = scratch_dir(spark, "listing")
    _raw_listing(spark, sf_dir).write.csv(folder, header=True, escape='"')
    return read_listing(spark, folder)


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_listing(_raw_listing(spark, sf_dir), F.col("コード"))


def _raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as an exchange listing with domestic and other segments."""
    nation = inputs.table(spark, sf_dir, "nation")
    region = inputs.table(spark, sf_dir, "region")
    kind = F.when(F.col("r_name").isin("ASIA", "EUROPE", "AFRICA"), F.lit("（内国株式）")).otherwise(
        F.lit("(外国株式)")
    )
    return (
        inputs.table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("コード"),
            F.col("s_name").alias("銘柄名"),
            F.concat("n_name", kind).alias("市場・商品区分"),
        )
    )


def _wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = ingest.wide_to_long(inputs.brand_day_quotes(spark, sf_dir))
    return ingest.typed_bars(ingest.drop_incomplete(long))


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean_quotes(inputs.raw_quotes(spark, sf_dir), GUARD_NOW)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished lines as stored bars, open lines as the batch."""
    quotes = inputs.line_quotes(inputs.table(spark, sf_dir, "lineitem"))
    finished = quotes.filter("l_linestatus = 'F'").select(
        "code", "date", "open", "close", "volume", "seq"
    )
    stored = latest_rows(finished, ["code", "date"], [F.col("seq")]).drop("seq")
    return merge_batch(stored, quotes.filter("l_linestatus = 'O'"), "seq")


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = inputs.line_quotes(inputs.table(spark, sf_dir, "lineitem"))
    return touched_periods(quotes.filter("l_linestatus = 'O'"))


def _stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a stream, through the price store, read back."""
    folder = scratch_dir(spark, "stream")
    schema = inputs.table(spark, sf_dir, "lineitem").schema
    lines = (
        spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
        .parquet(sf_dir)
    )
    quotes = inputs.line_quotes(lines).drop("l_linestatus")
    store = PriceStore(spark, folder)
    query = ingest_stream(quotes, store, "seq", f"{folder}/checkpoint", GUARD_NOW)
    query.awaitTermination()
    return store.read()


def _notify_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as metrics: dates to announce against those announced."""
    lines = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("metric"), F.to_date("l_shipdate").alias("data_date"),
        F.col("l_shipdate").alias("sent_at"), "l_linestatus",
    )
    sent = lines.filter("l_linestatus = 'F'").drop("l_linestatus")
    candidates = lines.select("metric", "data_date").distinct()
    return ledger.pending(candidates, sent)


def _notify_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as metrics: A is sent, a run dies while it sends N, later runs go on."""
    log = ledger.SendLog(spark, scratch_dir(spark, "sends"))
    lines = inputs.table(spark, sf_dir, "lineitem")
    asked = lines.select(F.col("l_returnflag").alias("metric"), F.to_date("l_shipdate").alias("data_date"))
    log.claim(asked.where("metric = 'A'"), "first", NOW)
    log.confirm("first", NOW)
    log.claim(asked.where("metric = 'N'"), "second", NOW)
    third = log.claim(asked, "third", NOW).withColumn("attempt", F.lit("third"))
    doubted = log.in_doubt().where("attempt = 'second'").select("metric", "data_date", F.lit("doubted").alias("attempt"))
    shown = materialize(third.unionByName(doubted))
    log.release("second", NOW)
    fourth = log.claim(asked, "fourth", NOW).withColumn("attempt", F.lit("fourth"))
    return shown.unionByName(fourth)


def _codes_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and codes of ranges, from sketches refreshed by two loads, held against exact counts."""
    folder = scratch_dir(spark, "sketches")
    store = PriceStore(spark, f"{folder}/store")
    sketches = CodeSketches(store, f"{folder}/codes")
    lines = inputs.table(spark, sf_dir, "lineitem")
    bars = inputs.line_bars(lines, F.col("l_partkey"), F.to_date("l_shipdate")).withColumn("seq", F.lit(1))
    early = F.col("date") < F.lit(FIRST_LOAD_BEFORE)
    for name, load in (("first", bars.where(early)), ("second", bars.where(~early | (F.col("volume") % 2 == 0)))):
        store.upsert(load, name, "seq")
        sketches.refresh(load)

    def row(since: str, before: str) -> DataFrame:
        days = dt.date.fromisoformat(since), dt.date.fromisoformat(before)
        exact = store.read(*days).agg(F.countDistinct("code")).scalar()
        near = F.abs(F.col("estimate") - F.col("codes")) <= F.col("codes") * codes_error() + 0.5
        found = sketches.between(*days).withColumnRenamed("codes", "estimate").withColumn("codes", exact)
        return found.select(*[F.lit(d).alias(n) for d, n in zip(days, ("since", "before"), strict=True)], "from", "to", "rows", "codes", near.alias("within_bound"))

    return reduce(DataFrame.unionByName, [row(*days) for days in RANGES])


def _sketched_ranks(prices: DataFrame) -> DataFrame:
    """Exact percent ranks of each date's volumes, and whether the sketched ones are near."""
    ranked = sketched_percent_ranks(prices, {"volume": "estimate"}, ["date"])
    exact = F.percent_rank().over(Window.partitionBy("date").orderBy("volume"))
    near = F.abs(F.col("estimate") - F.col("volume_rank")) <= 2 * rank_error()
    return ranked.withColumn("volume_rank", exact).select("code", "date", "volume", "volume_rank", near.alias("within_bound"))


def _theme_files_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files that come in two lots of differing headers, each stored by a run of its own."""
    base, reports = scratch_dir(spark, "arriving"), inputs.theme_reports(spark, sf_dir)
    even = F.substring("report_date", 10, 1).cast("int") % 2 == 0
    for lot in (reports.filter(~even), reports.filter(even).drop("registered_since")):
        write_theme_reports(lot, f"{base}/in")
        ingest_reports(spark, f"{base}/in", f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return read_stored_reports(spark, f"{base}/table").drop("last_ignition")


def _theme_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with words among the numbers of every second rank and the flags of every third."""
    folder, reports = scratch_dir(spark, "malformed"), inputs.theme_reports(spark, sf_dir)
    number = F.when(F.col("rank") % 2 == 0, F.concat(F.lit("about "), "eligible_members")).otherwise(F.col("participants").cast("string"))
    flag = F.when(F.col("rank") % 3 == 0, "perhaps").otherwise(F.col("floor_pass").cast("string"))
    write_theme_reports(reports.withColumns({"participants": number, "floor_pass": flag}), folder)
    return malformed_cells(spark, folder)


def _holidays(spark: SparkSession, days: tuple[str, ...] = HOLIDAYS) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "day string")


def _adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four loads, each on the basis of its day, through the store and the load log."""
    bars, folder = inputs.supplier_week_bars(spark, sf_dir), scratch_dir(spark, "loads")
    store, log = PriceStore(spark, f"{folder}/store"), LoadLog(spark, f"{folder}/loads")
    number, basis = F.col("code").cast("long"), F.lit(1.0)
    for name, first, before in LOADS:
        if name in SPLITS:
            every, part = SPLITS[name]
            basis = basis * F.when(number % every == 0, part).otherwise(1.0)
        load = bars.where((F.col("date") >= first) & (F.col("date") < before))
        # In the last load some single bars are corrected as well, which is no change of basis.
        corrected = F.when((number % 10 == 7) & (F.col("volume") % 2 == 0), 1.25 if name == LOADS[-1][0] else 1.0).otherwise(1.0)
        batch = load.select(
            "code", "date", (F.col("open") * basis).alias("open"), (F.col("close") * basis * corrected).alias("close"),
            (F.col("volume") / basis).cast("bigint").alias("volume"), F.lit(1).alias("seq"),
        )
        upsert_rebased(store, log, batch, name, "seq")
    return read_adjusted(store, log)


def _screen_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen of a state that was built once and refreshed by a correction and two loads."""
    bars = inputs.part_month_bars(spark, sf_dir).withColumn("seq", F.lit(1))
    state = StreakState(spark, scratch_dir(spark, "state"), LOOSE.base_window)
    date, first, second = F.col("date"), *DELTAS
    wrong = (F.col("code").cast("long") % WRONG_CODES == 0) & (date >= F.lit(WRONG_FROM))
    loaded = bars.where(date < F.lit(first))
    state.rebuild(loaded.withColumn("close", F.when(wrong, F.col("close") / 2).otherwise(F.col("close"))))
    for batch, known in (
        (loaded.where(wrong), loaded),
        (bars.where((date >= F.lit(first)) & (date < F.lit(second))), bars.where(date < F.lit(second))),
        (bars.where(date >= F.lit(second)), bars),
    ):
        state.refresh(batch, "seq", lambda known=known: known.drop("seq"))
    return screen(state.read(), LOOSE)


def _day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.table(spark, sf_dir, "lineitem")
    return inputs.line_bars(lines, F.col("l_suppkey"), F.to_date("l_shipdate"))


def _on_calendar(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A query over the suppliers' daily bars and the calendar of their dates."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = inputs.table(spark, sf_dir, "lineitem")
        calendar = freshness.calendar_of(lines, F.col("l_shipdate"), _holidays(spark, BAR_HOLIDAYS), lead_days=0)
        return query(_day_bars(spark, sf_dir), calendar)

    return run


def _asof_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the last bar of its supplier whose volume is a multiple of three."""
    lines = inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("code"), F.to_date("l_shipdate").alias("shipped")
    )
    bars = inputs.supplier_week_bars(spark, sf_dir).where("volume % 3 = 0").select("code", "date", "close", "volume")
    return asof_lookup(lines, bars, "code", "shipped", "date", ["close", "volume"])


def _stream_late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades in four files: some come twice, some a file later, some too late to count."""
    folder = scratch_dir(spark, "trades")
    events = inputs.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    day = F.datediff(F.to_date("ts"), F.lit(events.agg(F.to_date(F.min("ts")).alias("d")).first()["d"]))
    part = F.least(F.floor(day / PART_DAYS), F.lit(PARTS - 1)).cast("int")
    evening = (day % PART_DAYS == PART_DAYS - 1) & (F.hour("ts") >= 18) & (part < PARTS - 1)
    late = (F.col("event_id") % LATE_EVERY == 0) & (part == 0)
    given = F.when(late, PARTS - 1).when((F.col("event_id") % NEXT_EVERY == 0) & evening, part + 1).otherwise(part)
    copies = F.when(F.col("event_id") % AGAIN_EVERY == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    trades = events.withColumn("part", given).withColumn("copy", F.explode(copies))
    for number in range(PARTS):
        trades.where(F.col("part") == number).drop("part", "copy").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    bars = bar_stream(
        arriving, code=F.col("event_type"), ts=F.col("ts"), key=F.col("event_id"), price=F.col("value"), quantity=F.lit(1), delay="1 day"
    )
    store = PriceStore(spark, f"{folder}/store")
    query = store_bars(bars, store, f"{folder}/checkpoint")
    query.awaitTermination()
    return store.read().withColumn("late_rows", F.lit(late_rows(query)).cast("bigint"))


def _latest_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events").select("event_id", "ts")
    calendar = freshness.calendar_of(events, F.col("ts"), _holidays(spark))
    weekdays = freshness.with_latest_trading_day(events, F.col("ts"), out="weekday_target")
    both = freshness.with_latest_trading_day(weekdays, F.col("ts"), calendar)
    return both.select("event_id", "weekday_target", "target_day")


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day of the calendar and the open day that reports them."""
    events = inputs.table(spark, sf_dir, "events")
    calendar = freshness.calendar_of(events, F.col("ts"), _holidays(spark), lead_days=7)
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events")
    )
    return calendar.join(daily, "day", "left").withColumn("events", F.coalesce("events", F.lit(0)))


def _planned_quotes(prices: DataFrame) -> DataFrame:
    """What a load after 1998-02-01 reads, planned per code."""
    today = dt.date(1998, 2, 10)
    plan = freshness.fetch_plan(prices.filter("date < DATE '1998-02-01'"), today, by_code=True)
    return freshness.planned_quotes(prices.select("code", "date", "close"), plan, today)


def _stale_flags(prices: DataFrame) -> DataFrame:
    latest = prices.groupBy("code").agg(F.max("date").alias("latest"))
    return freshness.with_stale_flags(latest, F.col("latest"), dt.date(2001, 10, 1))


def _theme_top(reports: DataFrame) -> DataFrame:
    return themes.top_themes(themes.report_of(reports), themes.theme_history(reports))


def _theme_pivot(reports: DataFrame) -> DataFrame:
    history = themes.theme_history(reports)
    # The picks of a chart: at most DEFAULT_THEMES names.
    picks = [r["theme"] for r in themes.top_themes(themes.report_of(reports), history).collect()]
    return themes.pivot_history(history, picks)


QUERIES: dict[str, Query] = {
    "bars_part_month": inputs.part_month_bars,
    "bars_supplier_week": inputs.supplier_week_bars,
    "streak_length": _bars(streak_lengths),
    "streak_metrics": _bars(lambda p: streak_metrics(p, LOOSE)),
    "screen_volume_all": _bars(lambda p: screen(p, LOOSE)),
    "screen_volume_avg": _weekly(lambda p: screen(p, LOOSE_AVG)),
    "screen_turnover_all": _bars(lambda p: screen(p, TURNOVER)),
    "screen_turnover_avg": _weekly(lambda p: screen(p, TURNOVER_AVG)),
    "screen_two_tier": _bars(lambda p: screen(p, TWO_TIER)),
    "screen_liquidity": _bars(lambda p: screen(p, LIQUID)),
    "screen_sliced_ranks": _bars(_screen_sliced),
    "screen_recent_first": _bars(_screen_recent_first),
    "screen_published": _published,
    "lookup_missing": _enrich_partial,
    "data_period": _bars(views.data_period),
    "row_count": _bars(views.row_count),
    "tier_counts": _bars(lambda p: views.tier_counts(screen(p, LOOSE))),
    "view_search": _on_published(lambda r: views.search(r, " GE|^1.*7$ ")),
    "view_sort_rise": _on_published(lambda r: views.sort_view(r, "上昇率が高い順")),
    "report_rows": _on_published(lambda r: views.report_rows(r, LOOSE)),
    "report_rows_turnover": _on_published(lambda r: views.report_rows(r, TURNOVER), TURNOVER),
    "report_header": _report_header,
    "report_captions": _on_published(lambda r: views.report_captions(r, LOOSE)),
    "report_captions_no_hits": lambda spark, sf_dir: views.report_captions(
        _published(spark, sf_dir, NO_HITS), NO_HITS
    ),
    "results_csv": _results_csv,
    "notify_top20": _on_published(lambda r: views.notification_rows(r, LOOSE)),
    "notify_payload": _on_published(
        lambda r: views.notification_payload(r, LOOSE, "2001-11-12 22:00")
    ),
    "notify_no_hits": lambda spark, sf_dir: views.notification_payload(
        _published(spark, sf_dir, NO_HITS), NO_HITS, "2001-11-12 22:00"
    ),
    "results_history": _results_history,
    "screen_reused": _screen_reused,
    "nightly_published": _nightly_published,
    "universe_normalize": _universe,
    "universe_csv": _universe_csv,
    "listing_normalize": _listing,
    "listing_csv": _listing_csv,
    "wide_to_long": _wide_to_long,
    "ingest_guard": _guarded,
    "upsert_latest": _upsert,
    "upsert_touched": _touched,
    "stream_upsert": _stream_upsert,
    "adjusted_bars": _adjusted_bars,
    "screen_delta": _screen_delta,
    "stream_late_bars": _stream_late_bars,
    "bar_gaps": _on_calendar(bar_gaps),
    "bar_runs": _on_calendar(bar_runs),
    "asof_bars": _asof_bars,
    "notify_ledger": _notify_ledger,
    "notify_intents": _notify_intents,
    "codes_by_range": _codes_by_range,
    "sketched_ranks": _bars(_sketched_ranks),
    "fetch_plan": _weekly(lambda p: freshness.fetch_plan(p, TODAY)),
    "fetch_plan_by_code": _bars(lambda p: freshness.fetch_plan(p, TODAY, by_code=True)),
    "planned_quotes": _bars(_planned_quotes),
    "latest_trading_day": _latest_trading_day,
    "trading_calendar": _calendar,
    "data_freshness": _weekly(lambda p: freshness.data_freshness(p, NOW)),
    "freshness_by_code": _weekly(
        lambda p: freshness.data_freshness(p, dt.datetime(2001, 10, 23, 9, 0), by_code=True)
    ),
    "stale_flags": _bars(_stale_flags),
    "theme_dates": _themes(themes.report_dates),
    "theme_history": _themes(themes.theme_history),
    "theme_days": _themes(lambda r: themes.history_days(themes.theme_history(r))),
    "theme_names": _themes(lambda r: themes.history_themes(themes.theme_history(r))),
    "theme_cards": _themes(lambda r: themes.theme_cards(r, ["report_date"])),
    "theme_filter": _themes(
        lambda r: themes.filter_themes(r, "監視中", floor_only=True).select(
            "report_date", "theme", "status", "floor_pass"
        )
    ),
    "theme_scaled": _themes(
        lambda r: themes.with_confidence_width(themes.report_of(r)).select("theme", "width")
    ),
    "theme_labels": _themes(themes.theme_rows),
    "theme_top5": _themes(_theme_top),
    "theme_pivot": _themes(_theme_pivot),
    "theme_files_dates": _theme_files(theme_report_dates),
    "theme_files_report": _theme_files(
        lambda spark, folder: read_theme_reports(spark, folder).drop("last_ignition")
    ),
    "theme_files_history": _theme_files(
        lambda spark, folder: themes.theme_history(read_theme_reports(spark, folder))
    ),
    "theme_files_stored": _theme_files_stored,
    "theme_malformed": _theme_malformed,
    "theme_page_notes": _themes(_theme_page_notes),
    "theme_stale": _themes(lambda r: themes.report_staleness(r, THEME_NOW)),
    "sweep_metrics": _bars(lambda p: sweep_metrics(p, LOOSE).drop("next_date")),
    "sweep_screen": _bars(lambda p: sweep_screen(p, TWO_TIER)),
    "sweep_screen_turnover": _weekly(lambda p: sweep_screen(p, TURNOVER_AVG)),
    "sweep_carry_forward": _weekly(lambda p: sweep_screen(p, LOOSE, carry_forward=True)),
    "config_grid": _bars(lambda p: config_grid(p, GRID)),
}
