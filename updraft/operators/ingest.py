"""From vendor quotes to typed, complete price bars."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft.functions.text import without_suffix

QUOTE_FIELDS = ("Open", "Close", "Volume")
# Fixed value: the hour from which today's bar counts as final.
BAR_FINAL_HOUR = 16


def ticker_columns(columns: Sequence[str], separator: str = "|") -> dict[str, dict[str, str]]:
    """{ticker: {field: column}} of flattened two-level names ``ticker|field``.

    Tickers lacking a needed field are left out.
    """
    found: dict[str, dict[str, str]] = {}
    for column in columns:
        ticker, mark, field = column.rpartition(separator)
        if mark and field in QUOTE_FIELDS:
            found.setdefault(ticker, {})[field] = column
    return {t: f for t, f in found.items() if len(f) == len(QUOTE_FIELDS)}


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def wide_to_long(
    wide: DataFrame,
    date: str = "Date",
    tickers: Mapping[str, Mapping[str, str]] | None = None,
    single_ticker: str | None = None,
    separator: str = "|",
) -> DataFrame:
    """(code, date, open, close, volume) of a frame with columns per ticker.

    Each row is expanded in place, so nothing is shuffled. The expansion is one
    SQL text, as a thousand tickers built call by call take longer than the
    rest of the plan. A request for one
    ticker may come back with plain field names; name it in ``single_ticker``.
    """
    if tickers is None:
        tickers = ticker_columns(wide.columns, separator)
    if single_ticker is not None and not tickers:
        tickers = {single_ticker: {field: field for field in QUOTE_FIELDS}}
    if not tickers:
        raise ValueError("no ticker has all of " + ", ".join(QUOTE_FIELDS))
    quotes = [
        f"named_struct('ticker', {_literal(ticker)}, "
        + ", ".join(f"'{f.lower()}', CAST({_quoted(fields[f])} AS DOUBLE)" for f in QUOTE_FIELDS) + ")"
        for ticker, fields in tickers.items()
    ]
    long = wide.select(F.col(_quoted(date)).alias("date"), F.expr(f"inline(array({', '.join(quotes)}))"))
    return long.select(without_suffix(F.col("ticker")).alias("code"), "date", "open", "close", "volume")


def drop_incomplete(quotes: DataFrame) -> DataFrame:
    """Drop rows missing (NULL or NaN) a key, open, close or volume."""
    return quotes.dropna(subset=["code", "date", "open", "close", "volume"])


def drop_unfinished(quotes: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Before the closing hour, today's bars are still moving: leave them out."""
    now = now if isinstance(now, Column) else F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    unfinished = (F.hour(now) < BAR_FINAL_HOUR) & (F.col("date") >= F.to_date(now))
    return quotes.filter(~unfinished)


def typed_bars(quotes: DataFrame) -> DataFrame:
    """Price schema; fractional volumes are cut, not rounded."""
    kept = [c for c in quotes.columns if c not in ("code", "date", "open", "close", "volume")]
    return quotes.select(
        F.col("code").cast("string").alias("code"),
        F.col("date").cast("date").alias("date"),
        F.col("open").cast("double").alias("open"),
        F.col("close").cast("double").alias("close"),
        F.col("volume").cast("bigint").alias("volume"),
        *kept,
    )


def clean_quotes(quotes: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Complete, finished, typed bars; narrow steps only."""
    return typed_bars(drop_unfinished(drop_incomplete(quotes), now))
