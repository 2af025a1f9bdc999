"""Text helpers: trimming, search, prefix handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts a CSV cell may hold to mean "missing" (checked before
# trimming, exact match).
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Whitespace at either end, the full-width space included.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, _EDGE_SPACE, "")


def missing_to_null(value: Column) -> Column:
    return F.when(~value.isin(*MISSING_MARKERS), value)


def before_bracket(value: Column) -> Column:
    """Text before the first opening bracket, half or full width."""
    return strip(F.regexp_replace(value, r"(?s)[（(].*$", ""))


def without_suffix(ticker: Column) -> Column:
    """A vendor ticker without its two-character exchange suffix."""
    return F.substring(ticker, F.lit(1), F.length(ticker) - 2)


def matches(query: str, *columns: Column) -> Column:
    """Case-insensitive regular-expression search in any of ``columns``.

    The query is trimmed; a blank one matches every row, also rows whose
    columns are NULL. Otherwise NULL never matches.
    """
    query = query.strip()
    if not query:
        return F.lit(True)
    pattern = F.lit("(?iu)" + query)
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.rlike(column, pattern), F.lit(False))
    return hit
