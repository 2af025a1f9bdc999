"""Weighted URL vocabulary: allow and block rules first, else strict and soft terms.

``judge`` splits each URL into host and path, lets the longest fitting rule
decide, and otherwise counts the vocabulary's terms with an Aho-Corasick
automaton: one strict term, or ``soft_limit`` distinct soft terms, block it. A term
counts only where no ASCII letter or digit touches it on either side.

Rows stay as they are, one out for one in. A NULL URL or one without ``://`` has an
empty host and path and fits no rule; its terms are counted all the same, and a NULL one has none.
A vocabulary may be a table (``terms_of``); each worker builds one automaton from it.
Extra columns pass through unless they carry the name of a result column, which
then replaces them. Very long URLs are searched whole, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the page query, as (host, path, verdict).
PAGE_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
STRICT_TERMS = (
    "adult", "casino", "casinos", "cialis", "escort", "escorts", "hentai", "malware", "phishing", "porn", "porno",
    "spam", "viagra", "warez", "xxx",
)
SOFT_TERMS = (
    "ad", "ads", "banner", "bet", "bets", "bonus", "cheap", "click", "coupon", "crack", "dating", "deals", "farm",
    "free", "jackpot", "keygen", "loan", "loans", "payday", "pill", "pills", "poker", "popup", "promo", "sex",
    "slots", "torrent", "track", "tracker", "tracking", "win",
)
SOFT_LIMIT = 2
VOCABULARY_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
WORD = frozenset(LOWER + "0123456789")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for term in terms:
        built.add_word(term, term)
    built.make_automaton()
    return built


def distinct_terms(text: str, terms: ahocorasick.Automaton) -> set[str]:
    """Terms of the automaton in ``text`` with no letter or digit next to them."""
    text, found = text.translate(FOLD), set()
    for end, term in terms.iter(text):
        begin = end + 1 - len(term)
        if (begin == 0 or text[begin - 1] not in WORD) and (end + 1 == len(text) or text[end + 1] not in WORD):
            found.add(term)
    return found


def terms_of(table: DataFrame, term: str = "term", kind: str = "kind", most_bytes: int = VOCABULARY_BYTES) -> tuple[list[str], list[str]]:
    """Strict and soft terms of a table with ``kind`` strict or soft, lower-cased, for ``judge``.

    Every worker holds the vocabulary, so its size is checked first and a larger one refused. Rows
    without term or with another kind are errors of the table and refused too; repeated ones count once.
    """
    low = F.translate(F.col(term), UPPER, LOWER)
    rows = table.select(low.alias("term"), F.col(kind).alias("kind")).distinct()
    size = rows.agg(F.sum(F.octet_length("term")).alias("bytes"), F.count_if(~F.coalesce((F.col("term") != "") & F.col("kind").isin("strict", "soft"), F.lit(False))).alias("bad")).first()
    if size["bad"]:
        raise ValueError(f"{size['bad']} rows are no strict or soft term")
    if (size["bytes"] or 0) > most_bytes:
        raise ValueError(f"a vocabulary of {size['bytes']} bytes is beyond {most_bytes}")
    found = rows.collect()
    strict = {r["term"] for r in found if r["kind"] == "strict"}
    return sorted(strict), sorted({r["term"] for r in found} - strict)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = PAGE_RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
    url: str = "url",
) -> DataFrame:
    """Adds host, path, rule, verdict, n_strict and n_soft to each row."""
    strict_set = frozenset(strict)
    terms = tuple(dict.fromkeys([*strict, *soft]))

    @F.pandas_udf("n_strict int, n_soft int")
    def count_terms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        search = automaton(terms)
        for batch in batches:
            found = [distinct_terms(x or "", search) if len(terms) else set() for x in batch]
            n_strict = [len(x & strict_set) for x in found]
            yield pd.DataFrame({
                "n_strict": pd.Series(n_strict, dtype="int32"),
                "n_soft": pd.Series([len(x) - n for x, n in zip(found, n_strict)], dtype="int32"),
            })

    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        here = fits(F.col("host"), F.col("path"), rule_host, rule_path)
        rule = F.when(here, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(here, F.lit(says)).otherwise(verdict)
    judged = parts.withColumns({"rule": rule, "_verdict": verdict, "_terms": count_terms(F.col(url))})
    rejects = (F.col("_terms.n_strict") >= 1) | (F.col("_terms.n_soft") >= soft_limit)
    return judged.withColumns({
        "verdict": F.coalesce("_verdict", F.when(rejects, "block").otherwise("allow")),
        "n_strict": F.col("_terms.n_strict"),
        "n_soft": F.col("_terms.n_soft"),
    }).drop("_verdict", "_terms")
