"""Mixing sources to target weights by Pfair scheduling.

A source of weight w is due one block in every 1/w slots: its i-th block (from 0) is
released at floor(i / w) and has the deadline ceil((i + 1) / w). Serving the earliest
deadline among the released blocks, one a slot, keeps every deadline, so after each slot
every source is within one block of its weight. Weights are set to whole
slots of a period, over which the schedule repeats; the schedule of one period is worked out once and
each block finds its slot by arithmetic on its number, without a pass over the data.

A block holds ``block_units`` units (characters) of one source: by default as many as deal the
table into PERIODS periods, at most BLOCK_UNITS. A document lies in the block in which it starts, so one
longer than a block leaves slots empty. While no source has run out, the units of a source up to the end of
any slot are within a block and its longest document of its share of the slots. Sources
that run out leave their later slots empty as well; the others keep their slots. All rows
stay: sources without a positive weight follow after the mixture, and NULL
sources are a source of their own. Within a source documents go by a hash of id and text, then id; rows equal
in both share a place range one after another. NULL or negative units count as zero.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 1000
PERIODS = 4
BLOCK_UNITS = 100_000
BUCKET_ROWS = 4_000
LAST = (1 << 63) - 1


def slots_of_period(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Whole slots for each source, at least one, by largest remainder.

    With more than a quarter as many sources as slots the period grows to four slots a source.
    """
    positive = {s: Fraction(w) for s, w in weights.items() if w > 0}
    if not positive:
        return {}
    period = max(period, 4 * len(positive))
    total = sum(positive.values())
    exact = {s: w / total * period for s, w in positive.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    by_remainder = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s is None, s or ""))
    for s in by_remainder[: max(0, period - sum(slots.values()))]:
        slots[s] += 1
    return slots


def edf(slots: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """One period: (source, block, slot, release, deadline) by earliest deadline first."""
    period = sum(slots.values())
    names = sorted(slots, key=lambda s: (s is None, s or ""))
    waiting = [(0, n, 0) for n in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    served = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, n, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * period // slots[names[n]]), n, block, release))
        deadline, n, block, release = heapq.heappop(ready)
        served.append((names[n], block, slot, release, deadline))
        if block + 1 < slots[names[n]]:
            heapq.heappush(waiting, ((block + 1) * period // slots[names[n]], n, block + 1))
    return served


def source_units(docs: DataFrame, units: Column, source: str) -> dict[str | None, int]:
    """Units of each source: one row for a source."""
    totals = docs.groupBy(source).agg(F.sum(F.greatest(F.coalesce(units, F.lit(0)), F.lit(0))).alias("n")).collect()
    return {row[source]: int(row["n"] or 0) for row in totals}


def smoothed_weights(totals: Mapping[str | None, int], power: float = 0.5) -> dict[str | None, float]:
    """Target weights that grow as a power of each source's units: large sources are held back."""
    return {s: float(max(n, 1)) ** power for s, n in totals.items()}


def places(docs: DataFrame, units: Column, id: str, source: str, text: str) -> DataFrame:
    """Adds ``_at``: the units of the source that lie before the row.

    Rows are dealt into hash buckets of about BUCKET_ROWS, summed up within their
    bucket, and moved by the sums of the source's buckets before. So a source with
    a third of all rows is spread over as many tasks as the rest.
    """
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    key = F.xxhash64(id, text)
    keyed = docs.withColumns({"_key": key, "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)), "_units": F.greatest(F.coalesce(units, F.lit(0)), F.lit(0)).cast("long")})
    inside = Window.partitionBy(source, "_bucket").orderBy("_key", id).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(F.col(source).alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum("_units").alias("n"))
    before = sums.select("_s", "_b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    summed = keyed.withColumn("_in", F.coalesce(F.sum("_units").over(inside), F.lit(0)))
    joined = summed.join(before, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_at", F.col("_before") + F.col("_in")).drop("_s", "_b", "_bucket", "_units", "_before", "_in")


def schedule(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, units: Column | None = None,
    id: str = "doc_id", source: str = "source", text: str = "text",
    block_units: int | None = None, period: int = PERIOD,
) -> DataFrame:
    """``docs`` with slot, block, release, deadline and ``place``, the units before it in its source.

    Columns of ``docs`` with these names are replaced.
    Sorting by (slot, place, id) gives the mixture. Weights default to the square
    root of each source's units.
    """
    units = F.length(text) if units is None else units
    totals = source_units(docs, units, source) if weights is None or block_units is None else {}
    weights = smoothed_weights(totals) if weights is None else weights
    slots = slots_of_period(weights, period)
    total = sum(slots.values())
    if block_units is None:
        block_units = min(BLOCK_UNITS, max(1, -(-sum(totals.values()) // max(1, PERIODS * total))))
    pattern = docs.sparkSession.createDataFrame(
        [(s, slots[s], *rest) for s, *rest in edf(slots)] if slots else [],
        "_s string, _n long, _j long, _slot long, _release long, _deadline long",
    )
    at = places(docs, units, id, source, text).withColumn("block", F.expr(f"_at div {int(block_units)}"))
    per = pattern.select("_s", "_n").distinct()
    # One row for each source with slots, and one for each slot: bounded by the period.
    numbered = at.join(F.broadcast(per), F.col(source).cast("string").eqNullSafe(F.col("_s")), "left").drop("_s")
    numbered = numbered.withColumns({"_q": F.expr("block div _n"), "_r": F.expr("block % _n")})
    timed = numbered.join(
        F.broadcast(pattern.drop("_n")),
        F.col(source).cast("string").eqNullSafe(F.col("_s")) & (F.col("_r") == F.col("_j")), "left",
    )
    shifted = lambda c: (F.col("_q") * total + F.col(c)).cast("long")
    return timed.withColumns({
        "slot": F.coalesce(shifted("_slot"), F.lit(LAST)), "release": shifted("_release"), "deadline": shifted("_deadline"),
        "place": F.col("_at"),
    }).drop("_s", "_n", "_j", "_q", "_r", "_slot", "_release", "_deadline", "_at", "_key")


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None,
    id: str = "doc_id", source: str = "source", text: str = "text", **settings,
) -> DataFrame:
    """All rows of ``docs`` in mixed order, with their own columns only, whatever their names."""
    columns = docs.columns
    name = {c: f"_c{i}" for i, c in enumerate(columns)}
    timed = schedule(docs.toDF(*name.values()), weights, id=name[id], source=name[source], text=name[text], **settings)
    by = ["slot", "place", name[id]]
    return timed.repartitionByRange(*by).sortWithinPartitions(*by).select(*(F.col(new).alias(old) for old, new in name.items()))
