"""Bitmaps of a fixed size that tell which rows can matter, before anything is shuffled.

A bitmap has BITS bits whatever it was made from, so it may go to every task. A bit can be set by
another value of the same place; such rows are kept in vain and fall out at the exact step that follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
PART = 1 << 15


def built(rows: DataFrame, at: Column) -> np.ndarray:
    """Bytes with the bits ``at`` (0 to BITS - 1) set: at most BITS / PART rows of 4 kB reach the driver."""
    places = rows.select(at.cast("long").alias("at"))
    parts = places.groupBy(F.expr(f"at div {PART}").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % PART).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"] * PART // 8 : (row["part"] + 1) * PART // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def of_longs(rows: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a column of longs, by their low bits."""
    return built(rows, F.col(column).bitwiseAND(F.lit(BITS - 1).cast("long")))


def at_places(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of the bits ``at`` is set."""
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def holds(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each long is set."""
    return at_places(bits, values & np.int64(BITS - 1))


def filtered(bits: np.ndarray, column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the rows whose long in ``column`` has its bit set; it must not be NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(bits, batch.column(column).to_numpy())))

    return run


def exploded(bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` on (id, list of longs): a row for each long whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).take(pc.list_parent_indices(batch.column(1))), pc.list_flatten(batch.column(1))
            keep = pa.array(holds(bits, values.to_numpy()))
            yield pa.RecordBatch.from_arrays([ids.filter(keep), values.filter(keep)], names=["id", "grp"])

    return run
