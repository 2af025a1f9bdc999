"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is short, a document may be long, so the two are compared by the item's side
alone: which share of the item's shingles does the document hold? Items are
partitioned by size into classes up to powers of two. An item is sketched by the k shingles
with the smallest hashes, where k is one more than the class's largest item may
miss at the threshold. A document that holds enough of an item then holds
at least one shingle of its sketch, so the candidates lose nothing; each candidate is
verified by exact containment of the shingles themselves, as words and not as hashes.

Shingles are five words of lower-case text with ASCII punctuation read as spaces; an item
with fewer words is one shingle of all its words. Items reach the executors in blocks of at
most ``block_bytes`` of text, each block searched against all documents, so what is
broadcast is bounded whatever the benchmark holds.

NULL and empty texts, of items or documents, match nothing. Repeated documents and items
are each reported. Extra columns are not read; empty tables give no row. Documents are
searched whole, however long.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm.words import scan, sequences, shingle_set

WORDS = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8 << 20
FOLD = bytes.maketrans(
    (string.ascii_uppercase + string.punctuation).encode(),
    (string.ascii_lowercase + " " * len(string.punctuation)).encode(),
)
FOUND = "doc_id long, item_id long, n_shingles long, matched long"


def allowed_misses(n: int, threshold: float) -> int:
    """How many of n shingles may be absent at the threshold."""
    return n - int(np.ceil(threshold * n - 1e-9))


def shingles(text: bytes, width: int) -> set[bytes]:
    words = text.translate(FOLD).split()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


@dataclass
class ItemBlock:
    """Items by shingle width, with the sketches of their size classes."""

    items: Sequence[tuple[int | None, bytes]]
    threshold: float = THRESHOLD
    words: int = WORDS
    # By width: sorted sketch hashes, and for each the items that hold it.
    sketches: dict[int, tuple[np.ndarray, list[list[int]]]] = field(default_factory=dict)
    sets: list[tuple[int, frozenset[bytes]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        hashes: dict[int, dict[int, list[int]]] = {}
        for first, counts, found in scan([t for _, t in self.items], FOLD):
            ends = np.cumsum(counts)
            for i, (end, n) in enumerate(zip(ends, counts), start=first):
                width = min(self.words, int(n))
                own = shingle_set(found[end - n : end], width) if n else found[:0]
                self.sets.append((width, frozenset(shingles(self.items[i][1], width)) if n else frozenset()))
                if n:
                    size_class = 1 << int(len(own) - 1).bit_length()
                    for h in own[: allowed_misses(size_class, self.threshold) + 1].tolist():
                        hashes.setdefault(width, {}).setdefault(h, []).append(i)
        for width, by_hash in hashes.items():
            order = sorted(by_hash)
            self.sketches[width] = np.array(order, np.uint64), [by_hash[h] for h in order]

    def candidates(self, texts: Sequence[bytes | None]) -> dict[int, set[int]]:
        """By text: the items of which it holds a sketch shingle."""
        found: dict[int, set[int]] = {}
        for first, counts, hashes in scan(texts, FOLD):
            owner = np.repeat(np.arange(first, first + len(counts)), counts)
            for width, (sketch, holders) in self.sketches.items():
                here = sequences(hashes, width)
                at = np.searchsorted(sketch, here)
                at[at == len(sketch)] = 0
                hit = np.flatnonzero(sketch[at] == here)
                hit = hit[owner[hit] == owner[hit + width - 1]]
                for doc, entry in zip(owner[hit].tolist(), at[hit].tolist()):
                    found.setdefault(doc, set()).update(holders[entry])
        return found

    def matches(self, texts: Sequence[bytes | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, those the text holds) of each verified pair."""
        for doc, items in sorted(self.candidates(texts).items()):
            own: dict[int, set[bytes]] = {}
            for item in sorted(items):
                width, wanted = self.sets[item]
                if width not in own:
                    own[width] = shingles(texts[doc], width)
                matched = len(wanted & own[width])
                if len(wanted) - matched <= allowed_misses(len(wanted), self.threshold):
                    yield doc, item, len(wanted), matched


def blocks(items: DataFrame, id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about ``block_bytes``, one block at a time on the driver."""
    block, size = [], 0
    rows = items.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias("i"), F.col(text).cast("binary").alias("t"))
    for row in rows.toLocalIterator():
        block.append((row["i"], bytes(row["t"])))
        size += len(row["t"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def report(block: ItemBlock) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[doc], block.items[item][0], n, m) for doc, item, n, m in block.matches(batch.column(1).to_pylist())]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_shingles", "matched"])

    return run


def leaks(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, words: int = WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, n_shingles, matched and containment of every document that holds an item."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = docs.sparkSession.createDataFrame([], FOUND)
    for block in blocks(items, item_id, item_text, block_bytes):
        found = found.unionByName(rows.mapInArrow(report(ItemBlock(block, threshold, words)), FOUND))
    return found.withColumn("containment", F.col("matched") / F.col("n_shingles"))


def without_matches(block: ItemBlock, text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[doc for doc, *_ in block.matches(batch.column(text).cast(pa.binary()).to_pylist())]] = False
            yield batch.filter(pa.array(keep))

    return run


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, words: int = WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns only."""
    names = docs.columns
    kept = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    for block in blocks(items, item_id, item_text, block_bytes):
        kept = kept.mapInArrow(without_matches(ItemBlock(block, threshold, words), names.index(text)), kept.schema)
    return kept.toDF(*names)
