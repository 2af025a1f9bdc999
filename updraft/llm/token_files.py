"""Token counts of flat, unindexed token files by scanning for the end-of-document id.

A flat file is nothing but 16-bit little-endian ids. It is searched block by block with
vector comparisons; each block yields the separators in it and the ids before its first
and after its last one. A prefix scan over these summaries, in file and block order,
stitches the documents that cross blocks: an open tail is carried into the next
block until a separator closes it. Files are independent, as a writer ends each with a
separator; ids after a file's last separator form a document without end.

The writer closes a file between documents once it holds SEGMENT_IDS. Files of one
partition are segments of one sequence of ids, and the folder of a segment names the
documents and ids before it, so whoever scans it holds one segment or one document.

NULL and empty texts are documents with no ids of their own, counted with one id (the
end). Rows keep their number. Extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.pieces import PieceEncoder

SEPARATOR = 50256
BLOCK_IDS = 1 << 20
SEGMENT_IDS = 1 << 22
COUNTS = "part int, nth long, start long, n_tokens long, ended boolean"


IDS, NAMES = "a-ids", "b-names"
ENCODED = "kind string, segment string, nth long, value binary"


class Segments:
    """Names the segments of one task's ids: documents and ids before each, as text that sorts like they follow."""

    def __init__(self, segment_ids: int):
        self.segment_ids, self.docs, self.ids, self.start = segment_ids, 0, 0, (0, 0)

    def of(self, sizes: Sequence[int]) -> list[str]:
        """The segment of each of the next documents, given their sizes with the separator."""
        names = []
        for size in sizes:
            if self.ids - self.start[1] >= self.segment_ids:
                self.start = self.docs, self.ids
            names.append("%020d-%020d" % self.start)
            self.docs, self.ids = self.docs + 1, self.ids + size
        return names


def segment_start(path: str) -> tuple[int, int]:
    """Documents and ids before the file at ``path``; a file in no segment's folder is a whole sequence."""
    found = re.search(r"/segment=(\d+)-(\d+)/[^/]*$", path)
    return (int(found[1]), int(found[2])) if found else (0, 0)


def encode_rows(tokenizer: str, segment_ids: int = SEGMENT_IDS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each row its ids with their segment, and its name with its place among the rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The end id must not arise inside a document.
        encoder = PieceEncoder.of(tokenizer, literal=True)
        if encoder.vocabulary > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        first, segments = 0, Segments(segment_ids)
        for batch in batches:
            n = batch.num_rows
            ids = [x.astype("<u2").tobytes() for x in encoder.encode(batch.column(1))]
            names = [f"{first + i}:{name}".encode() if name is not None else b"%d" % (first + i) for i, name in enumerate(batch.column(0).to_pylist())]
            for kind, at, values in ((IDS, segments.of([len(x) // 2 + 1 for x in ids]), ids), (NAMES, ["all"] * n, names)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * n, pa.string()), pa.array(at, pa.string()), pa.array(np.arange(first, first + n)), pa.array(values, pa.binary())],
                    names=["kind", "segment", "nth", "value"],
                )
            first += n
        encoder.forget()

    return run


def write_flat(
    docs: DataFrame, path: str, tokenizer: str, separator: int = SEPARATOR, id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS
) -> None:
    """Flat files for each partition of ``docs``, its rows in partition order, and one of their names.

    The text writer's line end is set to the separator's two bytes. All files of a partition
    are written and committed by one task, below the folders IDS and NAMES.
    """
    # Base 64 keeps the line end out of names.
    name = F.base64(F.col(id).cast("string").cast("binary"))
    rows = docs.select(name.alias("name"), F.col(text).cast("string").alias("text")).mapInArrow(encode_rows(tokenizer, segment_ids), ENCODED)
    ending = int(separator).to_bytes(2, "little").decode("latin-1")
    (
        rows.sortWithinPartitions("kind", "segment", "nth").select("kind", "segment", F.col("value").cast("string").alias("value"))
        .write.partitionBy("kind", "segment").option("maxRecordsPerFile", 0).option("encoding", "ISO-8859-1").option("lineSep", ending).text(path)
    )


def read_names(spark: SparkSession, path: str, kind: str, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, file number and place of each row that ``write_flat`` wrote below ``path``; ids have the type ``kind``."""
    ending = int(separator).to_bytes(2, "little").decode("latin-1")
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", ending).text(f"{path}/kind={NAMES}")
    place = F.split("value", ":")
    return lines.select(
        F.unbase64(F.get(place, F.lit(1))).cast("string").cast(kind).alias("doc_id"),
        F.split("_metadata.file_name", "-")[1].cast("int").alias("part"),
        place[0].cast("long").alias("nth"),
    )


def block_summary(block: np.ndarray, separator: int) -> tuple[np.ndarray, int, int]:
    """Places of the separators, ids up to and with the first, ids after the last."""
    at = np.flatnonzero(block == separator)
    return at, (int(at[0]) + 1 if len(at) else 0), (len(block) - 1 - int(at[-1]) if len(at) else len(block))


def document_sizes(ids: np.ndarray, separator: int, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, bool]:
    """Size of each document with its separator, and whether the last one is ended."""
    blocks = [block_summary(ids[i : i + block_ids], separator) for i in range(0, len(ids), block_ids)]
    sizes, has = [], np.array([len(at) > 0 for at, _, _ in blocks], dtype=bool)
    # carried[i]: ids that blocks before i leave open. Tails add up until a block with a separator resets them.
    tails = np.cumsum([0, *(tail for _, _, tail in blocks)])
    last = np.maximum.accumulate(np.concatenate([[-1], np.where(has, np.arange(len(blocks)), -1)]))
    carried = tails - np.where(last >= 0, tails[np.maximum(last, 0)], 0)
    for (at, head, _), open_ids in zip(blocks, carried):
        if len(at):
            sizes.append(np.concatenate([[open_ids + head], np.diff(at)]))
    if carried[-1]:
        sizes.append(np.array([carried[-1]]))
    return (np.concatenate(sizes) if sizes else np.empty(0, np.int64)).astype(np.int64), not carried[-1]


def scan_files(separator: int, block_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                sizes, ended = document_sizes(np.frombuffer(content.as_buffer(), "<u2"), separator, block_ids)
                n, (nth, start) = len(sizes), segment_start(path)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([int(path.rsplit("/", 1)[-1].split("-")[1])] * n, pa.int32()),
                    "nth": pa.array(nth + np.arange(n), pa.int64()),
                    "start": pa.array(start + np.cumsum(sizes) - sizes, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ended": pa.array(np.arange(n) < n - (not ended), pa.bool_()),
                })

    return run


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Each document of the flat files below ``path``: file number, place, start and size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(scan_files(separator, block_ids), COUNTS)


def document_counts(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes ``docs`` as flat files, scans them, and gives each count its id back.

    The flat files hold no ids of documents: a count belongs to the row at its place. Places
    are noted by the task that writes the file; ``docs`` is read once.
    """
    write_flat(docs, path, tokenizer, id=id, text=text, segment_ids=segment_ids)
    spark = docs.sparkSession
    if docs.isEmpty():
        return spark.createDataFrame([], f"doc_id {docs.schema[id].dataType.simpleString()}, n_tokens long, part int, start long")
    names = read_names(spark, path, docs.schema[id].dataType.simpleString())
    return names.join(count_tokens(spark, f"{path}/kind={IDS}"), ["part", "nth"]).select("doc_id", "n_tokens", "part", "start")
