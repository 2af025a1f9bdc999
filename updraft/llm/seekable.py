"""Token files of independent zstandard frames with a trailing seek table.

A shard is a run of documents in ascending id order. Each document is one frame
over its ids, stored as 16-bit integers where the vocabulary allows and as 32-bit ones
otherwise. A skippable frame with the document ids and the width follows, and last
the seek table: compressed size, decompressed size and checksum of each frame, the
frame count, and the magic number of the public seekable format. The checksum is the
low half of the frame content's xxhash64. A reader finds a document's place from
the table's sizes and decompresses that frame alone; any zstandard decoder reads the
whole file, since it passes over skippable frames.

Shards are written by Spark's text writer, one record a file. The line end it puts
after a record is set to the last four bytes of a shard, so the bytes on disk are the
shard itself, on whatever store ``path`` is, and only committed tasks leave files.

Every text is encoded whole. NULL and empty texts hold the end id alone. Rows keep
their number: repeated ids are separate documents side by side, NULL ids come first.
Extra columns are not read. An empty table gives no shard and no row.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from updraft.llm.pieces import PieceEncoder
from updraft.llm.words import give_back

# Fixed values of the public seekable format and of skippable frames.
SEEK_MAGIC = 0x8F92EAB1
SEEK_FRAME = 0x184D2A5E
INDEX_FRAME = 0x184D2A51
END_ID = 2
SHARD_BYTES = 8 << 20
NO_ID = -(1 << 63)
READ = "file string, part int, nth long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class Shard:
    """Collects documents and closes into the bytes of one file."""

    def __init__(self, wide: bool, level: int = 3):
        self.dtype, self.level = np.dtype("<u4" if wide else "<u2"), level
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.body, self.ids, self.table = io.BytesIO(), [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        content = ids.astype(self.dtype).tobytes()
        frame = self.packer.compress(content)
        self.body.write(frame)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def __len__(self) -> int:
        return len(self.ids)

    def close(self) -> bytes:
        index = struct.pack("<B", self.dtype.itemsize) + np.asarray(self.ids, dtype="<i8").tobytes()
        table = np.asarray(self.table, dtype="<u4").reshape(-1, 3).tobytes()
        index_entry = np.asarray([(8 + len(index), 0, 0)], dtype="<u4").tobytes()
        foot = struct.pack("<IBI", len(self.ids) + 1, 0x80, SEEK_MAGIC)
        return b"".join([
            self.body.getvalue(), struct.pack("<II", INDEX_FRAME, len(index)), index,
            struct.pack("<II", SEEK_FRAME, len(table) + len(index_entry) + len(foot)), table, index_entry, foot,
        ])


class ShardReader:
    """Random access to a shard's documents by position; each read is checked."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        frames, flags, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("not a seekable shard")
        table = np.frombuffer(self.data[-9 - 12 * frames : -9], dtype="<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.sizes, self.checks = table[:-1, 1], table[:-1, 2]
        index = self.data[self.offsets[-2] + 8 : self.offsets[-1]]
        self.dtype = np.dtype("<u2" if index[0] == 2 else "<u4")
        self.doc_ids = np.frombuffer(index[1:], dtype="<i8")
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, n: int) -> np.ndarray:
        frame = self.data[self.offsets[n] : self.offsets[n + 1]]
        content = self.unpacker.decompress(frame, max_output_size=int(self.sizes[n]))
        if len(content) != self.sizes[n] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[n]:
            raise ValueError(f"frame {n} is damaged")
        return np.frombuffer(content, dtype=self.dtype).astype("<u4")


def make_shards(tokenizer: str, end_id: int, shard_bytes: int, literal: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Its bounded cache stays for the worker's next task, which meets many of the same pieces.
        encoder = PieceEncoder.of(tokenizer, literal)
        wide = max(encoder.vocabulary, end_id + 1) > 1 << 16
        end = np.array([end_id], dtype="<u4")
        shard = Shard(wide)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard.close()[:-4]], pa.binary())})

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                shard.add(doc_id, np.concatenate([ids, end]))
                if shard.body.tell() >= shard_bytes:
                    yield closed()
                    shard = Shard(wide)
        if len(shard):
            yield closed()
        give_back()

    return run


def write(
    docs: DataFrame, path: str, tokenizer: str, order: Sequence[Column] | None = None,
    end_id: int = END_ID, id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, literal: bool = True,
) -> None:
    """Encode ``docs`` in the order of ``order`` (the id, if none) into shards below ``path``.

    Rows are range partitioned by that order, so file names ascend with it. Special tokens
    written out in a text are plain characters where ``literal``, else those tokens.
    """
    keys = list(order) if order else [F.col(id)]
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    # The id breaks ties of another order; the text's hash parts copies of one id among tasks.
    by = [*(f"_k{i}" for i in range(len(keys))), *(["_id"] if order else []), F.xxhash64("_text")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("_id", "_text")
    shards = ordered.mapInArrow(make_shards(tokenizer, end_id, shard_bytes, literal), "shard binary")
    closing = struct.pack("<I", SEEK_MAGIC).decode("latin-1")
    (
        shards.select(F.col("shard").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1").option("lineSep", closing).option("maxRecordsPerFile", 1)
        .text(path)
    )


def digest_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = ShardReader(content.as_buffer())
            name = path.rsplit("/", 1)[-1]
            part, split = int(name.split("-")[1]), int(name.split("-c")[-1].split(".")[0])
            sizes = np.asarray(shard.sizes, dtype=np.int64) // shard.dtype.itemsize
            n = len(shard)
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([name] * n, pa.string()),
                "part": pa.array(np.full(n, part), pa.int32()),
                "nth": pa.array(split * (1 << 40) + np.arange(n), pa.int64()),
                "doc_id": pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NO_ID),
                "local_start": pa.array(np.cumsum(sizes) - sizes, pa.int64()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(shard[i].tobytes()) for i in range(n)], pa.int64()),
            })


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the shards below ``path``, with its place in the stream.

    ``start`` counts the ids of all documents before it. Only the totals of the files
    are summed up in one place, a row for each file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 0").select("path", "content")
    docs = files.mapInArrow(digest_shards, READ)
    totals = docs.groupBy("file", "part").agg(F.min("nth").alias("first"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part", "first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return docs.join(offsets, "file").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "file", "nth")
