"""The corpus pipeline: five stages, each by one operator, from documents to token files.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; what it returns is
written as Parquet and read again as the next stage's ``docs``.

1. ``quality``: a classifier trained on the labels; documents that it rejects go.
2. ``near_duplicates``: five-word shingles, similarity 0.8 or more; one document of each group stays.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``mix``: all documents, in the order of the target mixture. The order is the decision, and it is the
   order of the rows in the written files.
5. ``tokens``: the documents encoded in the order in which they arrive, as token files, and read back.

NULL and empty texts, ties, repeated rows, empty tables and extra columns are handled as each
operator states; extra columns pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm import decontaminate, jaccard_join, mixing, seekable
from updraft.llm import quality as quality_classifier
from updraft.llm.queries import TOKENIZER
from updraft.llm.tables import read, shared_path, ship, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return quality_classifier.accept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.representatives(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position, start, n_tokens and ids_crc32 of each document in the token files."""
    ship(spark)
    path = shared_path(spark, "shards")
    seekable.write(docs, path, TOKENIZER, order=arrival(docs), literal=False)
    return seekable.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def arrival(docs: DataFrame) -> list | None:
    """The place of each row in the files it was read from; the id, if it comes from no file."""
    if not docs.inputFiles():
        return None
    return [F.col("_metadata.file_name"), F.col("_metadata.row_index")]


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mix),
    ("tokens", tokens),
]
# A trained classifier, an iterated closure and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
