"""One query for each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm import decontaminate, jaccard_join, lm_scoring, merkle, minhash_links, mixing, phrases, quality, seekable, secrets, token_files, topk, urls
from updraft.llm.tables import crc32_of_id, read, shared_path, ship

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # A source stands for an owner; its parts by language for that owner's repositories.
    return secrets.digest(secrets.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang")))


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "release", "deadline")


def op3_separator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_files.document_counts(read(spark, sf_dir, "documents"), shared_path(spark, "flat"), TOKENIZER)


def op4_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def held_out_of(modulus: int, remainder: int) -> Column:
    return crc32_of_id("doc_id") % modulus == remainder


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, apart = read(spark, sf_dir, "documents"), held_out_of(4, 2)
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~apart)
    scored = quality.score(docs, model)
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op6_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = shared_path(spark, "shards")
    seekable.write(read(spark, sf_dir, "documents"), path, TOKENIZER, literal=False)
    return seekable.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_exhaustive_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op8_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op9_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.link(read(spark, sf_dir, "documents"), words=3, percent=90)


def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lm_scoring.score(read(spark, sf_dir, "documents"), held_out_of(5, 1))


def op11_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash_links.link(read(spark, sf_dir, "documents"))


def op12_branch_and_bound_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return phrases.mine(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = merkle.manifest(read(spark, sf_dir, "documents"), merkle.lower_cased, merkle.one_in(5))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_secret_ownership": op1_secret_ownership,
    "op2_pfair_mix": op2_pfair_mix,
    "op3_separator_counts": op3_separator_counts,
    "op4_minhash_containment": op4_minhash_containment,
    "op5_subword_quality": op5_subword_quality,
    "op6_seekable_frames": op6_seekable_frames,
    "op7_exhaustive_topk": op7_exhaustive_topk,
    "op8_url_vocabulary": op8_url_vocabulary,
    "op9_signature_tree_join": op9_signature_tree_join,
    "op10_elias_fano_lm": op10_elias_fano_lm,
    "op11_b_bit_minhash": op11_b_bit_minhash,
    "op12_branch_and_bound_phrases": op12_branch_and_bound_phrases,
    "op13_merkle_manifest": op13_merkle_manifest,
}
