"""Exact top-k by inner product: term-at-a-time accumulation over postings.

Candidates are dealt into blocks and turned into postings, one list of (row,
weight) per component. Each query is a sparse row of (component, weight) terms; a
term scatters ``weight * posting weight`` into a dense score array of the block.
Each block selects its k best by partition, and the blocks' winners are merged.
Queries are dealt into blocks too; every pair of a query block and a candidate
block is one task, so memory is bounded by the block sizes whatever the tables hold.
All arithmetic is on 64-bit integers.

Vectors that are NULL or hold a NULL or non-finite component take no part, nor do rows
without id; an empty vector scores 0 with every other. A query meets every row with another id. Equal scores go to the
smaller id. Repeated candidate rows are separate candidates; of several query rows
with one id the smallest vector asks. Fewer than k candidates give fewer rows, empty
tables none. Missing components count as zero. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 20_000
QUERY_BLOCK = 256
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id: str, vector: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x), x as double."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col(id).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return vectors.where(usable).select(
        F.col(id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def postings(rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By component: the rows with a weight other than zero, ascending, and the weights."""
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), lengths)
    component = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = np.flatnonzero(flat)
    keep = keep[np.argsort(component[keep], kind="stable")]
    terms, begin = np.unique(component[keep], return_index=True)
    return {int(t): (row[part], flat[part]) for t, part in zip(terms, np.split(keep, begin[1:]))}


def accumulate(query: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]], scores: np.ndarray) -> np.ndarray:
    scores[:] = 0
    for term in np.flatnonzero(query):
        if int(term) in lists:
            rows, weights = lists[int(term)]
            if len(rows) == len(scores):
                scores += query[term] * weights
            else:
                scores[rows] += query[term] * weights
    return scores


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest allowed scores; of equal ones the first positions."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        own = scores[at]
        least = np.partition(own, len(own) - k)[len(own) - k]
        above, equal = at[own > least], at[own == least]
        at = np.concatenate([above, equal[: k - len(above)]])
    return at


def block_top(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(candidates):
        candidates = candidates.sort_values("vec_id", kind="stable")
        ids = candidates["vec_id"].to_numpy()
        lists = postings([np.asarray(v, dtype=np.int64) for v in candidates["v"]])
        scores = np.zeros(len(ids), dtype=np.int64)
        for query_id, v in zip(queries["vec_id"], queries["v"]):
            accumulate(np.asarray(v, dtype=np.int64), lists, scores)
            at = best(scores, ids != query_id, k)
            out["query_id"].extend([query_id] * len(at))
            out["vec_id"].extend(ids[at])
            out["score"].extend(scores[at])
    return pd.DataFrame({name: pd.Series(values, dtype="int64") for name, values in out.items()})


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10,
    query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of ``candidates`` for each row of ``queries``.

    Both are (vec_id, v) as ``integer_vectors`` gives them. Their rows are counted
    first, which only sets the number of blocks.
    """
    asks = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_q = max(1, -(-queries.count() // query_block))
    n_c = max(1, -(-candidates.count() // candidate_block))
    of = lambda df, n: df.withColumn("_b", F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int"))
    left = of(asks, n_q).select(F.col("_b").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), "vec_id", "v")
    right = of(candidates, n_c).select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.col("_b").alias("cb"), "vec_id", "v")
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(lambda q, c: block_top(q, c, k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
