"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm.tables import stored


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbourhood."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are tied to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    rest = down.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b); the component is its smallest node.

    Alternating star contractions; each round is stored before the next reads it. A node
    with very many links is spread by map-side minima and by skew joins: the minima are
    stored too, as Spark splits a large join partition only where both sides come straight
    from a shuffle. Ends when every node hangs on a root of its own, which takes a logarithmic
    number of rounds, and none where the links are such stars already.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not is_stars(now):
        now = stored(small_star(large_star(now)), "links")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def is_stars(links: DataFrame) -> bool:
    """Whether each node hangs once, and none that others hang on hangs on another one itself."""
    nodes = links.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("d")).first()
    return nodes["n"] == nodes["d"] and links.join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
