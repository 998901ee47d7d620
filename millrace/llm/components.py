"""Connected components of links, by alternating stars on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_stored, stored


def _state(edges: DataFrame) -> tuple:
    """Size and an order-free digest of a table of edges: one row to the driver."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, F.col("u") == F.col("c"))
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    smaller = edges.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that a link (a, b) names; a component is named by its smallest id.

    Each round halves the paths at least roughly and is written to the shared
    folder; the driver sees one row a round. Ends as stars, when a round changes
    nothing.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges)
    state = _state(edges)
    while state[0]:
        new = stored(_small_star(_large_star(edges)))
        changed = _state(new)
        drop_stored(spark, edges)
        edges, before, state = new, state, changed
        if state == before:
            break
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
