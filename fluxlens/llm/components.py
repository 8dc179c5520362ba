"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.tasks import settled


def _toward(links: DataFrame) -> DataFrame:
    """Distinct links (a, b) with a > b; links to oneself go."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return _toward(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    return _toward(
        links.join(least, "a")
        .select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    )


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b: numbers, null and equal ends ignored); the smallest node names it.

    A node with any number of links is handled by partial aggregation and a join that adaptive execution can split.
    The number of rounds grows with the logarithm of a component's diameter.
    """
    links = settled(_toward(links.where("a is not null and b is not null")))
    while True:
        children = links.groupBy("a").agg(F.count("*").alias("parents"))
        roots = links.select(F.col("b").alias("a")).distinct()
        if children.where("parents > 1").isEmpty() and roots.join(children, "a", "left_semi").isEmpty():
            break
        links = settled(_small_star(_large_star(links)))
    named = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
