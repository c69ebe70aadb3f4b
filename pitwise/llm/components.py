"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima (combined before the shuffle) and two joins;
a node with very many neighbours is a skewed join key, which Spark splits, and
is never gathered into one group.  The edge table is written to the shared
folder after each round; only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.tables import settle, spread, swept


def _star(edges: DataFrame, center: str, other: str, least: DataFrame) -> DataFrame:
    return edges.join(spread(least.withColumnRenamed("n", center)), center).select(F.col(other).alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the
    smallest node reachable.  Null ends and loops are ignored; an empty table
    gives an empty result.  Raises if max_rounds do not converge."""
    e = (
        edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e, seen = settle(e, "components"), None
    for _ in range(max_rounds):
        with swept(e.sparkSession):
            n, s = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, s) == seen or n == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                e.select("b", "b").distinct()
            )
        seen = (n, s)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("x")).select("n", F.least("n", "x").alias("m"))
        # large star: every larger neighbour moves to the smallest node around the centre
        large = _star(both.filter("b > a"), "a", "b", least).filter("a != b").distinct()
        # small star: the centre and its smaller neighbours move to the smallest of them
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = _star(large, "a", "b", low).union(low.select("n", "m")).filter("a != b").distinct()
        e = settle(small, "components")
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")
