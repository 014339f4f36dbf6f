"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above ``u`` is linked to the least node around ``u``."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``u`` and its neighbours below it are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): one row (node, root) for every node that has a link to
    another, root being the least node reachable. No links: no rows.

    Alternating large and small stars converge in a logarithmic number of
    rounds; each round is two aggregations and two joins of the link table, is
    written to the shared folder, and ends when the links no longer change.
    Rows with a null end are ignored. Skewed hubs are left to AQE's skew join:
    only the many-row side is split, the other holds one row a node.
    """
    edges = store(links.where("a <> b").distinct().select("a", "b"), "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct())
        mark = now
        edges = store(_small_star(_large_star(edges)), "stars")
