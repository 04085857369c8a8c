"""Connected components of a link table, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node that is reachable.

    Alternates large-star and small-star steps (Kiveris and others, 2014), whose rounds grow with the logarithm of the
    component's size; each round is written to the shared folder. A node with very many neighbours costs a minimum, which
    is combined before the shuffle and written, and a join of two plain exchanges, which Spark can split.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "links")
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = roots.select(F.col("root").alias("node"), "root").distinct()
    return stored(roots.union(tops), "components")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    both = _both(edges)
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    tied = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()
