"""Drawing locations, origin-destination pairs and shares of tables by given numbers, so that reruns agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .graph import dijkstra_rank, distances, numbered

c = F.col


def draw(rows: DataFrame, pool: DataFrame, value: str, u: str = "u") -> DataFrame:
    """Rows with ``value``: the one whose place in the pool's order is ``u`` modulo the pool's size. Rows stay if it is empty."""
    n = F.broadcast(pool.agg(F.count("*").alias("__n")))
    placed = numbered(pool.select(value), [value], "__place")
    return rows.join(n).withColumn("__place", F.when(c("__n") > 0, F.pmod(c(u), c("__n")))).join(placed, "__place", "left").drop("__place", "__n")


def from_sources(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, vertex_id, dist) from every different ``source``."""
    one = sources.select("source").distinct()
    return distances(edges, one.select("source", c("source").alias("vertex_id"), F.lit(0).cast("long").alias("dist")))


#: How often a bound on searches is doubled before they go without one.
DOUBLED = 6


def until(edges: DataFrame, sources: DataFrame, done: Callable[[DataFrame], DataFrame], edges_far: int) -> DataFrame:
    """(source, vertex_id, dist) from every different ``source``, as far as it takes: all vertices within a bound that ``done`` is content with.

    ``done`` takes such rows and gives the sources (source) that need no more. The first bound is the mean travel time of ``edges_far``
    edges; sources that aren't done search on within twice the bound, and at last without any, so what no bound finds is found, too.
    """
    mean = edges.agg(F.avg("travel_time")).first()[0] or 0
    left, out = cut(sources.select("source").distinct()), None
    for bound in [*(max(1, int(mean * edges_far)) << k for k in range(DOUBLED + 1)), None]:
        found = cut(distances(edges, left.select("source", c("source").alias("vertex_id"), F.lit(0).cast("long").alias("dist")), bound))
        ready = cut(done(found).select("source").distinct()) if bound is not None else left
        kept = found.join(ready, "source", "left_semi")
        out = kept if out is None else out.unionByName(kept)
        left = cut(left.join(ready, "source", "left_anti"))
        if left.isEmpty():
            break
    return out


def more_than(rank: Column | int) -> Callable[[DataFrame], DataFrame]:
    """For ``until``: sources with more than ``rank`` vertices, a number or a column that is the same in all rows of a source."""
    return lambda found: found.withColumn("rank", F.lit(rank)).groupBy("source").agg(F.count("*").alias("n"), F.max("rank").alias("rank")).where("n > rank")


def at_rank(found: DataFrame, rank: int) -> DataFrame:
    """(source, vertex_id, dist) of the vertex that a search settles as number ``rank`` (the source is number 0)."""
    return dijkstra_rank(found).where(c("rank") == rank).select("source", "vertex_id", "dist")


def at_distance(found: DataFrame, least: int) -> DataFrame:
    """(source, vertex_id, dist) of the first vertex that is settled at ``least`` or farther."""
    m = F.min(F.struct("dist", "vertex_id")).alias("m")
    return found.where(c("dist") >= least).groupBy("source").agg(m).select("source", "m.vertex_id", "m.dist")


def nearest_other(found: DataFrame, eligible: Column) -> DataFrame:
    """(source, vertex_id, dist) of the nearest eligible vertex but the source."""
    m = F.min(F.struct("dist", "vertex_id")).alias("m")
    return found.where((c("vertex_id") != c("source")) & eligible).groupBy("source").agg(m).select("source", "m.vertex_id", "m.dist")


def avoiding(edges: DataFrame, pairs: DataFrame, eligible: Column) -> DataFrame:
    """(id, origin, destination) whose destinations differ from their origins: where they are the same vertex, the destination is the
    nearest other one that is eligible. One search for each such vertex, which ends there."""
    same = pairs.where("origin = destination").select(c("destination").alias("source")).distinct()
    other = nearest_other(until(edges, same, lambda found: nearest_other(found, eligible), 2), eligible).select(c("source").alias("origin"), c("vertex_id").alias("__other"))
    rows = pairs.join(other, "origin", "left")
    return rows.select("id", "origin", F.when(c("origin") == c("destination"), c("__other")).otherwise(c("destination")).alias("destination"))


def search_space(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, vertex_id, dist): what a search from source settles until it settles the target, ties by vertex."""
    goal = found.join(targets.select("source", c("target").alias("vertex_id")), ["source", "vertex_id"]).select("source", c("vertex_id").alias("target"), c("dist").alias("upto"))
    before = (c("dist") < c("upto")) | ((c("dist") == c("upto")) & (c("vertex_id") <= c("target")))
    return found.join(goal, "source").where(before).select("source", "target", "vertex_id", "dist")


def until_total(rows: DataFrame, order: list[str], length: str, total: int) -> DataFrame:
    """Rows in order up to the first whose running sum of ``length`` reaches ``total``, that one included.

    Ranges of the order are summed side by side; a row's running sum is that of its range and of the ranges before.
    """
    placed = numbered(rows, order, "__place").withColumn("__block", F.floor(c("__place") / 65536))
    sums = placed.groupBy("__block").agg(F.sum(length).alias("__own"))
    before = F.coalesce(F.sum("__own").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = F.sum(length).over(Window.partitionBy("__block").orderBy("__place"))
    rows = placed.withColumn("__run", run).join(sums.withColumn("__before", before).drop("__own"), "__block")
    return rows.where(c("__before") + c("__run") - c(length) < total).drop("__place", "__block", "__run", "__before")


def share(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """About ``percent`` of a hundred rows, the same ones each time."""
    return rows.where(F.pmod(c(key) * 7919, F.lit(100)) < percent)


def geometric(u: Column, mean: int) -> Column:
    """A number from 0 on, geometrically distributed with that mean, of a number u in (0, 1)."""
    return F.floor(F.log(1 - u) / F.log(F.lit(1 - 1 / (mean + 1)))).cast("long")


def at_wanted_rank(found: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` (source, want, ...) with the vertex that a search settles as number ``want``, and its distance; sources whose
    search ends before go."""
    ranked = dijkstra_rank(found).select("source", c("rank").cast("long").alias("want"), "vertex_id", "dist")
    return sources.join(ranked, ["source", "want"])


def random_incident(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, vertex_id, edge_id): of the edges into a vertex the one whose place by id is ``u`` modulo their number."""
    into = Window.partitionBy("head")
    placed = edges.select(c("head").alias("vertex_id"), "edge_id", (F.row_number().over(into.orderBy("edge_id")) - 1).alias("k"), F.count("*").over(into).alias("m"))
    sizes = edges.groupBy(c("head").alias("vertex_id")).agg(F.count("*").alias("m"))
    wanted = asked.join(sizes, "vertex_id").withColumn("k", F.pmod(c("u"), c("m"))).drop("m")
    return wanted.join(placed.drop("m"), ["vertex_id", "k"]).select("id", "vertex_id", "edge_id")
