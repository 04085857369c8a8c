"""Pickup and dropoff locations of requests: edges within walking distance, and those where vehicles stop anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import CATEGORIES, open_to_cars
from ..storage import cut, growing
from .graph import distances, reverse

c = F.col


def _walks(foot: DataFrame, starts: DataFrame, radius: int) -> DataFrame:
    """(start, vertex_id, dist): one search for each different start, whatever number of requests begins there."""
    seeds = starts.select(c("start").alias("source"), "vertex_id", "dist").distinct()
    return distances(foot, seeds, radius).select(c("source").alias("start"), "vertex_id", "dist")


def pickups(requests: DataFrame, edges: DataFrame, foot: DataFrame, radius: int) -> DataFrame:
    """(request_id, location, walk): edges open to cars whose head can be reached on foot from the origin's head."""
    origin = edges.select(c("edge_id").alias("origin"), c("head").alias("start"))
    at = requests.select("request_id", "origin").join(origin, "origin").select("request_id", "start")
    walks = _walks(foot, at.select("start", c("start").alias("vertex_id"), F.lit(0).cast("long").alias("dist")), radius)
    ways = foot.where(open_to_cars(c("category"))).select(c("tail").alias("vertex_id"), c("edge_id").alias("location"), "travel_time")
    reached = walks.join(growing(ways), "vertex_id").select("start", "location", (c("dist") + c("travel_time")).alias("walk")).where(c("walk") <= radius)
    return at.join(growing(reached.groupBy("start", "location").agg(F.min("walk").alias("walk"))), "start").select("request_id", "location", "walk")


def dropoffs(requests: DataFrame, edges: DataFrame, foot: DataFrame, radius: int) -> DataFrame:
    """(request_id, location, walk): edges open to cars from whose head the destination's end can be reached on foot."""
    end = edges.select(c("edge_id").alias("destination"), c("tail").alias("vertex_id"), c("travel_time").cast("long").alias("dist"))
    at = requests.select("request_id", c("destination").alias("start"))
    starts = at.select(c("start").alias("destination")).distinct().join(end, "destination").where(c("dist") <= radius)
    walks = _walks(reverse(foot), starts.select(c("destination").alias("start"), "vertex_id", "dist"), radius)
    ways = foot.where(open_to_cars(c("category"))).select(c("head").alias("vertex_id"), c("edge_id").alias("location"))
    reached = walks.join(growing(ways), "vertex_id").select("start", "location", c("dist").alias("walk"))
    return at.join(growing(reached), "start").select("request_id", "location", "walk")


def with_centre(found: DataFrame, centres: DataFrame) -> DataFrame:
    """(request_id, location, walk, pd_id) with the request's own location (``centre``), which is number 0.

    Each location once, with its least walk. Numbers follow the location's order, but the centre and the first location
    swap places. A request without any other location has its centre alone.
    """
    every = found.select("request_id", "location", "walk").unionByName(centres.select("request_id", c("centre").alias("location"), F.lit(0).cast("long").alias("walk")))
    rows = every.groupBy("request_id", "location").agg(F.min("walk").alias("walk")).join(centres, "request_id")
    own = Window.partitionBy("request_id")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("location")) - 1)
    rows = rows.withColumn("centre_rank", F.max(F.when(c("location") == c("centre"), c("rank"))).over(own))
    number = F.when(c("location") == c("centre"), 0).when(c("rank") == 0, c("centre_rank")).otherwise(c("rank"))
    return rows.select("request_id", "location", "walk", number.cast("long").alias("pd_id"))


def at_stops(found: DataFrame, stops: DataFrame) -> DataFrame:
    """(request_id, location, vehicle_id, stop_idx): locations where a vehicle's route stops."""
    return found.select("request_id", "location").join(stops.select("location", "vehicle_id", "stop_idx"), "location").select("request_id", "location", "vehicle_id", "stop_idx")


def dropoffs_at_stops(found: DataFrame, stops: DataFrame) -> DataFrame:
    """``at_stops`` for dropoffs: a route's last stop counts, too, unless it is its only one."""
    n = stops.groupBy("vehicle_id").agg(F.count("*").alias("n"))
    rows = at_stops(found, stops).join(n, "vehicle_id")
    return rows.where("n > 1").select("request_id", "location", "vehicle_id", "stop_idx")


def centre_distances(edges: DataFrame, found: DataFrame, centres: DataFrame) -> DataFrame:
    """``found`` (request_id, location, pd_id, ...) with to_centre and from_centre: a vehicle's ways between each location and the
    request's own (request_id, centre)."""
    from .dispatch import location_ways

    rows = cut(found.join(centres, "request_id"))
    # Both directions in one go, as labels of places are made level by level.
    there, back = (rows.select("request_id", c(a).alias("a"), c(b).alias("b")) for a, b in (("location", "centre"), ("centre", "location")))
    ways = cut(location_ways(there.union(back).distinct(), edges, "a", "b", "way"))
    rows = rows.join(growing(ways.toDF("request_id", "location", "centre", "to_centre")), ["request_id", "location", "centre"])
    return rows.join(growing(ways.toDF("request_id", "centre", "location", "from_centre")), ["request_id", "location", "centre"]).drop("centre")


def road_categories(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, a column for each road category, total) of locations (kind, location)."""
    known = rows.join(edges.select(c("edge_id").alias("location"), "category"), "location")
    each = [F.count(F.when(c("category") == i, 1)).alias(n) for i, n in enumerate(CATEGORIES)]
    return known.groupBy("kind").agg(*each, F.count("*").alias("total"))
