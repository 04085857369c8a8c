"""Dispatch of requests to a fleet with given routes: all insertions, with distances of the network, and the best one.

Distances between locations (edges) go from the first one's head to the second one's tail, and along the second. Nothing here is
a product of fleet and requests: on a leg, searches from its stop and backwards from the next one end at the leg's leeway, and
pickups and dropoffs are joined with the vertices that both reach; after a route's last stop, searches backwards from pickups
and dropoffs end where the way alone costs more than the request's known upper bound; other ways are searched pair by pair. An
insertion that keeps the bounds of the next stop keeps the leeway, and the best one costs no more than an upper bound, so
this loses none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, growing
from . import cost as C
from . import schedule as S
from .graph import SENT_EDGES, distances, nearest_labels, pair_distances, relaxed, reverse
from .hierarchy import distances_among, index_of

c = F.col


def zero() -> Column:
    return F.lit(0).cast("long")


#: Where an insertion puts the two stops.
ORDINARY, PAIRED, BEFORE_NEXT, AFTER_LAST, DROPOFF_AFTER_LAST = "ordinary", "paired", "before_next", "after_last", "dropoff_after_last"


def _ends(edges: DataFrame, name: str) -> DataFrame:
    """Locations as columns: name, name_tail, name_head, name_tt."""
    return edges.select(c("edge_id").alias(name), c("tail").alias(f"{name}_tail"), c("head").alias(f"{name}_head"), c("travel_time").alias(f"{name}_tt"))


def location_ways(rows: DataFrame, edges: DataFrame, a: str, b: str, to: str, how: str = "inner") -> DataFrame:
    """Rows with ``to``, the way from location a to location b, 0 for the same one; without a way they go (or have none, how = left).
    Ways of one request (``request_id``), whose locations recur in many of them, are found together."""
    keep = rows.columns
    some = F.min("request_id").cast("long").alias("part") if "request_id" in keep else F.lit(None).cast("long").alias("part")
    pairs = cut(rows.groupBy(c(a).alias("__a"), c(b).alias("__b")).agg(some).join(_ends(edges, "__a"), "__a").join(_ends(edges, "__b"), "__b"))
    found = pair_distances(edges, pairs.select(c("__a_head").alias("source"), c("__b_tail").alias("target"), *(["part"] if "request_id" in keep else [])))
    pairs = pairs.join(growing(found), (c("__a_head") == c("source")) & (c("__b_tail") == c("target")), "left")
    way = F.when(c("__a") == c("__b"), zero()).otherwise(c("dist") + c("__b_tt"))
    pairs = pairs.select(c("__a").alias(a), c("__b").alias(b), way.alias(to)).where(c(to).isNotNull())
    return rows.join(growing(pairs), [a, b], how).select(*keep, to)


def _balls(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """(source, vertex_id, dist) around vertices (source, radius), each within its largest radius; null: no bound."""
    most = F.when(F.max(c("radius").isNull()), None).otherwise(F.max("radius"))
    one = centres.groupBy("source").agg(most.alias("radius")).where("radius is null or radius >= 0")
    return distances(edges, one.select("source", c("source").alias("vertex_id"), zero().alias("dist"), "radius"))


def feasible_distances(edges: DataFrame, legs: DataFrame, locations: DataFrame) -> DataFrame:
    """(vehicle_id, at, x, to_x, from_x): locations (x) between a stop and the next one within the leg's leeway, with both ways.

    legs: (vehicle_id, at, stop, stop_head, next, next_tail, next_tt, leeway). What lies within the leeway from the stop and to the
    next one is an ellipse; its two balls are searched for every different end, and locations met in both are joined.
    """
    x = locations.select("x").distinct().join(_ends(edges, "x"), "x")
    out = _balls(edges, legs.select(c("stop_head").alias("source"), c("leeway").alias("radius"))).toDF("stop_head", "x_tail", "__d")
    back = _balls(reverse(edges), legs.select(c("next_tail").alias("source"), c("leeway").alias("radius"))).toDF("next_tail", "x_head", "__b")
    to = out.join(growing(x), "x_tail").join(legs, "stop_head").where(c("x") != c("stop")).withColumn("to_x", c("__d") + c("x_tt")).drop("__d")
    here = x.join(legs, c("x") == c("stop")).withColumn("to_x", zero())
    both = to.where(c("to_x") <= c("leeway")).unionByName(here).where(c("next") != c("x")).join(growing(back), ["next_tail", "x_head"]).withColumn("from_x", c("__b") + c("next_tt"))
    return both.where(c("to_x") + c("from_x") <= c("leeway")).select("vehicle_id", "at", "x", "to_x", "from_x")


def last_stop_distances(edges: DataFrame, last: DataFrame, places: DataFrame) -> DataFrame:
    """(vehicle_id, x, to_x): the way from a route's last stop (vehicle_id, stop, stop_head) to places (x, most); most bounds the
    way, null doesn't."""
    x = places.groupBy("x").agg(F.when(F.max(c("most").isNull()), None).otherwise(F.max("most")).alias("most")).join(_ends(edges, "x"), "x")
    wanted = cut(x.select(c("x_tail").alias("target"), c("most")))
    ways = distances_among(index_of(edges), last.select(c("stop_head").alias("source")), wanted).toDF("stop_head", "x_tail", "__d")
    far = ways.join(last, "stop_head").join(growing(x), "x_tail").where((c("x") != c("stop")) & (c("most").isNull() | (c("__d") <= c("most")))).withColumn("to_x", c("__d") + c("x_tt"))
    here = x.join(last, c("x") == c("stop")).withColumn("to_x", zero())
    return far.select("vehicle_id", "x", "to_x").unionByName(here.select("vehicle_id", "x", "to_x"))


def pd_distances(edges: DataFrame, pickups: DataFrame, dropoffs: DataFrame) -> DataFrame:
    """(request_id, p, d, dist) from each pickup (request_id, p) of a request to each of its dropoffs (request_id, d)."""
    return location_ways(pickups.select("request_id", "p").join(growing(dropoffs.select("request_id", "d")), "request_id"), edges, "p", "d", "dist")


def _dearer(time: Column, k: C.Config) -> Column:
    """How much dearer a trip gets at most by that much more time, which may be negative."""
    return F.when(time > 0, (k.psg + k.trip) * time).otherwise(k.psg * time)


def pair_labels(edges: DataFrame, pickups: DataFrame, dropoffs: DataFrame, k: C.Config) -> DataFrame:
    """(request_id, p_loc, d_loc, pd, worse, p_more, most_pd, most_walk): a request's pairs of a pickup and a dropoff.

    ``worse`` pairs cost more after any route's last stop than another pair of the request: a vehicle that reaches this pickup reaches the
    other one at most the way between them later, so that bounds hold for all vehicles at once. First dropoffs of one pickup
    are compared, then what is left of all pickups. Not so where the vehicle stops at the pickup already, which saves the
    stop, or where the other pair would end its service: ``p_more`` is the longest way from the pickup to another of the request, and the
    request's longest ride and walk bound what the other pair takes.
    """
    p = pickups.select("request_id", c("location").alias("p_loc"), c("walk").alias("p_walk"))
    d = dropoffs.select("request_id", c("location").alias("d_loc"), c("walk").alias("d_walk"))
    pd = pd_distances(edges, p.withColumnRenamed("p_loc", "p"), d.withColumnRenamed("d_loc", "d")).toDF("request_id", "p_loc", "d_loc", "pd")
    rows = cut(pd.join(growing(p), ["request_id", "p_loc"]).join(growing(d), ["request_id", "d_loc"]))
    other = rows.toDF(*[x if x in ("request_id", "p_loc") else f"{x}_o" for x in rows.columns])

    def beaten(pairs: DataFrame, later: Column) -> DataFrame:
        ride, walk = c("pd_o") - c("pd"), c("d_walk_o") - c("d_walk")
        more = k.veh * (later + ride) + _dearer(later + ride + walk, k) + k.wait * F.greatest(later, zero()) + k.walk * (c("p_walk_o") + c("d_walk_o") - c("p_walk") - c("d_walk"))
        return pairs.where(more < 0).select("request_id", "p_loc", "d_loc").distinct()

    first = beaten(rows.join(growing(other), ["request_id", "p_loc"]), zero())
    left = cut(rows.join(growing(first), ["request_id", "p_loc", "d_loc"], "left_anti"))
    between = cut(pd_distances(edges, p.withColumnRenamed("p_loc", "p"), p.withColumnRenamed("p_loc", "d")).toDF("request_id", "p_loc", "p_loc_o", "between"))
    other = left.toDF(*[x if x == "request_id" else f"{x}_o" for x in left.columns])
    met = left.join(growing(between), ["request_id", "p_loc"]).join(growing(other), ["request_id", "p_loc_o"]).where("p_loc <> p_loc_o")
    second = beaten(met, F.greatest(c("between"), c("p_walk_o") - c("p_walk")))
    good = left.join(growing(second), ["request_id", "p_loc", "d_loc"], "left_anti").select("request_id", "p_loc", "d_loc", F.lit(False).alias("worse"))
    apart = between.groupBy("request_id", "p_loc").agg(F.max("between").alias("p_more"))
    most = rows.groupBy("request_id").agg(F.max("pd").alias("most_pd"), F.max("p_walk").alias("most_walk"))
    rows = rows.select("request_id", "p_loc", "d_loc", "pd").join(growing(good), ["request_id", "p_loc", "d_loc"], "left").withColumn("worse", F.coalesce("worse", F.lit(True)))
    return cut(rows.join(growing(apart), ["request_id", "p_loc"]).join(growing(most), "request_id"))


def dropoff_labels(edges: DataFrame, pickups: DataFrame, dropoffs: DataFrame, k: C.Config) -> DataFrame:
    """(request_id, d_loc, d_worse, d_more): dropoffs that cost more after any route's last stop than another one of the request that is none
    of its pickups; and the longest way to another dropoff of the request."""
    d = dropoffs.select("request_id", c("location").alias("d_loc"), c("walk").alias("d_walk"))
    between = cut(pd_distances(edges, d.withColumnRenamed("d_loc", "p"), d.withColumnRenamed("d_loc", "d")).toDF("request_id", "d_loc", "other", "between"))
    apart = between.groupBy("request_id", "d_loc").agg(F.max("between").alias("d_more"))
    free = d.join(growing(pickups.select("request_id", c("location").alias("d_loc"))), ["request_id", "d_loc"], "left_anti").toDF("request_id", "other", "other_walk")
    met = d.join(growing(between), ["request_id", "d_loc"]).join(growing(free), ["request_id", "other"])
    walk = c("other_walk") - c("d_walk")
    worse = met.where(k.veh * c("between") + _dearer(c("between") + walk, k) + k.walk * walk < 0).select("request_id", "d_loc", F.lit(True).alias("d_worse")).distinct()
    return cut(apart.join(growing(worse), ["request_id", "d_loc"], "left").withColumn("d_worse", F.coalesce("d_worse", F.lit(False))))


def leg_paths(edges: DataFrame, legs: DataFrame) -> DataFrame:
    """(leg, step, edge_id, travel_time): a shortest path from ``from_vertex`` to ``to_vertex``, ties by the smaller edge id.

    Travel times are positive. Legs to one vertex share a search; a network that is too large to send is searched by rounds of joins.
    """
    if edges.count() > SENT_EDGES:
        return _joined_paths(edges, legs)
    p = edges.select("edge_id", "tail", "head", "travel_time").toPandas().sort_values("edge_id")
    sent = edges.sparkSession.sparkContext.broadcast({k: p[k].to_numpy() for k in p.columns})

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        g, goal = sent.value, int(rows["to_vertex"].iloc[0])
        into, out = _grouped(g["head"]), _grouped(g["tail"])
        dist, queue = {goal: 0}, [(0, goal)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > dist[v]:
                continue
            for k in into(v):
                u, n = int(g["tail"][k]), d + int(g["travel_time"][k])
                if n < dist.get(u, n + 1):
                    dist[u] = n
                    heapq.heappush(queue, (n, u))
        found = []
        for leg, v in zip(rows["leg"].tolist(), rows["from_vertex"].tolist(), strict=True):
            step = 0
            while v != goal and v in dist:
                k = next(k for k in out(v) if dist.get(int(g["head"][k]), -1) == dist[v] - int(g["travel_time"][k]))
                found.append((leg, step, int(g["edge_id"][k]), int(g["travel_time"][k])))
                v, step = int(g["head"][k]), step + 1
        return pd.DataFrame(found, columns=["leg", "step", "edge_id", "travel_time"])

    return legs.select("leg", "from_vertex", "to_vertex").groupBy("to_vertex").applyInPandas(walk, "leg long, step long, edge_id long, travel_time long")


def _joined_paths(edges: DataFrame, legs: DataFrame) -> DataFrame:
    """``leg_paths`` by joins: backwards from the legs' ends as far as their lengths, which the index gives; then along next edges in
    jumps of 1, 2, 4, ... edges, in as many rounds as the longest path's number of edges has bits."""
    legs = cut(legs.select("leg", c("from_vertex").alias("v"), c("to_vertex").alias("goal")))
    far = pair_distances(edges, legs.select(c("v").alias("source"), c("goal").alias("target"))).groupBy("target").agg(F.max("dist").alias("radius"))
    seeds = far.select(c("target").alias("source"), c("target").alias("vertex_id"), zero().alias("dist"), "radius")
    near = relaxed(reverse(edges), cut(seeds)).withColumnRenamed("source", "goal")
    tight = edges.join(near.select("goal", c("vertex_id").alias("tail"), c("dist").alias("dt")), "tail")
    tight = tight.join(near.select("goal", c("vertex_id").alias("head"), c("dist").alias("dh")), ["goal", "head"]).where(c("dt") == c("dh") + c("travel_time"))
    step = cut(tight.groupBy("goal", c("tail").alias("v")).agg(F.min(F.struct("edge_id", "travel_time", c("head").alias("to"))).alias("m")).select("goal", "v", "m.*").where("v <> goal"))
    at, jump, length = cut(legs.withColumn("step", zero())), step.select("goal", "v", "to"), 1
    while not (ahead := cut(at.join(jump, ["goal", "v"]).select("leg", c("to").alias("v"), "goal", (c("step") + length).alias("step")))).isEmpty():
        twice = jump.join(jump.select("goal", c("v").alias("to"), c("to").alias("beyond")), ["goal", "to"])
        at, jump, length = cut(at.unionByName(ahead)), cut(twice.select("goal", "v", c("beyond").alias("to"))), 2 * length
    return at.join(step, ["goal", "v"]).select("leg", "step", "edge_id", "travel_time")


def _grouped(key: np.ndarray):
    """v -> places of v in ``key``, in order."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    return lambda v: order[np.searchsorted(ordered, v) : np.searchsorted(ordered, v, "right")]


def first_legs(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """(vehicle_id, path): for vehicles with a next stop, what they pass on the way: (at_head, edge_id) in order, ending there."""
    legs = stops.select("vehicle_id", "stop_idx", "location", "arr", "dep").withColumns({"next": F.lead("location").over(S.by()), "next_arr": F.lead("arr").over(S.by())})
    legs = legs.where((c("stop_idx") == 0) & c("next").isNotNull()).join(_ends(edges, "location"), "location").join(_ends(edges, "next"), "next")
    steps = leg_paths(edges, legs.select(c("vehicle_id").alias("leg"), c("location_head").alias("from_vertex"), c("next_tail").alias("to_vertex")))
    one = steps.groupBy(c("leg").alias("vehicle_id")).agg(F.array_sort(F.collect_list(F.struct("step", "edge_id", "travel_time"))).alias("s"))
    rows = legs.join(one, "vehicle_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<step:bigint,edge_id:bigint,travel_time:bigint>>")))
    upto = lambda i: F.aggregate(F.slice("s", 1, i + 1), c("dep"), lambda acc, x: acc + x["travel_time"])
    passed = F.transform("s", lambda x, i: F.struct(upto(i).alias("at_head"), x["edge_id"].alias("edge_id")))
    return rows.select("vehicle_id", F.concat(passed, F.array(F.struct(c("next_arr").alias("at_head"), c("next").alias("edge_id")))).alias("path"))


def current_location(path: Column, now: Column) -> Column:
    """(at_head, edge_id): the first location on the way whose head isn't passed at ``now``; past the next stop, that stop."""
    return F.coalesce(F.get(F.filter(path, lambda x: x["at_head"] >= now), F.lit(0)), F.element_at(path, -1))


def route_arrays(stops: DataFrame) -> DataFrame:
    """One row a vehicle: arr, dep, max_arr, occ, n_drop, loc of its stops as arrays. A route is a few dozen stops."""
    fields = {"arr": "arr", "dep": "dep", "max_arr": "max_arr", "occupancy": "occ", "n_dropoffs": "n_drop", "location": "loc"}
    one = stops.groupBy("vehicle_id").agg(F.array_sort(F.collect_list(F.struct("stop_idx", *fields))).alias("s"))
    return one.select("vehicle_id", *[c(f"s.{f}").alias(to) for f, to in fields.items()])


def route_legs(edges: DataFrame, stops: DataFrame, vehicles: DataFrame, k: C.Config) -> DataFrame:
    """A row for each stop: vehicle_id, at, stop, next and their ends, leeway, occ_at, dep_at, n, capacity, end_service."""
    n = stops.groupBy("vehicle_id").agg(F.count("*").alias("n"))
    legs = S.leeways(stops, k.stop_time).withColumn("next", F.lead("location").over(S.by()))
    legs = legs.select("vehicle_id", c("stop_idx").alias("at"), c("location").alias("stop"), "next", "leeway", c("occupancy").alias("occ_at"), c("dep").alias("dep_at"))
    legs = legs.join(n, "vehicle_id").join(vehicles.select("vehicle_id", "capacity", c("end_of_service_time").alias("end_service")), "vehicle_id")
    return legs.join(_ends(edges, "stop"), "stop").join(_ends(edges, "next"), "next", "left")


def upper_bounds(edges: DataFrame, stops: DataFrame, vehicles: DataFrame, requests: DataFrame, k: C.Config, on_foot: DataFrame | None = None) -> DataFrame:
    """(request_id, upper): what a request costs at most: by the vehicle whose last stop is nearest, in time, or (request_id, cost) on foot.

    One search for each number of riders, from all last stops with enough seats at once, or the index where the network is too large to send. Null where neither is possible.
    """
    legs = route_legs(edges, stops, vehicles, k).where(c("at") == c("n") - 1)
    levels = requests.select(c("num_riders").alias("level")).distinct()
    start = F.when(c("n") > 1, c("dep_at")).otherwise(zero())
    seeds = legs.join(levels, c("capacity") >= c("level")).select("level", c("stop_head").alias("vertex_id"), start.alias("dist"), c("vehicle_id").alias("label"))
    asked = location_ways(requests, edges, "origin", "destination", "direct").join(_ends(edges, "origin"), "origin")
    near = nearest_labels(edges, seeds, wanted=asked.select(c("origin_tail").alias("vertex_id")))
    rows = asked.join(near, (c("origin_tail") == c("vertex_id")) & (c("num_riders") == c("level"))).withColumnRenamed("label", "vehicle_id")
    rows = rows.join(legs.select("vehicle_id", "stop", start.alias("start"), "n", "capacity", "end_service"), "vehicle_id")
    to_p = F.when(c("stop") == c("origin"), zero()).otherwise(c("dist") - c("start") + c("origin_tt"))
    rows = rows.select(
        "request_id", "vehicle_id", (c("n") - 1).alias("i"), (c("n") - 1).alias("j"), c("origin").alias("p_loc"), c("destination").alias("d_loc"), to_p.alias("to_p"), zero().alias("from_p"),
        c("direct").alias("to_d"), zero().alias("from_d"), c("request_time").alias("t0"), c("num_riders").alias("riders"), "direct", "n", "capacity", "end_service",
        *[zero().alias(x) for x in ("p_walk", "d_walk", "p_id", "d_id")],
    ).join(route_arrays(stops), "vehicle_id")
    found = requests.select("request_id").join(C.costed(rows, k).select("request_id", "cost"), "request_id", "left")
    if on_foot is None:
        return found.select("request_id", c("cost").alias("upper"))
    return found.join(on_foot.select("request_id", c("cost").alias("foot")), "request_id", "left").select("request_id", F.least("cost", "foot").alias("upper"))


def insertions(
    edges: DataFrame, stops: DataFrame, vehicles: DataFrame, requests: DataFrame, pickups: DataFrame, dropoffs: DataFrame, k: C.Config, upper: DataFrame | None = None,
    labelled: bool = False, kind: str | None = None,
) -> DataFrame:
    """Every insertion of every request that its stops and legs allow, costed (NULL: breaks a constraint), with its ``kind``.

    stops: (vehicle_id, stop_idx, location, arr, dep, max_arr, n_dropoffs, occupancy); vehicles: (vehicle_id, capacity,
    end_of_service_time); requests: (request_id, origin, destination, request_time, num_riders); pickups and dropoffs:
    (request_id, location, walk, pd_id). With ``upper`` (request_id, upper), insertions that certainly cost more may be missing;
    if ``labelled``, so may those after the last stop that cost more than another one of their kind, request and vehicle.
    With ``kind``, those of one kind alone: only requests with a pickup on a leg have insertions but those after the last stop, which need no legs.
    """
    legs = cut(route_legs(edges, stops, vehicles, k))
    inner, last = legs.where(c("at") < c("n") - 1), legs.where(c("at") == c("n") - 1)
    after, wanted = kind == AFTER_LAST, kind
    if kind is not None and not after:
        near = feasible_distances(edges, inner, pickups.select(c("location").alias("x"))).select(c("x").alias("location")).distinct()
        some = cut(pickups.join(near, "location", "left_semi").select("request_id").distinct())
        requests, pickups, dropoffs = (cut(x.join(some, "request_id", "left_semi")) for x in (requests, pickups, dropoffs))
        labelled = labelled and kind == DROPOFF_AFTER_LAST
    asked = location_ways(requests, edges, "origin", "destination", "direct")
    asked = asked.select("request_id", c("request_time").alias("t0"), c("num_riders").alias("riders"), "direct")
    # A way after the last stop is a detour of its length, and a detour costs ``veh`` a unit.
    most = F.floor(c("upper") / k.veh).cast("long") if upper is not None and k.veh else F.lit(None).cast("long")
    asked = cut((asked.join(growing(upper), "request_id", "left") if upper is not None else asked.withColumn("upper", F.lit(None).cast("long"))).withColumn("most", most))

    def at_legs(found: DataFrame, x: str, on_legs: bool, far: bool) -> DataFrame:
        """Locations with every stop that may go before them: to_x from the stop, from_x to the next one. After last stops those that are ``far``, too, or
        that the route ends at."""
        rows = cut(found.select("request_id", c("location").alias("x"), c("walk").alias(f"{x}_walk"), c("pd_id").alias(f"{x}_id")).join(growing(asked), "request_id"))
        own = ["vehicle_id", "at", "stop", "occ_at", "dep_at", "n", "capacity", "end_service"]
        ways = last_stop_distances(edges, last, rows.select("x", "most")) if far else last.select("vehicle_id", c("stop").alias("x"), zero().alias("to_x"))
        both = rows.join(growing(ways) if far else ways, "x").where("most is null or to_x <= most").withColumn("from_x", zero()).join(last.select(*own), "vehicle_id")
        if on_legs:
            on_leg = rows.join(feasible_distances(edges, inner, rows), "x").join(inner.select(*own), ["vehicle_id", "at"])
            both = on_leg.unionByName(both, allowMissingColumns=True)
        return both.withColumnsRenamed({"x": x, "to_x": f"to_{x}", "from_x": f"from_{x}"})

    p = at_legs(pickups, "p", not after, kind is None or after).where((c("at") == c("n") - 1) | (c("occ_at") + c("riders") <= c("capacity")))
    if not after:
        p = p.join(first_legs(edges, stops), "vehicle_id", "left")
        moving = (c("at") == 0) & (c("n") > 1) & (c("dep_at") < c("t0"))
        p = cut(p.withColumn("here", F.when(moving, current_location(c("path"), c("t0")))).drop("path").withColumn("here_loc", c("here.edge_id")))
        on = location_ways(p.where("here_loc is not null").select("here_loc", "p").distinct(), edges, "here_loc", "p", "on")
        p = p.join(growing(on), ["here_loc", "p"], "left")
        p = p.withColumn("to_p", F.when(moving, c("here.at_head") - c("dep_at") + c("on")).otherwise(c("to_p")))
    p = p.select("request_id", "vehicle_id", c("at").alias("i"), c("p").alias("p_loc"), "p_walk", "p_id", "to_p", "from_p", "t0", "riders", "direct", "n", "capacity", "end_service", "upper")
    at_stop = c("d") == c("stop")
    if after:
        # A pickup that is reached leads to every dropoff with a way from it, so ways from the stop itself aren't needed.
        d = dropoffs.select("request_id", c("location").alias("d_loc"), c("walk").alias("d_walk"), c("pd_id").alias("d_id"))
        direct = pair_labels(edges, pickups, dropoffs, k) if labelled else _direct(edges, pickups, dropoffs)
        rows = p.join(growing(d), "request_id").join(growing(direct), ["request_id", "p_loc", "d_loc"])
        rows = rows.withColumns({"j": c("i"), "to_d": c("pd"), "from_p": zero(), "from_d": zero(), "kind": F.lit(AFTER_LAST)}).drop("pd").join(route_arrays(stops), "vehicle_id")
        if labelled:
            rows = rows.where(~_beaten_pair(k)).drop("worse", "p_more", "most_pd", "most_walk")
        return C.costed(rows, k)
    d = at_legs(dropoffs, "d", kind != DROPOFF_AFTER_LAST, kind in (None, DROPOFF_AFTER_LAST)).where(at_stop | (c("at") == c("n") - 1) | (c("occ_at") + c("riders") <= c("capacity")))
    d = d.select("request_id", "vehicle_id", c("at").alias("j"), c("d").alias("d_loc"), "d_walk", "d_id", c("to_d").alias("stop_to_d"), "from_d", at_stop.alias("at_stop"))
    if labelled:
        direct = pair_labels(edges, pickups, dropoffs, k)
        by_vehicle = Window.partitionBy("request_id", "vehicle_id", "j")
        d = d.join(growing(dropoff_labels(edges, pickups, dropoffs, k)), ["request_id", "d_loc"]).withColumn("stops_here", F.max("at_stop").over(by_vehicle))
    else:
        direct = _direct(edges, pickups, dropoffs)
    apart = p.join(growing(d), ["request_id", "vehicle_id"]).where((c("i") < c("j")) & (c("p_loc") != c("d_loc")) | (c("i") == c("j")))
    rows = apart.join(growing(direct), ["request_id", "p_loc", "d_loc"]).withColumnRenamed("pd", "__pd")
    same = c("i") == c("j")
    rows = rows.withColumn("to_d", F.when(~same, c("stop_to_d")).otherwise(c("__pd")))
    rows = rows.withColumn("from_p", F.when(same, zero()).otherwise(c("from_p"))).withColumn("from_d", F.when(~same & c("at_stop"), zero()).otherwise(c("from_d")))
    last_at = c("n") - 1
    kind = (
        F.when(c("i") == last_at, AFTER_LAST).when((c("j") == last_at) & ~c("at_stop"), DROPOFF_AFTER_LAST)
        .when(c("i") == 0, BEFORE_NEXT).when(same, PAIRED).otherwise(ORDINARY)
    )
    rows = rows.withColumn("kind", kind).where(F.lit(True) if wanted is None else c("kind") == wanted).join(route_arrays(stops), "vehicle_id")
    if labelled:
        leave, ends = _leave_and_end()
        pair = (c("kind") == AFTER_LAST) & _beaten_pair(k)
        late = ends + F.greatest(c("to_p") + k.stop_time, c("t0") + c("p_walk") - leave) + c("from_p") + c("to_d") + c("d_more") + k.stop_time > c("end_service")
        dropoff = (c("kind") == DROPOFF_AFTER_LAST) & c("d_worse") & ~c("stops_here") & ~late
        rows = rows.where(~pair & ~dropoff).drop("worse", "p_more", "most_pd", "most_walk", "d_worse", "d_more", "stops_here")
    return C.costed(rows.drop("stop_to_d", "at_stop", "__pd"), k)


def _direct(edges: DataFrame, pickups: DataFrame, dropoffs: DataFrame) -> DataFrame:
    return pd_distances(edges, pickups.select("request_id", c("location").alias("p")), dropoffs.select("request_id", c("location").alias("d"))).toDF("request_id", "p_loc", "d_loc", "pd")


def _leave_and_end() -> tuple[Column, Column]:
    """When a vehicle may leave for the pickup, and when its route ends without it."""
    leave = F.when(c("n") == 1, F.greatest(C.at("dep", c("i")), c("t0"))).otherwise(C.at("dep", c("i")))
    return leave, F.greatest(C.at("dep", c("n") - 1), c("t0"))


def _beaten_pair(k: C.Config) -> Column:
    """Whether another pair of the request costs less after this last stop. A worse one stays where the better one might end the vehicle's service."""
    leave, ends = _leave_and_end()
    late = ends + F.greatest(c("to_p") + c("p_more") + k.stop_time, c("t0") + c("most_walk") - leave) + c("most_pd") + k.stop_time > c("end_service")
    return c("worse") & (c("p_loc") != C.at("loc", c("i"))) & ~late


def relevant_pickups(edges: DataFrame, stops: DataFrame, vehicles: DataFrame, requests: DataFrame, pickups: DataFrame, dropoffs: DataFrame, upper: DataFrame, k: C.Config) -> DataFrame:
    """Pickups on legs with a seat for the party whose cost alone doesn't exceed the request's ``upper``: (request_id, vehicle_id, i,
    p_id, bound). Legs that a vehicle drives already aren't among them.

    The bound counts the vehicle's detour at the end of its route, walking, waiting too long, the trip with the request's shortest
    ride, and the others' added trip times: an insertion of this pickup costs no less.
    """
    legs = cut(route_legs(edges, stops, vehicles, k))
    asked = location_ways(requests, edges, "origin", "destination", "direct")
    asked = asked.select("request_id", c("request_time").alias("t0"), c("num_riders").alias("riders"), "direct")
    least = pd_distances(edges, pickups.select("request_id", c("location").alias("p")), dropoffs.select("request_id", c("location").alias("d")))
    rows = pickups.select("request_id", c("location").alias("x"), c("walk").alias("p_walk"), c("pd_id").alias("p_id")).join(asked, "request_id")
    rows = rows.join(least.groupBy("request_id").agg(F.min("dist").alias("least")), "request_id").join(upper, "request_id")
    inner = legs.where("next is not null")
    rows = rows.join(feasible_distances(edges, inner, rows), "x").join(inner.select("vehicle_id", "at", "stop", "occ_at", "dep_at", "n", "capacity"), ["vehicle_id", "at"])
    rows = rows.where((c("occ_at") + c("riders") <= c("capacity")) & ~((c("at") == 0) & (c("dep_at") < c("t0"))))
    rows = rows.withColumnRenamed("at", "i").join(route_arrays(stops), "vehicle_id")
    there = ((c("i") > 0) | (c("dep_at") > c("t0"))) & (c("x") == c("stop"))
    dep_p = F.greatest(c("dep_at") + F.when(there, zero()).otherwise(c("to_x") + k.stop_time), c("t0") + c("p_walk"))
    leg = C.at("arr", c("i") + 1) - c("dep_at")
    rows = rows.withColumn("dep_p", dep_p).withColumn("det", F.greatest(c("dep_p") - c("dep_at") + c("from_x") - leg, zero()))
    at_end = F.greatest(c("det") - C.wait_upto(c("n") - 2, c("i"), k), zero())
    trip = C.trip_cost(c("dep_p") - c("t0") + c("least"), c("direct"), k)
    wait = k.wait * F.greatest(c("dep_p") - (c("t0") + k.max_wait), zero())
    bound = k.veh * at_end + k.walk * c("p_walk") + trip + wait + k.psg * C.added_trip(c("i"), c("n") - 1, c("det"), k)
    return rows.withColumn("bound", bound).where("bound <= upper").select("request_id", "vehicle_id", "i", "p_id", "bound")


def promising_dropoffs(edges: DataFrame, requests: DataFrame, dropoffs: DataFrame, k: C.Config) -> DataFrame:
    """Dropoffs whose walk to the destination costs no more than a vehicle's way there would; others never are the best after a
    route's last stop."""
    asked = location_ways(requests, edges, "origin", "destination", "direct").select("request_id", "direct", c("destination").alias("centre"))
    rows = location_ways(dropoffs.join(asked, "request_id"), edges, "location", "centre", "ride")
    on_foot = C.trip_cost(c("walk"), c("direct"), k) + k.walk * c("walk")
    return rows.where(on_foot <= k.veh * c("ride") + C.trip_cost(c("ride"), c("direct"), k)).select("request_id", "location", "walk", "pd_id")


def closest_to_last_stop(edges: DataFrame, stops: DataFrame, found: DataFrame) -> DataFrame:
    """(request_id, vehicle_id, dist, pd_id): of a request's locations the one nearest to each route's last stop, ties by number."""
    n = stops.groupBy("vehicle_id").agg(F.max("stop_idx").alias("stop_idx"))
    last = stops.join(n, ["vehicle_id", "stop_idx"]).select("vehicle_id", c("location").alias("stop")).join(_ends(edges, "stop"), "stop")
    ways = last_stop_distances(edges, last, found.select(c("location").alias("x"), F.lit(None).cast("long").alias("most")))
    rows = found.select("request_id", c("location").alias("x"), "pd_id").join(ways, "x")
    return rows.groupBy("request_id", "vehicle_id").agg(F.min(F.struct(c("to_x").alias("dist"), "pd_id")).alias("m")).select("request_id", "vehicle_id", "m.dist", "m.pd_id")


def walks(edges: DataFrame, foot: DataFrame, requests: DataFrame, k: C.Config) -> DataFrame:
    """(request_id, walk, direct, cost) of going all the way on foot; no walk and no cost where there is no way."""
    rows = location_ways(requests, edges, "origin", "destination", "direct").join(_ends(edges, "origin"), "origin").join(_ends(edges, "destination"), "destination")
    found = pair_distances(foot, rows.select(c("origin_head").alias("source"), c("destination_tail").alias("target"))).toDF("origin_head", "destination_tail", "on_foot")
    rows = rows.join(found, ["destination_tail", "origin_head"], "left").withColumn("walk", c("on_foot") + c("destination_tt"))
    return rows.select("request_id", "walk", "direct", C.walk_cost(c("walk"), c("destination_tt"), c("direct"), k).alias("cost"))


def assignments(requests: DataFrame, costed: DataFrame, on_foot: DataFrame, k: C.Config) -> DataFrame:
    """The log of best assignments: one row a request, -1 where there is no vehicle; a vehicle goes before walking on a tie."""
    leaves = lambda x: F.when(c("n") == 1, F.greatest(C.at("dep", c(x)), c("t0"))).otherwise(C.at("dep", c(x)))
    rows = costed.where(c("cost").isNotNull()).withColumns({"leave": leaves("i"), "leave_d": leaves("j")})
    best = rows.groupBy("request_id").agg(F.min(F.struct("cost", *C.TIES, "arr_d", "n", "leave", "leave_d")).alias("m"))
    direct = on_foot.select("request_id", c("cost").alias("foot"), "walk", "direct")
    rows = requests.select("request_id", "request_time").join(best, "request_id", "left").join(direct, "request_id", "left")
    by_foot = c("foot").isNotNull() & (c("m").isNull() | (c("foot") < c("m.cost")))
    ride = lambda x: F.when(c("m").isNull() | by_foot, -1).otherwise(c(f"m.{x}")).cast("long")
    trip = F.when(by_foot, c("walk")).otherwise(c("m.arr_d") - c("request_time") + c("m.d_walk"))
    logged = {x: x for x in ("vehicle_id", "i", "j", "to_p", "from_p", "to_d", "from_d", "p_id", "p_walk", "d_id", "d_walk")} | {"n_stops": "n", "dep_before_pickup": "leave", "dep_before_dropoff": "leave_d"}
    return rows.select(
        "request_id", "request_time", "direct", *[ride(x).alias(to) for to, x in logged.items()],
        by_foot.alias("not_using_vehicle"), F.when(c("m").isNull() & c("foot").isNull(), -1).otherwise(C.accepted(trip, c("direct"), k).cast("int")).alias("accepted"),
        F.when(by_foot, c("foot")).otherwise(c("m.cost")).alias("cost"),
    )


def located(paths: DataFrame, legs: DataFrame, times: DataFrame, wide: int = 600) -> DataFrame:
    """(request_id, vehicle_id, at_head, location): where vehicles on their way are (vehicle_id, dep, arr_next; and their paths) at
    points in time (request_id, request_time). Legs and times meet by stretches of time: an equi-join."""
    spread = legs.withColumn("slot", F.explode(F.sequence(F.floor(c("dep") / wide), F.floor(c("arr_next") / wide))))
    met = times.withColumn("slot", F.floor(c("request_time") / wide)).join(spread, "slot").where(c("request_time").between(c("dep"), c("arr_next")))
    rows = met.join(paths, "vehicle_id").withColumn("m", current_location(c("path"), c("request_time")))
    return rows.select("request_id", "vehicle_id", "m.at_head", c("m.edge_id").alias("location"))
