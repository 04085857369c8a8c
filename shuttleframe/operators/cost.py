"""Cost and constraints of inserting a request into a route, as column expressions over one wide candidate row.

A candidate has the route's arrays ``arr, dep, max_arr, occ, n_drop, loc`` (by stop), ``n`` stops, the places ``i`` and ``j``
(pickup after stop i, dropoff after stop j), pickup ``p_loc, p_walk``, dropoff ``d_loc, d_walk``, four distances
``to_p, from_p, to_d, from_d``, request time ``t0``, ``riders``, ``direct`` distance, and the vehicle's ``capacity`` and
``end_service``. Times are deciseconds. A NULL distance makes the cost NULL, that is: no assignment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


@dataclass(frozen=True)
class Config:
    """Run parameters; the defaults are those of the command line."""

    stop_time: int = 600
    alpha: float = 1.7
    beta: int = 1200
    max_wait: int = 3000
    epsilon: float = 0.0
    phi: int = 1200
    pickup_radius: int = 3000
    dropoff_radius: int = 3000
    psg: int = 1
    walk: int = 0
    veh: int = 1
    wait: int = 1
    trip: int = 10


def at(array: str, i: Column) -> Column:
    return F.try_element_at(c(array), (i + 1).cast("int"))


def max_trip(direct: Column, k: Config) -> Column:
    return F.floor(F.lit(k.alpha) * direct).cast("long") + k.beta


def trip_cost(trip: Column, direct: Column, k: Config) -> Column:
    return k.psg * trip + k.trip * F.greatest(trip - max_trip(direct, k), F.lit(0))


def wait_upto(last: Column, first: Column, k: Config) -> Column:
    """Waiting time of the vehicle at stops after ``first`` up to ``last``; 0 if there are none."""
    stops = F.when(last > first, F.sequence((first + 1).cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(stops, F.lit(0).cast("long"), lambda acc, s: acc + at("dep", s) - at("arr", s) - k.stop_time)


def added_trip(a: Column, b: Column, detour: Column, k: Config) -> Column:
    """Trip time that a detour adds to those who leave at stops a+1..b, waits on the way taken off."""
    stops = F.when(b > a, F.sequence((a + 1).cast("int"), b.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(stops, F.lit(0).cast("long"), lambda acc, s: acc + at("n_drop", s) * F.greatest(detour - wait_upto(s - 1, a, k), F.lit(0)))


def costed(rows: DataFrame, k: Config) -> DataFrame:
    """The rows with dep_p, arr_d, detours, feasible, cost (NULL if not feasible) and its parts."""
    i, j, n, t = c("i"), c("j"), c("n"), k.stop_time
    zero = F.lit(0).cast("long")
    leave = F.when(n == 1, F.greatest(at("dep", zero), c("t0"))).otherwise(at("dep", i))
    making_stop = (i > 0) | (at("dep", zero) > c("t0"))
    leg = lambda s: F.when(s + 1 < n, at("arr", s + 1) - at("dep", s)).otherwise(zero)
    rows = rows.withColumn("p_at_stop", making_stop & (c("p_loc") == at("loc", i))).withColumn("d_at_stop", (i != j) & (c("d_loc") == at("loc", j)))
    rows = rows.withColumn("leave", leave).withColumn("dep_p", F.greatest(c("leave") + F.when(c("p_at_stop"), zero).otherwise(c("to_p") + t), c("t0") + c("p_walk")))
    rows = rows.withColumn("det_p", c("dep_p") - c("leave") + F.when(i != j, c("from_p") - leg(i)).otherwise(zero))
    reach = at("arr", j) + F.greatest(c("det_p") - wait_upto(j - 1, i, k), zero)
    later = F.when(c("d_at_stop"), reach).otherwise(F.greatest(at("dep", j), reach + t) + c("to_d"))
    rows = rows.withColumn("arr_d", F.when(i == j, c("dep_p") + c("to_d")).otherwise(later))
    rows = rows.withColumn("det_d0", F.when(c("d_at_stop"), zero).otherwise(c("to_d") + t + c("from_d") - leg(j)))
    residual = F.when(i == j, c("det_p")).otherwise(F.greatest(c("det_p") - wait_upto(j, i, k), zero))
    rows = rows.withColumn("det_d", F.greatest(residual + c("det_d0"), zero))
    rows = rows.withColumn("det_end", F.greatest(c("det_d") - wait_upto(n - 2, j, k), zero))
    others = F.when(i != j, added_trip(i, j, c("det_p"), k)).otherwise(zero) + added_trip(j, n - 1, c("det_d"), k)
    trip = c("arr_d") - c("t0") + c("d_walk")
    parts = {
        "cost_vehicle": k.veh * c("det_end"),
        "cost_walk": k.walk * (c("p_walk") + c("d_walk")),
        "cost_trip": trip_cost(trip, c("direct"), k),
        "cost_wait": k.wait * F.greatest(c("dep_p") - (c("t0") + k.max_wait), zero),
        "cost_others": k.psg * others,
    }
    full = F.when(c("d_at_stop"), F.slice("occ", (i + 1).cast("int"), (j - i).cast("int"))).otherwise(F.slice("occ", (i + 1).cast("int"), (j - i + 1).cast("int")))
    service = F.greatest(at("dep", n - 1), c("t0")) + c("det_end") > c("end_service")
    broken = service | (
        (i + 1 < n)
        & (
            ((i != j) & (c("det_p") != 0) & (at("arr", i + 1) + c("det_p") > at("max_arr", i + 1)))
            | F.coalesce(F.array_max(full) + c("riders") > c("capacity"), F.lit(False))
            | ((j + 1 < n) & (c("det_d") != 0) & (at("arr", j + 1) + c("det_d") > at("max_arr", j + 1)))
        )
    )
    rows = rows.withColumns(parts).withColumn("feasible", ~F.coalesce(broken, F.lit(False)))
    total = sum((c(p) for p in parts), F.lit(0).cast("long"))
    return rows.withColumn("cost", F.when(c("feasible"), total))


def walk_sides(distance: Column, last_edge: Column, k: Config) -> tuple[Column, Column]:
    """A walk's part at the origin and at the destination: what goes beyond both radii is halved, and the last edge is whole."""
    over = F.greatest(distance - (k.pickup_radius + k.dropoff_radius), F.lit(0))
    side = F.greatest(k.dropoff_radius + F.floor(over / 2), last_edge)
    return distance - side, side


def walk_cost(distance: Column, last_edge: Column, direct: Column, k: Config) -> Column:
    """Cost of walking all the way, split into an origin and a destination side."""
    origin, side = walk_sides(distance, last_edge, k)
    return k.walk * origin + k.walk * side + trip_cost(origin + side, direct, k)


def cutoff_by_vehicle(cost: Column, longest_leg: Column, k: Config) -> Column | None:
    """The least way to or from a place whose cost for the vehicle alone reaches ``cost``, whatever leg it replaces."""
    return None if not k.veh else F.ceil(cost / k.veh).cast("long") + longest_leg


def cutoff_by_vehicle_and_trip(cost: Column, longest_leg: Column, k: Config) -> Column:
    """... for the vehicle and the passenger, whose trip it is part of."""
    return F.ceil((cost + k.veh * longest_leg) / (k.veh + k.psg)).cast("long")


def bound_after_last_stop(k: Config) -> Column:
    """What an insertion after the last stop costs at least, of columns to_p, p_walk, p_loc, loc, i, dep, n, t0, direct and
    ``least``, the least way from a pickup of the request to a dropoff."""
    there = ((c("i") > 0) | (at("dep", F.lit(0).cast("long")) > c("t0"))) & (c("p_loc") == at("loc", c("i")))
    leave = F.greatest(at("dep", c("i")), c("t0"))
    dep_p = F.greatest(leave + F.when(there, 0).otherwise(c("to_p") + k.stop_time), c("t0") + c("p_walk"))
    wait = F.greatest(dep_p - (c("t0") + k.max_wait), F.lit(0))
    return k.veh * (c("least") + c("to_p")) + k.walk * c("p_walk") + k.wait * wait + trip_cost(dep_p - c("t0") + c("least"), c("direct"), k)


#: Ties: cost, then these in order.
TIES = ("vehicle_id", "i", "j", "p_walk", "d_walk", "p_id", "d_id", "to_p", "to_d", "from_p", "from_d")


def best(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """The cheapest candidate of each request by cost and TIES; candidates without cost don't count."""
    m = F.min(F.struct("cost", *TIES, "dep_p", "arr_d", "det_end"))
    return rows.where(c("cost").isNotNull()).groupBy(key).agg(m.alias("m")).select(key, "m.*")


def accepted(trip: Column, direct: Column, k: Config) -> Column:
    return F.lit(True) if k.epsilon == 0 else trip <= k.epsilon * direct + k.phi
