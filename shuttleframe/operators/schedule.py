"""Schedules as (vehicle_id, stop_idx, arr, dep, max_arr, n_dropoffs, ...) rows: propagation as window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def by():
    return Window.partitionBy("vehicle_id").orderBy("stop_idx")


def upto(last: int = 0):
    return by().rowsBetween(Window.unboundedPreceding, last)


def legs(stops: DataFrame) -> DataFrame:
    """leg: time from a stop's departure to the next one's arrival; 0 at the last stop."""
    return stops.withColumn("leg", F.coalesce(F.lead("arr").over(by()) - c("dep"), F.lit(0)))


def delayed(stops: DataFrame, first_dep, stop_time: int) -> DataFrame:
    """new_arr, new_dep after stop 0 leaves at ``first_dep`` or later: planned departures stay where slack absorbs the delay.

    dep'[l] = max(dep[l], dep'[l-1] + leg[l-1] + T) unrolls to S[l] + max over k <= l of (b[k] - S[k]), S the running sum of
    legs and stop times and b the planned departures: one running maximum instead of a loop.
    """
    s = F.sum(F.when(c("stop_idx") > 0, c("leg_in") + stop_time).otherwise(0)).over(upto())
    rows = legs(stops).withColumn("leg_in", F.coalesce(F.lag("leg").over(by()), F.lit(0))).withColumn("s", s)
    b = F.when(c("stop_idx") == 0, F.greatest(c("dep"), first_dep)).otherwise(c("dep"))
    rows = rows.withColumn("new_dep", c("s") + F.max(b - c("s")).over(upto()))
    arr = F.when(c("stop_idx") == 0, c("arr")).otherwise(F.lag("new_dep").over(by()) + c("leg_in"))
    return rows.withColumn("new_arr", arr).drop("s", "leg_in", "leg")


def bounded(stops: DataFrame, stop_time: int) -> DataFrame:
    """max_arr tightened backwards: no later than the next stop's bound less the leg and the stop: a suffix minimum."""
    rows = legs(stops).withColumn("s", F.coalesce(F.sum(c("leg") + stop_time).over(upto(-1)), F.lit(0)))
    return rows.withColumn("max_arr", c("s") + F.min(c("max_arr") - c("s")).over(by().rowsBetween(0, Window.unboundedFollowing))).drop("s", "leg")


def prefix_sums(stops: DataFrame, stop_time: int) -> DataFrame:
    """wait_upto, dropoffs_upto, wait_dropoffs: running waits, dropoffs, and waits before each dropoff."""
    wait = c("dep") - c("arr") - stop_time
    before = F.coalesce(F.sum(F.greatest(wait, F.lit(0))).over(upto(-1)), F.lit(0))
    rows = stops.withColumn("wait_upto", F.sum(F.greatest(wait, F.lit(0))).over(upto())).withColumn("wait_before", before)
    return rows.withColumn("dropoffs_upto", F.sum("n_dropoffs").over(upto())).withColumn("wait_dropoffs", F.sum(c("n_dropoffs") * c("wait_before")).over(upto()))


def leeways(stops: DataFrame, stop_time: int) -> DataFrame:
    """leeway: the most that a detour may take on the leg that a stop begins; none at the last one."""
    following = F.greatest(F.lead("max_arr").over(by()), F.lead("dep").over(by()))
    return stops.withColumn("leeway", following - c("dep") - stop_time)


def without_first(stops: DataFrame) -> DataFrame:
    """The schedule after its first stop is left behind: the next one is stop 0, its dropoffs are done."""
    left = stops.where(c("stop_idx") > 0)
    return left.withColumn("stop_idx", c("stop_idx") - 1).withColumn("n_dropoffs", F.when(c("stop_idx") == 0, 0).otherwise(c("n_dropoffs")))


def leg_rows(stops: DataFrame) -> DataFrame:
    """A row for each arrival: vehicle_id, stop_time, dep_time, arr_time, drive_time, occupancy of the leg before it."""
    rows = stops.withColumn("arr_time", F.lead("arr").over(by())).where(c("arr_time").isNotNull())
    return rows.select(
        "vehicle_id", (c("dep") - c("arr")).alias("stop_time"), c("dep").alias("dep_time"), "arr_time", (c("arr_time") - c("dep")).alias("drive_time"), "occupancy"
    )


def vehicle_times(legs: DataFrame, n_vehicles: int) -> DataFrame:
    """Seconds a vehicle of the fleet: stopping, driving empty, driving occupied, in operation."""
    drive, per = c("drive_time"), lambda x: F.sum(x) / 10.0 / n_vehicles
    return legs.agg(
        per(c("stop_time")).alias("stop_s"), per(F.when(c("occupancy") == 0, drive).otherwise(0)).alias("empty_s"),
        per(F.when(c("occupancy") > 0, drive).otherwise(0)).alias("occupied_s"), per(c("stop_time") + drive).alias("operation_s"),
    )
