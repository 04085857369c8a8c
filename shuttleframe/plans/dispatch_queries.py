"""Queries over schedules, insertion costs, logs and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cost as C
from ..operators import graph as G
from ..operators import schedule as S
from . import fixtures as X
from .network_queries import E_SQL

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}
T = X.STOP_TIME
R = X.ctes("route_stop")
BY = "(PARTITION BY vehicle_id ORDER BY stop_idx)"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("u01_initial_routes", X.ctes("vehicle") + "SELECT vehicle_id, 0 AS stop_idx, initial_location AS location, start_of_service_time AS arr, start_of_service_time AS dep FROM vehicle")
def u01(spark, d) -> DataFrame:
    return X.vehicles(spark, d).select("vehicle_id", F.lit(0).alias("stop_idx"), c("initial_location").alias("location"), c("start_of_service_time").alias("arr"), c("start_of_service_time").alias("dep"))


@query("u03_forward_propagation", R + f"""SELECT vehicle_id, stop_idx, new_dep FROM (SELECT vehicle_id, stop_idx, s + max(CASE WHEN stop_idx=0 THEN dep+900 ELSE dep END - s) OVER {BY} AS new_dep
 FROM (SELECT *, CAST(sum(CASE WHEN stop_idx=0 THEN 0 ELSE arr-prev+{T} END) OVER {BY} AS BIGINT) AS s FROM (SELECT *, lag(dep) OVER {BY} AS prev FROM route_stop)))""")
def u03(spark, d) -> DataFrame:
    return S.delayed(X.route_stops(spark, d), c("dep") + 900, T).select("vehicle_id", "stop_idx", "new_dep")


@query("u04_backward_propagation", R + f"""SELECT vehicle_id, stop_idx, s + min(max_arr - s) OVER (PARTITION BY vehicle_id ORDER BY stop_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS max_arr
 FROM (SELECT *, CAST(coalesce(sum(coalesce(nxt-dep,0)+{T}) OVER (PARTITION BY vehicle_id ORDER BY stop_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS s FROM (SELECT *, lead(arr) OVER {BY} AS nxt FROM route_stop))""")
def u04(spark, d) -> DataFrame:
    return S.bounded(X.route_stops(spark, d), T).select("vehicle_id", "stop_idx", "max_arr")


@query("u05_prefix_sums", R + f"SELECT vehicle_id, stop_idx, CAST(sum(wait) OVER {BY} AS BIGINT) AS wait_upto, CAST(sum(n_dropoffs) OVER {BY} AS BIGINT) AS dropoffs_upto FROM route_stop")
def u05(spark, d) -> DataFrame:
    return S.prefix_sums(X.route_stops(spark, d), T).select("vehicle_id", "stop_idx", "wait_upto", "dropoffs_upto")


@query("u06_leeways", R + f"SELECT vehicle_id, stop_idx, greatest(lead(max_arr) OVER {BY}, lead(dep) OVER {BY}) - dep - {T} AS leeway FROM route_stop")
def u06(spark, d) -> DataFrame:
    return S.leeways(X.route_stops(spark, d), T).select("vehicle_id", "stop_idx", "leeway")


@query("u07_leg_lengths", R + f"SELECT vehicle_id, max(leg) AS longest FROM (SELECT vehicle_id, coalesce(lead(arr) OVER {BY} - dep, 0) AS leg FROM route_stop) GROUP BY vehicle_id")
def u07(spark, d) -> DataFrame:
    return S.legs(X.route_stops(spark, d)).groupBy("vehicle_id").agg(F.max("leg").alias("longest"))


@query("u08_remove_reached_stop", R + "SELECT vehicle_id, stop_idx-1 AS stop_idx, location, CASE WHEN stop_idx=1 THEN 0 ELSE n_dropoffs END AS n_dropoffs FROM route_stop WHERE stop_idx>0")
def u08(spark, d) -> DataFrame:
    return S.without_first(X.route_stops(spark, d)).select("vehicle_id", "stop_idx", "location", "n_dropoffs")


LEG = f"leg AS (SELECT vehicle_id, dep-arr AS stop_time, dep AS dep_time, nxt AS arr_time, nxt-dep AS drive_time, occupancy FROM (SELECT *, lead(arr) OVER {BY} AS nxt FROM route_stop) WHERE nxt IS NOT NULL)"


@query("u17_leg_log", X.ctes("route_stop", more=LEG) + "SELECT * FROM leg")
def u17(spark, d) -> DataFrame:
    return S.leg_rows(X.route_stops(spark, d))


@query("a03_vehicle_times", X.ctes("route_stop", more=LEG) + "SELECT sum(stop_time)/10.0/count(DISTINCT vehicle_id) AS stop_s, sum(CASE WHEN occupancy=1 THEN drive_time END)/10.0/count(DISTINCT vehicle_id) AS low_s, sum(CASE WHEN occupancy>1 THEN drive_time END)/10.0/count(DISTINCT vehicle_id) AS high_s FROM leg")
def a03(spark, d) -> DataFrame:
    n = F.count_distinct("vehicle_id")
    mean = lambda x: F.sum(x) / 10.0 / n
    drive = c("drive_time")
    return u17(spark, d).agg(mean("stop_time").alias("stop_s"), mean(F.when(c("occupancy") == 1, drive)).alias("low_s"), mean(F.when(c("occupancy") > 1, drive)).alias("high_s"))


@query("a04_occupancy_rate", X.ctes("route_stop", more=LEG) + "SELECT CAST(sum(drive_time*occupancy) AS DOUBLE)/sum(drive_time) AS rate FROM leg")
def a04(spark, d) -> DataFrame:
    return u17(spark, d).agg((F.sum(c("drive_time") * c("occupancy")) / F.sum("drive_time")).alias("rate"))


QUAL = "quality AS (SELECT request_id, (request_id*37)%3000 AS wait_time, (request_id*91)%9000 AS ride_time, (request_id*37)%3000+(request_id*91)%9000 AS trip_time, (request_id*13)%2000 AS direct, (request_id*7)%5=0 AS rejected FROM request)"


def quality(spark, d) -> DataFrame:
    k = c("request_id")
    return X.requests(spark, d).select("request_id", (k * 37 % 3000).alias("wait_time"), (k * 91 % 9000).alias("ride_time"), (k * 37 % 3000 + k * 91 % 9000).alias("trip_time"), (k * 13 % 2000).alias("direct"), (k * 7 % 5 == 0).alias("rejected"))


@query("a01_quality_means", X.ctes("n", "request", more=QUAL) + "SELECT avg(wait_time)/10 AS wait_s, quantile_cont(wait_time, 0.95)/10 AS wait_q95, avg(trip_time)/10 AS trip_s, quantile_cont(trip_time, 0.95)/10 AS trip_q95 FROM quality")
def a01(spark, d) -> DataFrame:
    q = lambda x: F.percentile(x, F.lit(0.95)) / 10
    return quality(spark, d).agg((F.avg("wait_time") / 10).alias("wait_s"), q("wait_time").alias("wait_q95"), (F.avg("trip_time") / 10).alias("trip_s"), q("trip_time").alias("trip_q95"))


@query("a02_relative_delay", X.ctes("n", "request", more=QUAL) + "SELECT round(avg(CASE WHEN direct=0 THEN 1.0::DOUBLE ELSE trip_time/direct END), 9) AS delay FROM quality")
def a02(spark, d) -> DataFrame:
    return quality(spark, d).agg(F.round(F.avg(F.when(c("direct") == 0, 1.0).otherwise(c("trip_time") / F.nullif(c("direct"), F.lit(0)))), 9).alias("delay"))


@query("a05_service_rate", X.ctes("n", "request", more=QUAL) + "SELECT avg(CASE WHEN rejected THEN 0.0 ELSE 1.0 END) AS rate FROM quality")
def a05(spark, d) -> DataFrame:
    return quality(spark, d).agg(F.avg(F.when(c("rejected"), 0.0).otherwise(1.0)).alias("rate"))


@query("a06_counted_events", "SELECT count(*) FILTER (event_type='click') AS n FROM events")
def a06(spark, d) -> DataFrame:
    return X.table(spark, d, "events").agg(F.count(F.when(c("event_type") == "click", 1)).alias("n"))


@query("a07_request_subset", X.ctes("n", "request", more=QUAL) + "SELECT request_id, trip_time FROM quality WHERE request_id IN (SELECT c_custkey*3 FROM customer)")
def a07(spark, d) -> DataFrame:
    some = X.table(spark, d, "customer").select((X.L("c_custkey") * 3).alias("request_id"))
    return quality(spark, d).join(some, "request_id", "left_semi").select("request_id", "trip_time")


@query("a09_event_times", "SELECT event_type AS type, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a09(spark, d) -> DataFrame:
    return X.table(spark, d, "events").groupBy(c("event_type").alias("type")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query("a10_first_difference", X.ctes("n", "request", more=QUAL) + "SELECT min(request_id) AS first FROM quality WHERE wait_time IS DISTINCT FROM CASE WHEN request_id%997=996 THEN NULL ELSE wait_time END")
def a10(spark, d) -> DataFrame:
    a = quality(spark, d).select("request_id", "wait_time")
    b = a.select("request_id", F.when(c("request_id") % 997 != 996, c("wait_time")).alias("other"))
    return a.join(b, "request_id").where(~c("wait_time").eqNullSafe(c("other"))).agg(F.min("request_id").alias("first"))


@query("c13_max_trip_time", X.ctes("n", "request", more=QUAL) + "SELECT request_id, CAST(floor(1.7::DOUBLE*direct) AS BIGINT)+1200 AS max_trip, trip_time+10*greatest(trip_time-(CAST(floor(1.7::DOUBLE*direct) AS BIGINT)+1200),0) AS trip_cost FROM quality")
def c13(spark, d) -> DataFrame:
    k = C.Config()
    return quality(spark, d).select("request_id", C.max_trip(c("direct"), k).alias("max_trip"), C.trip_cost(c("trip_time"), c("direct"), k).alias("trip_cost"))


@query("c11_added_trip_time", R + f"""SELECT a.vehicle_id, CAST(coalesce(sum(b.n_dropoffs*greatest(700-(b.w-b.wait-a.w),0)),0) AS BIGINT) AS added
 FROM (SELECT *, sum(wait) OVER {BY} AS w FROM route_stop) a JOIN (SELECT *, sum(wait) OVER {BY} AS w FROM route_stop) b ON a.vehicle_id=b.vehicle_id AND a.stop_idx=0 AND b.stop_idx>0 GROUP BY a.vehicle_id""")
def c11(spark, d) -> DataFrame:
    r = routes(X.route_stops(spark, d)).where("n > 1")
    return r.select("vehicle_id", C.added_trip(F.lit(0), c("n") - 1, F.lit(700), C.Config()).alias("added"))


def routes(stops: DataFrame) -> DataFrame:
    """One row a vehicle: its stops as arrays. A route is a few dozen stops."""
    fields = {"arr": "arr", "dep": "dep", "max_arr": "max_arr", "occupancy": "occ", "n_dropoffs": "n_drop", "location": "loc"}
    one = stops.groupBy("vehicle_id").agg(F.array_sort(F.collect_list(F.struct("stop_idx", *fields))).alias("s"))
    return one.select("vehicle_id", F.size("s").cast("long").alias("n"), *[c(f"s.{f}").alias(to) for f, to in fields.items()])


IDLE = """, o AS (SELECT request_id, request_time, origin, destination, num_riders, e.tail AS v, e.travel_time AS tt FROM request JOIN edge e ON e.edge_id=origin)
, rv(s, v, d) USING KEY (s, v) AS (SELECT h, h, CAST(0 AS BIGINT) FROM (SELECT DISTINCT head AS h FROM vehicle JOIN edge ON edge_id=initial_location) UNION SELECT q.s, q.head, min(q.d) FROM (SELECT rv.s, head, rv.d+travel_time AS d FROM rv JOIN edge ON tail=rv.v) q LEFT JOIN recurring.rv o ON o.s=q.s AND o.v=q.head WHERE o.d IS NULL OR q.d<o.d GROUP BY q.s, q.head)"""


@query(
    "j23_nearest_idle_vehicle",
    X.ctes("edge", "vehicle", "request", recursive=True, more=IDLE[2:])
    + "SELECT request_id, (m).v AS vehicle_id, (m).d AS dist FROM (SELECT request_id, min({'d': CASE WHEN x.initial_location=o.origin THEN 0 ELSE rv.d+o.tt END, 'v': x.vehicle_id}) AS m FROM o JOIN rv ON rv.v=o.v JOIN edge h ON h.head=rv.s JOIN vehicle x ON x.initial_location=h.edge_id WHERE x.capacity>=o.num_riders GROUP BY request_id)",
)
def j23(spark, d) -> DataFrame:
    """The nearest idle vehicle with enough seats of every request: one search for each number of riders, from all vehicles at once."""
    e, r, v = X.edges(spark, d), X.requests(spark, d), X.vehicles(spark, d)
    levels = r.select(c("num_riders").alias("level")).distinct()
    fits = v.join(levels, c("capacity") >= c("level"))  # as many rows a vehicle as there are party sizes
    at = fits.join(e.select(c("edge_id").alias("initial_location"), c("head").alias("vertex_id")), "initial_location")
    near = G.nearest_labels(e, at.select("level", "vertex_id", F.lit(0).cast("long").alias("dist"), c("vehicle_id").alias("label")))
    o = r.join(e.select(c("edge_id").alias("origin"), c("tail").alias("vertex_id"), "travel_time"), "origin").withColumn("level", c("num_riders"))
    found = o.join(near, ["level", "vertex_id"], "left")
    # A vehicle at the very location needs no way.
    here = fits.groupBy("level", c("initial_location").alias("origin")).agg(F.min("vehicle_id").alias("here"))
    way = F.when(c("label").isNotNull(), F.struct((c("dist") + c("travel_time")).alias("d"), c("label").alias("v")))
    stay = F.when(c("here").isNotNull(), F.struct(F.lit(0).cast("long").alias("d"), c("here").alias("v")))
    m = F.least(way, stay)
    return found.join(here, ["level", "origin"], "left").select("request_id", m.alias("m")).where("m is not null").select("request_id", c("m.v").alias("vehicle_id"), c("m.d").alias("dist"))


def replayed(spark, d, log: str) -> DataFrame:
    """A log of the replay of a request of every customer against the fleet, with places to get on and off in walking distance."""
    from ..operators import dispatch as D
    from ..operators import locations as P
    from .location_queries import RADIUS
    from .simulation import simulate, with_places

    n, k, e = X.vertices(spark, d).count(), X.L("c_custkey"), X.edges(spark, d)
    asked = X.table(spark, d, "customer").select(
        k.alias("request_id"), X._off_five(k * 53 % (4 * n - 1)).alias("origin"), X._off_five((k * 131 + 17) % (4 * n - 1)).alias("destination"),
        (k * 60).alias("request_time"), (1 + k % 2).alias("num_riders"),
    )
    foot = e.where("psg_edge_id IS NOT NULL")
    p = P.with_centre(P.pickups(asked, e, foot, RADIUS), asked.select("request_id", c("origin").alias("centre")))
    o = P.with_centre(P.dropoffs(asked, e, foot, RADIUS), asked.select("request_id", c("destination").alias("centre")))
    return simulate(e, X.vehicles(spark, d), with_places(asked, p, o, D.walks(e, foot, asked, C.Config())), log=log)


@query("u13_simulation")
def u13(spark, d) -> DataFrame:
    """One row an arrival at a destination."""
    return replayed(spark, d, "quality")


@query("u13_replayed_logs")
def u13_logs(spark, d) -> DataFrame:
    """All logs of one replay: arrivals, legs, the full log of best assignments, events, and stops with who got on and off."""
    return replayed(spark, d, "all")


@query("w04_streaming_bins", X.ctes("n", "request") + "SELECT request_time//3000 AS bin, count(*) AS n FROM request GROUP BY 1")
def w04(spark, d) -> DataFrame:
    from ..streaming.bins import request_bins

    return request_bins(spark, d)



@query("w02_vehicle_timers", X.ctes("route_stop") + "SELECT vehicle_id, arr*100 AS time_ms, 'arrival' AS kind FROM route_stop UNION ALL SELECT vehicle_id, dep*100, 'departure' FROM route_stop")
def w02(spark, d) -> DataFrame:
    """Arrivals and departures, told by timers as the clock of a stream reaches them."""
    from ..streaming.clock import replayed_stops

    return replayed_stops(spark, d)


@query(
    "w03_late_requests",
    X.ctes("n", "request", more="t AS (SELECT request_id, request_time*100 AS ms, request_time*100*3//(m+1) AS own FROM request CROSS JOIN (SELECT max(request_time)*100 AS m FROM request)), b AS (SELECT *, least(own+CASE WHEN request_id%10=3 THEN 1 ELSE 0 END, 2) AS batch FROM t), newest AS (SELECT batch, max(ms) AS newest FROM b GROUP BY 1)")
    + "SELECT request_id, coalesce(ms < (SELECT max(newest) FROM newest x WHERE x.batch<b.batch)-60000, false) AS late FROM b",
)
def w03(spark, d) -> DataFrame:
    """Requests that come a batch too late are told apart from those in time, and none is lost."""
    from ..streaming.clock import late_requests

    return late_requests(spark, d)


FULL = QUAL.replace("(request_id*7)%5=0 AS rejected", "(request_id*7)%5=0 AS rejected, (request_id*11)%700 AS walk_on, (request_id*17)%400 AS walk_off, (request_id*53)%20000 AS cost")
MEANS = {"wait": "wait_time", "ride": "ride_time", "trip": "trip_time", "walk_on": "walk_on", "walk_off": "walk_off"}


@query("a01_quality_in_full", X.ctes("n", "request", more=FULL) + "SELECT " + ", ".join(f"round(avg({x})/10, 9) AS {n}_s, quantile_cont({x}, 0.95)/10 AS {n}_q95" for n, x in MEANS.items()) + ", round(avg(cost), 9) AS cost, avg(CASE WHEN rejected THEN 0.0 ELSE 1.0 END) AS service_rate FROM quality")
def a01_full(spark, d) -> DataFrame:
    """Means and 95 % quantiles of waiting, riding, whole trips and both walks, mean cost, and the share of requests that were served."""
    k = c("request_id")
    rows = quality(spark, d).withColumns({"walk_on": k * 11 % 700, "walk_off": k * 17 % 400, "cost": k * 53 % 20000})
    parts = [f(x).alias(f"{n}_{s}") for n, x in MEANS.items() for s, f in (("s", lambda x: F.round(F.avg(x) / 10, 9)), ("q95", lambda x: F.percentile(x, F.lit(0.95)) / 10))]
    return rows.agg(*parts, F.round(F.avg("cost"), 9).alias("cost"), F.avg(F.when(c("rejected"), 0.0).otherwise(1.0)).alias("service_rate"))


@query(
    "a03_vehicle_times_in_full",
    X.ctes("route_stop", "vehicle", more=LEG) + "SELECT sum(stop_time)/10.0/v AS stop_s, sum(CASE WHEN occupancy-1=0 THEN drive_time ELSE 0 END)/10.0/v AS empty_s, sum(CASE WHEN occupancy-1>0 THEN drive_time ELSE 0 END)/10.0/v AS occupied_s, sum(stop_time+drive_time)/10.0/v AS operation_s FROM leg, (SELECT count(*) AS v FROM vehicle) GROUP BY v",
)
def a03_full(spark, d) -> DataFrame:
    """Seconds that a vehicle of the fleet stops, drives empty and occupied, and both together; occupancies count from 0 here."""
    legs = u17(spark, d).withColumn("occupancy", c("occupancy") - 1)
    return S.vehicle_times(legs, X.vehicles(spark, d).count())


EVENT_LOG = "log AS (SELECT start_of_service_time AS t, 'VehicleStartup' AS type FROM vehicle UNION ALL SELECT request_time, 'RequestReceipt' FROM request)"


@query("a06_fleet_size", X.ctes("vehicle", "request", more=EVENT_LOG) + "SELECT count(*) FILTER (type='VehicleStartup') AS n FROM log")
def a06_fleet(spark, d) -> DataFrame:
    """Vehicles of a run by its log of events: those that started up."""
    started = X.vehicles(spark, d).select(c("start_of_service_time").alias("t"), F.lit("VehicleStartup").alias("type"))
    log = started.unionByName(X.requests(spark, d).select(c("request_time").alias("t"), F.lit("RequestReceipt").alias("type")))
    return log.agg(F.count(F.when(c("type") == "VehicleStartup", 1)).alias("n"))
