"""Queries over the insertions of requests into a fleet's routes by distances of the network, with their SQL.

The fleet is a row for each nation, whose routes of one to four stops keep the network's distances; a request a supplier. The
SQL tries every insertion over all distances, which takes it minutes with some hundred vehicles.
The SQL enumerates every insertion without pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cost as C
from ..operators import dispatch as D
from ..operators import locations as P
from ..operators import schedule as S
from ..storage import cut
from . import fixtures as X
from .location_queries import CENTRED, DROPOFF, FOOT, PICKUP, RADIUS

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}
T = X.STOP_TIME
K = C.Config()


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


def requests(spark, d) -> DataFrame:
    n, s = X.vertices(spark, d).count(), X.L("s_suppkey")
    return X.table(spark, d, "supplier").select(
        s.alias("request_id"), X._off_five((s * 53 + 7) % (4 * n - 1)).alias("origin"), X._off_five((s * 131 + 17) % (4 * n - 1)).alias("destination"),
        (s * 7 % 40 * 30).alias("request_time"), (1 + F.when(s % 7 == 0, 1).otherwise(0)).cast("long").alias("num_riders"),
    )


def fleet(spark, d) -> DataFrame:
    v = X.L("n_nationkey")
    return X.table(spark, d, "nation").select(v.alias("vehicle_id"), (2 + v % 4).alias("capacity"), F.lit(1_080_000).cast("long").alias("end_of_service_time"))


def stops(spark, d) -> DataFrame:
    """Routes whose legs are the network's distances; vehicles with one stop are idle."""
    e, v, k = X.edges(spark, d), c("vehicle_id"), c("stop_idx")
    n = X.vertices(spark, d).count()
    rows = fleet(spark, d).select("vehicle_id", F.explode(F.sequence(F.lit(0).cast("long"), v % 4)).alias("stop_idx"))
    rows = rows.withColumn("location", (v * 37 + k * 211 + 1) % (4 * n)).withColumn("before", F.coalesce(F.lag("location").over(S.by()), "location"))
    rows = D.location_ways(rows, e, "before", "location", "leg_in").withColumn("wait", F.when(k > 0, k * v % 3 * 100).otherwise(0))
    start = F.when(v % 4 == 0, 0).otherwise(v % 5 * 300 - 300)
    arr = start + F.sum("leg_in").over(S.upto()) + F.coalesce(F.sum(T + c("wait")).over(S.upto(-1)), F.lit(0))
    rows = rows.withColumn("arr", arr).withColumn("dep", F.when(v % 4 == 0, c("arr")).otherwise(c("arr") + T + c("wait")))
    occupied = F.when(k < v % 4, (v + k) % 3).otherwise(0)
    return rows.select(
        "vehicle_id", "stop_idx", "location", "arr", "dep", (c("arr") + 900 + (v * 7 + k * 5) % 6 * 400).alias("max_arr"),
        F.when(k > 0, (v + k) % 2).otherwise(0).alias("n_dropoffs"), occupied.alias("occupancy"),
    )


def candidates(spark, d, pruned: bool = False, labelled: bool = False, kind: str | None = None) -> DataFrame:
    """Insertions of all requests; all of them, or those that may be the best, or the best of their kind, or of one kind."""
    e, r = X.edges(spark, d), requests(spark, d)
    foot = e.where("psg_edge_id IS NOT NULL")
    p = cut(P.with_centre(P.pickups(r, e, foot, RADIUS), r.select("request_id", c("origin").alias("centre"))))
    o = cut(P.with_centre(P.dropoffs(r, e, foot, RADIUS), r.select("request_id", c("destination").alias("centre"))))
    s, v = cut(stops(spark, d)), fleet(spark, d)
    upper = D.upper_bounds(e, s, v, r, K) if pruned else None
    return D.insertions(e, s, v, r, p, o, K, upper, labelled, kind)


REQUEST = """request AS (SELECT s_suppkey AS request_id, o + CASE WHEN o%5=0 THEN 1 ELSE 0 END AS origin, q + CASE WHEN q%5=0 THEN 1 ELSE 0 END AS destination, s_suppkey*7%40*30 AS request_time,
 CAST(1+CASE WHEN s_suppkey%7=0 THEN 1 ELSE 0 END AS BIGINT) AS num_riders FROM (SELECT s_suppkey, (s_suppkey*53+7)%(4*n-1) AS o, (s_suppkey*131+17)%(4*n-1) AS q FROM supplier CROSS JOIN n))"""
ON_FOOT = DROPOFF[len(FOOT) + 2 :].replace("w(s, v, d)", "w2(s, v, d)").replace("FROM w JOIN", "FROM w2 JOIN").replace("JOIN w ON", "JOIN w2 ON")
NUMBER = "CASE WHEN location={0} THEN 0 WHEN r=0 THEN max(CASE WHEN location={0} THEN r END) OVER (PARTITION BY request_id) ELSE r END"
PLACES = f"""{PICKUP}, {ON_FOOT}{CENTRED},
 own_d AS (SELECT request_id, location, min(walk) AS walk FROM (SELECT * FROM dropoff UNION ALL SELECT request_id, destination, 0 FROM request) GROUP BY 1, 2),
 pk AS (SELECT *, {NUMBER.format("origin")} AS id FROM (SELECT own.*, origin, row_number() OVER (PARTITION BY request_id ORDER BY location)-1 AS r FROM own JOIN request USING (request_id))),
 dp AS (SELECT *, {NUMBER.format("destination")} AS id FROM (SELECT own_d.*, destination, row_number() OVER (PARTITION BY request_id ORDER BY location)-1 AS r FROM own_d JOIN request USING (request_id)))"""
ROUTES = f"""rs0 AS (SELECT CAST(vid AS BIGINT) AS vehicle_id, CAST(k AS BIGINT) AS stop_idx, (vid*37+k*211+1)%(4*n) AS location FROM (SELECT vid, unnest(range(vid%4+1)) AS k FROM (SELECT n_nationkey AS vid FROM nation)) CROSS JOIN n),
 places AS (SELECT location FROM rs0 UNION SELECT location FROM pk UNION SELECT location FROM dp UNION SELECT destination FROM request),
 rt(t, v, d) USING KEY (t, v) AS (SELECT tail, tail, CAST(0 AS BIGINT) FROM places JOIN edge ON edge_id=location GROUP BY tail UNION SELECT q.t, q.tail, min(q.d) FROM (SELECT rt.t, tail, rt.d+travel_time AS d FROM rt JOIN edge ON head=rt.v) q LEFT JOIN recurring.rt o ON o.t=q.t AND o.v=q.tail WHERE o.d IS NULL OR q.d<o.d GROUP BY q.t, q.tail),
 rs1 AS (SELECT r.*, CASE WHEN stop_idx>0 THEN stop_idx*vehicle_id%3*100 ELSE 0 END AS wait, CASE WHEN b IS NULL OR b=location THEN 0 ELSE (SELECT rt.d FROM rt, edge x, edge y WHERE x.edge_id=b AND y.edge_id=location AND rt.t=y.tail AND rt.v=x.head)+(SELECT travel_time FROM edge WHERE edge_id=location) END AS leg FROM (SELECT *, lag(location) OVER (PARTITION BY vehicle_id ORDER BY stop_idx) AS b FROM rs0) r),
 rs2 AS (SELECT *, CAST(CASE WHEN vehicle_id%4=0 THEN 0 ELSE vehicle_id%5*300-300 END + sum(leg) OVER w + sum({T}+wait) OVER w - ({T}+wait) AS BIGINT) AS arr FROM rs1 WINDOW w AS (PARTITION BY vehicle_id ORDER BY stop_idx)),
 rs AS (SELECT vehicle_id, stop_idx, location, arr, CASE WHEN vehicle_id%4=0 THEN arr ELSE arr+{T}+wait END AS dep, arr+900+(vehicle_id*7+stop_idx*5)%6*400 AS max_arr,
  CASE WHEN stop_idx>0 THEN (vehicle_id+stop_idx)%2 ELSE 0 END AS n_dropoffs, CASE WHEN stop_idx<vehicle_id%4 THEN (vehicle_id+stop_idx)%3 ELSE 0 END AS occupancy, wait FROM rs2)"""
LOCATED = f"""st AS (SELECT s.*, x.head, x.tail, count(*) OVER (PARTITION BY vehicle_id) AS n, lead(location) OVER w AS nl, lead(arr) OVER w AS narr, lead(max_arr) OVER w AS nmax FROM rs s JOIN edge x ON edge_id=location WINDOW w AS (PARTITION BY vehicle_id ORDER BY stop_idx)),
 goals AS (SELECT DISTINCT x.tail AS t FROM st JOIN edge x ON x.edge_id=nl WHERE stop_idx=0),
 nx AS (SELECT a.t, e.tail AS v, min({{'e': e.edge_id, 'h': e.head, 'tt': e.travel_time}}) AS m FROM goals JOIN rt a USING (t) JOIN edge e ON e.tail=a.v JOIN rt b ON b.t=a.t AND b.v=e.head WHERE a.v<>a.t AND b.d+e.travel_time=a.d GROUP BY a.t, e.tail),
 pth AS (SELECT vehicle_id, x.tail AS goal, st.head AS v, dep AS tm, CAST(-1 AS BIGINT) AS e FROM st JOIN edge x ON x.edge_id=nl WHERE stop_idx=0 UNION ALL SELECT vehicle_id, goal, m.h, tm+m.tt, m.e FROM pth JOIN nx ON nx.t=goal AND nx.v=pth.v),
 passed AS (SELECT vehicle_id, tm, e FROM pth WHERE e>=0 UNION ALL SELECT vehicle_id, narr, nl FROM st WHERE stop_idx=0 AND nl IS NOT NULL),
 here AS (SELECT request_id, vehicle_id, coalesce(min({{'tm': tm, 'e': e}}) FILTER (WHERE tm>=request_time), max({{'tm': tm, 'e': e}})) AS m FROM request CROSS JOIN passed GROUP BY 1, 2)"""
FOUND = f"""pe AS (SELECT pk.request_id, pk.location, pk.walk, pk.id, head, tail, travel_time AS tt FROM pk JOIN edge ON edge_id=location),
 de AS (SELECT dp.request_id, dp.location, dp.walk, dp.id, head, tail, travel_time AS tt FROM dp JOIN edge ON edge_id=location),
 at_p AS (SELECT p.request_id, p.location AS p_loc, p.walk AS p_walk, p.id AS p_id, p.head AS p_head, s.vehicle_id, s.stop_idx AS i, s.n, s.nl, s.narr, s.nmax, s.dep AS dep_i, s.location AS l_i, s.n>1 AND s.stop_idx=0 AND s.dep<request_time AS moving, s.occupancy AS occ_i,
  CASE WHEN s.n>1 AND s.stop_idx=0 AND s.dep<request_time THEN h.m.tm-s.dep+CASE WHEN h.m.e=p.location THEN 0 ELSE hr.d+p.tt END ELSE CASE WHEN s.location=p.location THEN 0 ELSE a.d+p.tt END END AS to_p,
  CASE WHEN s.nl IS NULL THEN 0 WHEN s.nl=p.location THEN 0 ELSE b.d+y.travel_time END AS from_p, r.request_time AS t0, r.num_riders AS riders
  FROM pe p JOIN request r USING (request_id) CROSS JOIN st s JOIN rt a ON a.t=p.tail AND a.v=s.head LEFT JOIN edge y ON y.edge_id=s.nl LEFT JOIN rt b ON b.t=y.tail AND b.v=p.head
  LEFT JOIN here h ON h.request_id=p.request_id AND h.vehicle_id=s.vehicle_id LEFT JOIN edge he ON he.edge_id=h.m.e LEFT JOIN rt hr ON hr.t=p.tail AND hr.v=he.head WHERE s.nl IS DISTINCT FROM p.location),
 at_d AS (SELECT q.request_id, q.location AS d_loc, q.walk AS d_walk, q.id AS d_id, q.tail AS d_tail, q.tt AS d_tt, s.vehicle_id, s.stop_idx AS j, s.narr AS narr_j, s.nmax AS nmax_j, s.arr AS arr_j, s.dep AS dep_j, s.occupancy AS occ_j, s.location=q.location AS here_d,
  CASE WHEN s.location=q.location THEN 0 ELSE a.d+q.tt END AS stop_d, CASE WHEN s.nl IS NULL THEN 0 ELSE b.d+y.travel_time END AS next_d
  FROM de q CROSS JOIN st s JOIN rt a ON a.t=q.tail AND a.v=s.head LEFT JOIN edge y ON y.edge_id=s.nl LEFT JOIN rt b ON b.t=y.tail AND b.v=q.head WHERE s.nl IS DISTINCT FROM q.location),
 lists AS (SELECT vehicle_id, list(w ORDER BY stop_idx) AS w, list(n_dropoffs ORDER BY stop_idx) AS nd, list(occupancy ORDER BY stop_idx) AS oc, max(dep) AS last_dep FROM (SELECT *, CAST(sum(wait) OVER (PARTITION BY vehicle_id ORDER BY stop_idx) AS BIGINT) AS w FROM rs) GROUP BY 1),
 k0 AS (SELECT p.*, q.* EXCLUDE (request_id, vehicle_id), l.w, l.nd, l.oc, l.last_dep, 2+vehicle_id%4 AS capacity, i<>j AND here_d AS d_at, (i>0 OR dep_i>t0) AND p_loc=l_i AS p_at, (n=1 OR dep_i<t0) AS may_be_late,
  CASE WHEN i<>j THEN stop_d WHEN p_loc=d_loc THEN 0 ELSE x.d+d_tt END AS to_d, dr.direct FROM at_p p JOIN at_d q USING (request_id, vehicle_id) JOIN lists l USING (vehicle_id) JOIN rt x ON x.t=d_tail AND x.v=p_head
  JOIN (SELECT request_id, CASE WHEN origin=destination THEN 0 ELSE rt.d+y.travel_time END AS direct FROM request JOIN edge x ON x.edge_id=origin JOIN edge y ON y.edge_id=destination JOIN rt ON rt.t=y.tail AND rt.v=x.head) dr USING (request_id)
  WHERE i<=j AND (i=j OR p_loc<>d_loc) AND (i=n-1 OR occ_i+riders<=capacity) AND (here_d OR j=n-1 OR occ_j+riders<=capacity)),
 k1 AS (SELECT *, CASE WHEN n=1 THEN greatest(dep_i,t0) ELSE dep_i END AS leave, CASE WHEN d_at THEN 0 ELSE next_d END AS from_d, CASE WHEN i=j THEN 0 ELSE from_p END AS on_p FROM k0),
 k2 AS (SELECT *, greatest(leave+CASE WHEN p_at THEN 0 ELSE to_p+{T} END, t0+p_walk) AS dep_p FROM k1),
 k3 AS (SELECT *, dep_p-leave+CASE WHEN i<>j THEN on_p-(narr-dep_i) ELSE 0 END AS det FROM k2),
 k4 AS (SELECT *, CASE WHEN i=j THEN det ELSE greatest(det-(w[j+1]-w[i+1]),0) END AS rest, CASE WHEN i=j THEN dep_p+to_d ELSE CASE WHEN d_at THEN arr_j+greatest(det-(w[j]-w[i+1]),0) ELSE greatest(dep_j, arr_j+greatest(det-(w[j]-w[i+1]),0)+{T})+to_d END END AS arr_d FROM k3),
 k5 AS (SELECT *, greatest(rest+CASE WHEN d_at THEN 0 ELSE to_d+{T}+from_d-CASE WHEN j=n-1 THEN 0 ELSE narr_j-dep_j END END,0) AS det_d FROM k4),
 k6 AS (SELECT *, CASE WHEN n-2>j THEN greatest(det_d-(w[n-1]-w[j+1]),0) ELSE det_d END AS det_end, CAST(floor(1.7::DOUBLE*direct) AS BIGINT)+1200 AS most, arr_d-t0+d_walk AS trip,
  CASE WHEN i<j THEN coalesce(list_sum(list_transform(range(i+1,j+1), lambda x: nd[x+1]*greatest(det-(w[x]-w[i+1]),0))),0) ELSE 0 END + coalesce(list_sum(list_transform(range(j+1,n), lambda x: nd[x+1]*greatest(det_d-(w[x]-w[j+1]),0))),0) AS others FROM k5),
 found AS (SELECT *, CASE WHEN i=n-1 THEN 'after_last' WHEN j=n-1 AND NOT here_d THEN 'dropoff_after_last' WHEN i=0 THEN 'before_next' WHEN i=j THEN 'paired' ELSE 'ordinary' END AS kind,
  det_end AS cost_vehicle, trip+10*greatest(trip-most,0) AS cost_trip, greatest(dep_p-(t0+3000),0) AS cost_wait, CAST(others AS BIGINT) AS cost_others, det_end+trip+10*greatest(trip-most,0)+greatest(dep_p-(t0+3000),0)+CAST(others AS BIGINT) AS cost FROM k6
  WHERE greatest(last_dep,t0)+det_end<=1080000 AND NOT (i<>j AND det<>0 AND narr+det>nmax) AND NOT (j<n-1 AND det_d<>0 AND narr_j+det_d>nmax_j)
  AND (i=n-1 OR coalesce(list_max(oc[i+1:CASE WHEN d_at THEN j ELSE j+1 END]),0)+riders<=capacity))"""
ALL = X.ctes("edge", recursive=True, more=f"{REQUEST}, {PLACES}, {ROUTES}, {LOCATED}, {FOUND}")
SCHEDULES = X.ctes("edge", recursive=True, more=f"{REQUEST}, {PLACES}, {ROUTES}")
BEST = """SELECT request_id, m.cost, m.vehicle_id, m.i, m.j, m.p_walk, m.d_walk, m.p_id, m.d_id, m.to_p, m.to_d FROM (SELECT request_id, min({'cost': cost, 'vehicle_id': vehicle_id, 'i': i, 'j': j, 'p_walk': p_walk, 'd_walk': d_walk, 'p_id': p_id, 'd_id': d_id, 'to_p': to_p, 'to_d': to_d, 'from_p': on_p, 'from_d': from_d}) AS m FROM found """


def best_of(spark, d, kind: str | None = None) -> DataFrame:
    return C.best(candidates(spark, d, kind is None, True, kind)).select("request_id", "cost", "vehicle_id", "i", "j", "p_walk", "d_walk", "p_id", "d_id", "to_p", "to_d")


def best_query(name: str, kind: str | None) -> None:
    condition = "" if kind is None else f"WHERE kind='{kind}' "
    query(name, f"{ALL}{BEST}{condition}GROUP BY request_id)")(lambda spark, d: best_of(spark, d, kind))


best_query("j11_best_ordinary", D.ORDINARY)
best_query("j12_best_paired", D.PAIRED)
best_query("j13_best_before_next_stop", D.BEFORE_NEXT)
best_query("j16_best_after_last_stop", D.AFTER_LAST)
best_query("j19_best_dropoff_after_last_stop", D.DROPOFF_AFTER_LAST)
best_query("j24_best_insertion", None)


@query("u01_routes_on_network", SCHEDULES + "SELECT vehicle_id, stop_idx, location, arr, dep, max_arr, n_dropoffs, occupancy FROM rs")
def u02(spark, d) -> DataFrame:
    return stops(spark, d)


@query("a23_cost_parts", ALL + "SELECT kind, count(*) AS n, CAST(sum(cost_vehicle) AS BIGINT) AS vehicle, CAST(sum(cost_trip) AS BIGINT) AS trip, CAST(sum(cost_wait) AS BIGINT) AS wait, CAST(sum(cost_others) AS BIGINT) AS others FROM found GROUP BY kind")
def a23(spark, d) -> DataFrame:
    total = lambda x: F.sum(f"cost_{x}").alias(x)
    return candidates(spark, d).where("cost IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), *[total(x) for x in ("vehicle", "trip", "wait", "others")])


@query(
    "g28_current_location",
    ALL + """SELECT request_id, vehicle_id, m.tm AS at_head, m.e AS location FROM here JOIN request USING (request_id) JOIN (SELECT vehicle_id, dep, narr FROM st WHERE stop_idx=0 AND nl IS NOT NULL) USING (vehicle_id) WHERE dep<=request_time AND request_time<=narr""",
)
def g28(spark, d) -> DataFrame:
    """Where every vehicle that is on its way to the next stop is, as of every request's time."""
    s = stops(spark, d)
    legs = s.withColumn("arr_next", F.lead("arr").over(S.by())).where("stop_idx = 0 and arr_next is not null").select("vehicle_id", "dep", "arr_next")
    found = D.located(D.first_legs(X.edges(spark, d), s), legs, requests(spark, d).select("request_id", "request_time"))
    return found.select("request_id", "vehicle_id", "at_head", "location")


@query("j06_direct_distances", ALL + "SELECT request_id, p.id AS p_id, q.id AS d_id, CASE WHEN p.location=q.location THEN 0 ELSE rt.d+q.tt END AS dist, min(CASE WHEN p.location=q.location THEN 0 ELSE rt.d+q.tt END) OVER (PARTITION BY request_id, p.id) AS least FROM pe p JOIN de q USING (request_id) JOIN rt ON rt.t=q.tail AND rt.v=p.head")
def j06(spark, d) -> DataFrame:
    """Distances of every pickup to every dropoff of its request, and each pickup's least one."""
    from pyspark.sql import Window

    e, r = X.edges(spark, d), requests(spark, d)
    foot = e.where("psg_edge_id IS NOT NULL")
    p = P.with_centre(P.pickups(r, e, foot, RADIUS), r.select("request_id", c("origin").alias("centre"))).select("request_id", c("location").alias("p"), c("pd_id").alias("p_id"))
    q = P.with_centre(P.dropoffs(r, e, foot, RADIUS), r.select("request_id", c("destination").alias("centre"))).select("request_id", c("location").alias("q"), c("pd_id").alias("d_id"))
    rows = p.join(q, "request_id")
    rows = rows.join(D.pd_distances(e, p, q.withColumnRenamed("q", "d")).withColumnRenamed("d", "q"), ["request_id", "p", "q"])
    return rows.select("request_id", "p_id", "d_id", "dist", F.min("dist").over(Window.partitionBy("request_id", "p_id")).alias("least"))


FOOT_WAYS = """ft(t, v, d) USING KEY (t, v) AS (SELECT tail, tail, CAST(0 AS BIGINT) FROM request JOIN edge ON edge_id=destination GROUP BY tail UNION SELECT q.t, q.tail, min(q.d) FROM (SELECT ft.t, tail, ft.d+travel_time AS d FROM ft JOIN foot ON head=ft.v) q LEFT JOIN recurring.ft o ON o.t=q.t AND o.v=q.tail WHERE o.d IS NULL OR q.d<o.d GROUP BY q.t, q.tail),
 walks AS (SELECT request_id, request_time, ft.d+y.travel_time AS walk, CAST(floor(1.7::DOUBLE*CASE WHEN origin=destination THEN 0 ELSE rt.d+y.travel_time END) AS BIGINT)+1200 AS most FROM request JOIN edge x ON x.edge_id=origin JOIN edge y ON y.edge_id=destination JOIN ft ON ft.t=y.tail AND ft.v=x.head JOIN rt ON rt.t=y.tail AND rt.v=x.head)"""


@query("j25_walk_only", X.ctes("edge", recursive=True, more=f"{REQUEST}, {PLACES}, {ROUTES}, {FOOT_WAYS}") + "SELECT request_id, walk, walk+10*greatest(walk-most,0) AS cost FROM walks")
def j25(spark, d) -> DataFrame:
    return on_foot(spark, d).where("walk is not null").select("request_id", "walk", "cost")


def on_foot(spark, d) -> DataFrame:
    e = X.edges(spark, d)
    return D.walks(e, e.where("psg_edge_id IS NOT NULL"), requests(spark, d), K)


#: Columns of the log of best assignments, and what the SQL calls them.
LOGGED = {"to_p": "to_p", "from_p": "from_p", "to_d": "to_d", "from_d": "from_d", "p_id": "p_id", "p_walk": "p_walk", "d_id": "d_id", "d_walk": "d_walk", "n_stops": "n", "dep_before_pickup": "leave", "dep_before_dropoff": "leave_d"}


@query(
    "u18_best_assignments",
    X.ctes("edge", recursive=True, more=f"{REQUEST}, {PLACES}, {ROUTES}, {LOCATED}, {FOUND}, {FOOT_WAYS}")
    + "SELECT request_id, request_time, direct, CASE WHEN f OR m IS NULL THEN -1 ELSE m.vehicle_id END AS vehicle_id, CASE WHEN f OR m IS NULL THEN -1 ELSE m.i END AS i, CASE WHEN f OR m IS NULL THEN -1 ELSE m.j END AS j, "
    + ", ".join(f"CASE WHEN f OR m IS NULL THEN -1 ELSE m.{v} END AS {k}" for k, v in LOGGED.items())
    + """, f AS not_using_vehicle, CASE WHEN NOT f AND m IS NULL THEN -1 ELSE 1 END AS accepted, CASE WHEN f THEN foot ELSE m.cost END AS cost
 FROM (SELECT *, foot IS NOT NULL AND (m IS NULL OR foot<m.cost) AS f FROM (SELECT request_id, request_time, CASE WHEN origin=destination THEN 0 ELSE rt.d+y.travel_time END AS direct FROM request JOIN edge x ON x.edge_id=origin JOIN edge y ON y.edge_id=destination JOIN rt ON rt.t=y.tail AND rt.v=x.head)
  LEFT JOIN (SELECT request_id, walk+10*greatest(walk-most,0) AS foot FROM walks) USING (request_id)
  LEFT JOIN (SELECT request_id, min({'cost': cost, 'vehicle_id': vehicle_id, 'i': i, 'j': j, 'p_walk': p_walk, 'd_walk': d_walk, 'p_id': p_id, 'd_id': d_id, 'to_p': to_p, 'to_d': to_d, 'from_p': on_p, 'from_d': from_d, 'n': n, 'leave': leave, 'leave_d': CASE WHEN n=1 THEN greatest(dep_j,t0) ELSE dep_j END}) AS m FROM found GROUP BY request_id) USING (request_id))""",
)
def u18(spark, d) -> DataFrame:
    return D.assignments(requests(spark, d), candidates(spark, d, True), on_foot(spark, d), K)
