"""Queries over distances of fleets and requests, lower bounds, acceptance, schedule maxima and counters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network as N
from ..operators import buckets as B
from ..operators import cost as C
from ..operators import dispatch as D
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import locations as P
from ..operators import sampling as A
from ..operators import schedule as S
from ..storage import cut
from . import fixtures as X
from . import insertion_queries as I
from .location_queries import RADIUS
from .network_queries import E_SQL

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}
T = X.STOP_TIME


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def places(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges, requests, their pickups and dropoffs."""
    e, r = X.edges(spark, d), I.requests(spark, d)
    foot = e.where("psg_edge_id IS NOT NULL")
    p = P.with_centre(P.pickups(r, e, foot, RADIUS), r.select("request_id", c("origin").alias("centre")))
    return e, r, p, P.with_centre(P.dropoffs(r, e, foot, RADIUS), r.select("request_id", c("destination").alias("centre")))


WAY = "CASE WHEN {a}={b} THEN 0 ELSE {d}+{t} END"


@query(
    "j05_vehicle_distance_to_centre",
    I.ALL.replace("places AS (SELECT location FROM rs0", "places AS (SELECT origin AS location FROM request UNION SELECT location FROM rs0", 1)
    + """SELECT p.request_id, p.id AS pd_id, CASE WHEN p.location=r.origin THEN 0 ELSE a.d+y.travel_time END AS to_centre, CASE WHEN p.location=r.origin THEN 0 ELSE b.d+p.tt END AS from_centre
 FROM pe p JOIN request r USING (request_id) JOIN edge y ON y.edge_id=r.origin JOIN rt a ON a.t=y.tail AND a.v=p.head JOIN rt b ON b.t=p.tail AND b.v=y.head""",
)
def j05(spark, d) -> DataFrame:
    """Ways by vehicle between each pickup and its request's origin."""
    e, r, p, _ = places(spark, d)
    return P.centre_distances(e, p, r.select("request_id", c("origin").alias("centre"))).select("request_id", "pd_id", "to_centre", "from_centre")


@query("j07_dropoffs_at_stops", I.ALL + "SELECT q.request_id, q.location, s.vehicle_id, s.stop_idx FROM dp q JOIN st s USING (location) WHERE s.stop_idx<s.n-1 OR s.n>1")
def j07(spark, d) -> DataFrame:
    """Dropoffs where a route stops, its last stop included unless it is the only one."""
    *_, o = places(spark, d)
    return P.dropoffs_at_stops(o, I.stops(spark, d))


ELLIPTIC = (
    I.ALL
    + f"""SELECT DISTINCT vehicle_id, stop_idx AS at, x.edge_id AS x, CASE WHEN st.location=x.edge_id THEN 0 ELSE a.d+x.travel_time END AS to_x, b.d+y.travel_time AS from_x
 FROM st JOIN (SELECT DISTINCT location FROM pk) l ON true JOIN edge x ON x.edge_id=l.location JOIN rt a ON a.t=x.tail AND a.v=st.head JOIN edge y ON y.edge_id=st.nl JOIN rt b ON b.t=y.tail AND b.v=x.head
 JOIN (SELECT vehicle_id, stop_idx, lead(dep) OVER (PARTITION BY vehicle_id ORDER BY stop_idx) AS ndep FROM rs) z USING (vehicle_id, stop_idx)
 WHERE st.nl<>x.edge_id AND CASE WHEN st.location=x.edge_id THEN 0 ELSE a.d+x.travel_time END+b.d+y.travel_time<=greatest(st.nmax, z.ndep)-st.dep-{T}"""
)


@query("j08_elliptic_join", ELLIPTIC)
def j08(spark, d) -> DataFrame:
    """Every pickup location with the legs whose leeway allows the way to it and on, and both ways."""
    e, _, p, _ = places(spark, d)
    legs = D.route_legs(e, I.stops(spark, d), I.fleet(spark, d), I.K).where("next is not null")
    return D.feasible_distances(e, legs, p.select(c("location").alias("x")))


@query("u11_elliptic_by_buckets", ELLIPTIC)
def u11(spark, d) -> DataFrame:
    """The same by buckets that held other legs of two thirds of the fleet, and were changed in two batches."""
    e, _, p, _ = places(spark, d)
    legs = cut(D.route_legs(e, I.stops(spark, d), I.fleet(spark, d), I.K).where("next is not null"))
    third = lambda k: legs.where(c("vehicle_id") % 3 == k)
    old = third(1).withColumn("leeway", F.floor(c("leeway") / 2)).withColumn("stop_head", c("next_tail"))
    table = B.Buckets.of(H.index_of(e), third(2).unionByName(old).unionByName(third(0).withColumn("vehicle_id", -1 - c("vehicle_id"))))
    table.change(old, third(1))
    table.change(third(0).withColumn("vehicle_id", -1 - c("vehicle_id")), third(0))
    return B.feasible_by_buckets(table, e, legs, p.select(c("location").alias("x")))


@query(
    "j09_feasible_distances",
    SQL["j08_elliptic_join"].replace("SELECT DISTINCT vehicle_id, stop_idx AS at, x.edge_id AS x,", "SELECT vehicle_id, \"at\", count(*) AS n, CAST(min(to_x) AS BIGINT) AS least_to, CAST(min(from_x) AS BIGINT) AS least_from FROM (SELECT DISTINCT vehicle_id, stop_idx AS at, x.edge_id AS x,") + ") GROUP BY 1, 2",
)
def j09(spark, d) -> DataFrame:
    """For each leg the number of feasible pickup locations and the least ways to and from one."""
    return j08(spark, d).groupBy("vehicle_id", "at").agg(F.count("*").alias("n"), F.min("to_x").alias("least_to"), F.min("from_x").alias("least_from"))


LEAST_PD = "pd AS (SELECT request_id, min(CASE WHEN p.location=q.location THEN 0 ELSE rt.d+q.tt END) AS least FROM pe p JOIN de q USING (request_id) JOIN rt ON rt.t=q.tail AND rt.v=p.head GROUP BY 1)"
UPPER = "SELECT request_id, min(cost) AS upper FROM found GROUP BY 1"


@query(
    "j10_relevant_pickups",
    I.ALL[:-1]
    + f""", {LEAST_PD}, ub AS ({UPPER}),
 direct AS (SELECT request_id, CASE WHEN origin=destination THEN 0 ELSE rt.d+y.travel_time END AS direct FROM request JOIN edge x ON x.edge_id=origin JOIN edge y ON y.edge_id=destination JOIN rt ON rt.t=y.tail AND rt.v=x.head),
 q AS (SELECT p.*, l.w, l.nd, 2+vehicle_id%4 AS capacity, pd.least, direct.direct, ub.upper, z.ndep FROM at_p p JOIN lists l USING (vehicle_id) JOIN pd USING (request_id) JOIN direct USING (request_id) JOIN ub USING (request_id)
   JOIN (SELECT vehicle_id, stop_idx AS i, lead(dep) OVER (PARTITION BY vehicle_id ORDER BY stop_idx) AS ndep FROM rs) z USING (vehicle_id, i)
   WHERE i<n-1 AND NOT moving AND occ_i+riders<=2+vehicle_id%4 AND to_p+from_p<=greatest(nmax, z.ndep)-dep_i-{T}),
 g AS (SELECT *, greatest(dep_i+CASE WHEN (i>0 OR dep_i>t0) AND p_loc=l_i THEN 0 ELSE to_p+{T} END, t0+p_walk) AS dep_p FROM q),
 h AS (SELECT *, greatest(dep_p-dep_i+from_p-(narr-dep_i), 0) AS det FROM g),
 b AS (SELECT *, greatest(det-(w[n-1]-w[i+1]), 0) + dep_p-t0+least + 10*greatest(dep_p-t0+least-(CAST(floor(1.7::DOUBLE*direct) AS BIGINT)+1200), 0) + greatest(dep_p-(t0+3000), 0) + coalesce(list_sum(list_transform(range(i+1, n), lambda x: nd[x+1]*greatest(det-(w[x]-w[i+1]), 0))), 0) AS bound FROM h)
 SELECT request_id, vehicle_id, i, p_id, CAST(bound AS BIGINT) AS bound FROM b WHERE bound<=upper""",
)
def j10(spark, d) -> DataFrame:
    """Pickups on legs that may be part of an assignment as good as the best one, by what a pickup alone costs at least."""
    e, r, p, o = places(spark, d)
    s, v = I.stops(spark, d), I.fleet(spark, d)
    best = C.best(I.candidates(spark, d, True)).select("request_id", c("cost").alias("upper"))
    return D.relevant_pickups(e, s, v, r, p, o, best, I.K).select("request_id", "vehicle_id", "i", "p_id", "bound")


@query(
    "j18_promising_dropoffs",
    I.ALL
    + """SELECT request_id, pd_id FROM (SELECT q.request_id, q.id AS pd_id, q.walk, CASE WHEN q.location=r.destination THEN 0 ELSE a.d+y.travel_time END AS v,
  CAST(floor(1.7::DOUBLE*CASE WHEN r.origin=r.destination THEN 0 ELSE z.d+y.travel_time END) AS BIGINT)+1200 AS most
  FROM de q JOIN request r USING (request_id) JOIN edge y ON y.edge_id=r.destination JOIN edge x ON x.edge_id=r.origin JOIN rt a ON a.t=y.tail AND a.v=q.head JOIN rt z ON z.t=y.tail AND z.v=x.head)
 WHERE walk+10*greatest(walk-most, 0)<=v+v+10*greatest(v-most, 0)""",
)
def j18(spark, d) -> DataFrame:
    """Dropoffs from which walking on isn't dearer than a vehicle's way to the destination."""
    e, r, _, o = places(spark, d)
    return D.promising_dropoffs(e, r, o, I.K).select("request_id", "pd_id")


@query(
    "j22_closest_pickup_to_last_stop",
    I.ALL + """SELECT request_id, vehicle_id, m.w AS dist, m.id AS p_id FROM (SELECT p.request_id, s.vehicle_id, min({'w': CASE WHEN s.location=p.location THEN 0 ELSE rt.d+p.tt END, 'id': p.id}) AS m FROM pe p JOIN st s ON s.nl IS NULL JOIN rt ON rt.t=p.tail AND rt.v=s.head GROUP BY 1, 2)""",
)
def j22(spark, d) -> DataFrame:
    """The pickup of each request that is nearest to each vehicle's last stop."""
    e, _, p, _ = places(spark, d)
    return D.closest_to_last_stop(e, I.stops(spark, d), p).select("request_id", "vehicle_id", "dist", c("pd_id").alias("p_id"))


@query(
    "j23_last_stop_distances",
    I.ALL + "SELECT DISTINCT s.vehicle_id, p.location AS x, CASE WHEN s.location=p.location THEN 0 ELSE rt.d+p.tt END AS to_x FROM pe p JOIN st s ON s.nl IS NULL JOIN rt ON rt.t=p.tail AND rt.v=s.head WHERE CASE WHEN s.location=p.location THEN 0 ELSE rt.d+p.tt END<=4000",
)
def j23(spark, d) -> DataFrame:
    """Ways of at most 4,000 from last stops to pickups; searches end there."""
    e, _, p, _ = places(spark, d)
    legs = D.route_legs(e, I.stops(spark, d), I.fleet(spark, d), I.K).where(c("at") == c("n") - 1)
    bounded = p.select(c("location").alias("x"), F.lit(4000).cast("long").alias("most"))
    return D.last_stop_distances(e, legs, bounded).where("to_x <= 4000")


#: Walking costs something, and a ride must not take too long.
DEAR = C.Config(walk=2, epsilon=1.5, phi=300, pickup_radius=300, dropoff_radius=300)
WALKED = """origin_side+dest_side AS w, 2*origin_side+2*dest_side AS walking FROM (SELECT *, walk-dest_side AS origin_side FROM (SELECT *, greatest(300+CASE WHEN walk<=600 THEN 0 ELSE (walk-600)//2 END, last) AS dest_side FROM"""


@query(
    "c23_walk_cost",
    X.ctes("n", "request", more="q AS (SELECT request_id, (request_id*91)%9000+40 AS walk, (request_id*13)%2000 AS direct, CAST(40 AS BIGINT) AS last FROM request)")
    + "SELECT request_id, dest_side, walk-dest_side AS origin_side, 2*walk+walk+10*greatest(walk-(CAST(floor(1.7::DOUBLE*direct) AS BIGINT)+1200), 0) AS cost FROM (SELECT *, greatest(300+CASE WHEN walk<=600 THEN 0 ELSE (walk-600)//2 END, last) AS dest_side FROM q)",
)
def c23(spark, d) -> DataFrame:
    """Cost of walking all the way, where walking costs, and its split into the two sides."""
    k = c("request_id")
    rows = X.requests(spark, d).select("request_id", (k * 91 % 9000 + 40).alias("walk"), (k * 13 % 2000).alias("direct"), F.lit(40).cast("long").alias("last"))
    origin, dest = C.walk_sides(c("walk"), c("last"), DEAR)
    return rows.select("request_id", dest.alias("dest_side"), origin.alias("origin_side"), C.walk_cost(c("walk"), c("last"), c("direct"), DEAR).alias("cost"))


@query("c25_acceptance", X.ctes("n", "request") + "SELECT request_id, (request_id*91)%9000<=1.5::DOUBLE*((request_id*13)%2000)+300 AS accepted, true AS always FROM request")
def c25(spark, d) -> DataFrame:
    k = c("request_id")
    trip, direct = k * 91 % 9000, k * 13 % 2000
    return X.requests(spark, d).select("request_id", C.accepted(trip, direct, DEAR).alias("accepted"), C.accepted(trip, direct, C.Config()).alias("always"))


@query(
    "c27_distance_cutoffs",
    X.ctes("n", "request") + "SELECT request_id, cost//3+CASE WHEN cost%3<>0 THEN 1 ELSE 0 END+leg AS by_vehicle, (cost+3*leg)//4+CASE WHEN (cost+3*leg)%4<>0 THEN 1 ELSE 0 END AS by_both FROM (SELECT request_id, (request_id*91)%9000 AS cost, (request_id*7)%500 AS leg FROM request)",
)
def c27(spark, d) -> DataFrame:
    """The least ways that alone cost as much as a bound: for the vehicle, and for vehicle and passenger."""
    k, dear = c("request_id"), C.Config(veh=3)
    cost, leg = k * 91 % 9000, k * 7 % 500
    return X.requests(spark, d).select("request_id", C.cutoff_by_vehicle(cost, leg, dear).alias("by_vehicle"), C.cutoff_by_vehicle_and_trip(cost, leg, dear).alias("by_both"))


@query(
    "c26_lower_bounds",
    I.ALL[:-1]
    + f""", {LEAST_PD}, lb AS (SELECT f.request_id, f.vehicle_id, f.i, f.j, f.p_id, f.d_id, f.cost, greatest(leave, t0)+CASE WHEN l_i=p_loc AND (i>0 OR dep_i>t0) THEN 0 ELSE to_p+{T} END AS early, least, t0, to_p, p_walk, most FROM found f JOIN pd USING (request_id) WHERE kind='after_last')
 SELECT request_id, vehicle_id, p_id, d_id, CAST(greatest(early, t0+p_walk)-t0+least+10*greatest(greatest(early, t0+p_walk)-t0+least-most, 0)+greatest(greatest(early, t0+p_walk)-(t0+3000), 0)+least+to_p AS BIGINT) AS bound, greatest(early, t0+p_walk)-t0+least+10*greatest(greatest(early, t0+p_walk)-t0+least-most, 0)+greatest(greatest(early, t0+p_walk)-(t0+3000), 0)+least+to_p<=cost AS holds FROM lb""",
)
def c26(spark, d) -> DataFrame:
    """Lower bounds of pickups after the last stop beside their costs: a bound never exceeds the cost."""
    e, r, p, o = places(spark, d)
    least = D.pd_distances(e, p.select("request_id", c("location").alias("p")), o.select("request_id", c("location").alias("d"))).groupBy("request_id").agg(F.min("dist").alias("least"))
    rows = I.candidates(spark, d).where(f"kind = '{D.AFTER_LAST}' and cost is not null").join(least, "request_id")
    bound = C.bound_after_last_stop(I.K)
    return rows.select("request_id", "vehicle_id", "p_id", "d_id", bound.alias("bound"), (bound <= c("cost")).alias("holds"))


@query(
    "u05_prefix_sums_in_full",
    X.ctes("route_stop") + f"""SELECT vehicle_id, stop_idx, CAST(sum(wait) OVER w AS BIGINT) AS wait_upto, CAST(sum(n_dropoffs) OVER w AS BIGINT) AS dropoffs_upto, CAST(sum(n_dropoffs*before) OVER w AS BIGINT) AS wait_dropoffs
 FROM (SELECT *, coalesce(sum(wait) OVER (PARTITION BY vehicle_id ORDER BY stop_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM route_stop) WINDOW w AS (PARTITION BY vehicle_id ORDER BY stop_idx)""",
)
def u05(spark, d) -> DataFrame:
    return S.prefix_sums(X.route_stops(spark, d), T).select("vehicle_id", "stop_idx", "wait_upto", "dropoffs_upto", "wait_dropoffs")


@query(
    "u06_largest_leeway_and_leg",
    X.ctes("route_stop") + f"SELECT max(greatest(nm, nd)-dep-{T}) AS leeway, max(na-dep) AS leg FROM (SELECT dep, lead(max_arr) OVER w AS nm, lead(dep) OVER w AS nd, lead(arr) OVER w AS na FROM route_stop WINDOW w AS (PARTITION BY vehicle_id ORDER BY stop_idx))",
)
def u06(spark, d) -> DataFrame:
    """The greatest leeway and the longest leg of the whole fleet, which bound searches."""
    rows = S.legs(S.leeways(X.route_stops(spark, d), T))
    return rows.agg(F.max("leeway").alias("leeway"), F.max(F.when(c("leeway").isNotNull(), c("leg"))).alias("leg"))


NAMES = ", ".join(f"count(*) FILTER (category={i}) AS {n}" for i, n in enumerate(N.CATEGORIES))


@query("u20_road_categories_of_places", I.ALL + f"SELECT kind, {NAMES}, count(*) AS total FROM (SELECT 'pickup' AS kind, location FROM pk UNION ALL SELECT 'dropoff', location FROM dp) JOIN edge ON edge_id=location GROUP BY kind")
def u20(spark, d) -> DataFrame:
    """Pickups and dropoffs by the category of their road, a column for each category, and in total."""
    e, _, p, o = places(spark, d)
    rows = p.select(F.lit("pickup").alias("kind"), "location").unionByName(o.select(F.lit("dropoff").alias("kind"), "location"))
    return P.road_categories(rows, e)


GEOM = X.ctes("edge", "vertex", recursive=True, more="""src AS (SELECT s_suppkey AS id, s_suppkey%n AS s, CAST(floor(ln(1-((s_suppkey*7919)%10007+0.5)/10007.0::DOUBLE)/ln(1-1/(40.0::DOUBLE+1))) AS BIGINT) AS want FROM supplier CROSS JOIN n),
 r(s, v, d) USING KEY (s, v) AS (SELECT DISTINCT s, s, CAST(0 AS BIGINT) FROM src UNION SELECT q.s, q.head, min(q.d) FROM (SELECT r.s, head, r.d+travel_time AS d FROM r JOIN edge ON tail=r.v) q LEFT JOIN recurring.r o ON o.s=q.s AND o.v=q.head WHERE o.d IS NULL OR q.d<o.d GROUP BY q.s, q.head)""")


@query("a16_pairs_by_geometric_rank", GEOM + "SELECT id, src.s AS source, v AS vertex_id, want FROM src JOIN (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, v)-1 AS k FROM r WHERE v%3<>0 OR v=s) x ON x.s=src.s AND k=want WHERE want>0")
def a16(spark, d) -> DataFrame:
    """Pairs whose destination has a rank that is drawn from a geometric distribution with mean 40, among the vertices of an area."""
    n, k = X.vertices(spark, d).count(), X.L("s_suppkey")
    u = (k * 7919 % 10007 + 0.5) / 10007.0
    src = X.table(spark, d, "supplier").select(k.alias("id"), (k % n).alias("source"), A.geometric(u, 40).alias("want"))
    # The area: two thirds of the vertices, and the source itself.
    inside = lambda found: found.where((c("vertex_id") % 3 != 0) | (c("vertex_id") == c("source")))
    most = src.groupBy("source").agg(F.max("want").alias("most"))
    far = lambda found: A.more_than(c("most"))(inside(found).join(most, "source"))
    found = A.until(X.edges(spark, d), src, far, 5)
    return A.at_wanted_rank(inside(found), src).where("want > 0").select("id", "source", "vertex_id", "want")


@query(
    "g27_random_incident_edge",
    E_SQL + "SELECT id, head AS vertex_id, edge_id FROM (SELECT head, edge_id, row_number() OVER (PARTITION BY head ORDER BY edge_id)-1 AS k, count(*) OVER (PARTITION BY head) AS m FROM edge WHERE category<=13) JOIN (SELECT c_custkey AS id, c_custkey%n AS v, c_custkey*7919 AS u FROM customer CROSS JOIN n) ON v=head AND k=u%m",
)
def g27(spark, d) -> DataFrame:
    """One of the edges into a vertex that are open to cars, drawn by a number."""
    n, k = X.vertices(spark, d).count(), X.L("c_custkey")
    asked = X.table(spark, d, "customer").select(k.alias("id"), (k % n).alias("vertex_id"), (k * 7919).alias("u"))
    return A.random_incident(X.edges(spark, d).where(N.open_to_cars(c("category"))), asked)


@query(
    "g04_stop_criteria",
    X.ctes("edge", recursive=True, more="""r(s, v, d) USING KEY (s, v) AS (SELECT h, h, CAST(0 AS BIGINT) FROM (SELECT DISTINCT head AS h FROM vehicle JOIN edge ON edge_id=initial_location) UNION SELECT q.s, q.head, min(q.d) FROM (SELECT r.s, head, r.d+travel_time AS d FROM r JOIN edge ON tail=r.v) q LEFT JOIN recurring.r o ON o.s=q.s AND o.v=q.head WHERE (o.d IS NULL OR q.d<o.d) AND q.d<=300+(q.s%5)*200 GROUP BY q.s, q.head)""").replace("WITH RECURSIVE ", "WITH RECURSIVE " + X.SQL["n"] + ",\n" + X.SQL["vehicle"] + ",\n").replace(",\nn AS (SELECT count(*) AS n FROM part)", "", 1)
    + "SELECT s AS source, v AS vertex_id, d AS dist FROM r",
)
def g04(spark, d) -> DataFrame:
    """Searches that stop at a bound of their own."""
    e = X.edges(spark, d)
    s = X.vehicles(spark, d).select(c("initial_location").alias("edge_id")).join(e, "edge_id").select(c("head").alias("source")).distinct()
    return G.distances(e, s.select("source", c("source").alias("vertex_id"), F.lit(0).cast("long").alias("dist"), (300 + c("source") % 5 * 200).alias("radius")))


@query(
    "g07_dag_shortest_paths",
    X.ctes("edge", recursive=True, more="r(v, d) USING KEY (v) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT q.head, min(q.d) FROM (SELECT head, r.d+travel_time AS d FROM r JOIN edge ON tail=r.v WHERE tail<head) q LEFT JOIN recurring.r o ON o.v=q.head WHERE o.d IS NULL OR q.d<o.d GROUP BY q.head)")
    + "SELECT v AS vertex_id, d AS dist FROM r",
)
def g07(spark, d) -> DataFrame:
    """Distances from vertex 0 along edges to larger ids alone, which have no cycle."""
    zero = spark.createDataFrame([(0, 0, 0)], "source long, vertex_id long, dist long")
    return G.distances(X.edges(spark, d).where("tail < head"), zero).select("vertex_id", "dist")


AVOID = X.ctes("edge", recursive=True, more="""p AS (SELECT c_custkey AS id, c_custkey%n AS o, (c_custkey*3)%n AS d FROM customer CROSS JOIN n),
 r(s, v, d) USING KEY (s, v) AS (SELECT DISTINCT d, d, CAST(0 AS BIGINT) FROM p WHERE o=d UNION SELECT q.s, q.head, min(q.d) FROM (SELECT r.s, head, r.d+travel_time AS d FROM r JOIN edge ON tail=r.v) q LEFT JOIN recurring.r o ON o.s=q.s AND o.v=q.head WHERE o.d IS NULL OR q.d<o.d GROUP BY q.s, q.head)""")


@query("a18_destinations_avoid_origins", AVOID + "SELECT id, o AS origin, CASE WHEN o=d THEN m.v ELSE d END AS destination FROM p LEFT JOIN (SELECT s, min({'d': d, 'v': v}) AS m FROM r WHERE v<>s AND v%4<>1 GROUP BY s) ON s=d AND o=d")
def a18(spark, d) -> DataFrame:
    """Pairs whose destination is their origin get the nearest other eligible vertex instead."""
    n, k = X.vertices(spark, d).count(), X.L("c_custkey")
    pairs = X.table(spark, d, "customer").select(k.alias("id"), (k % n).alias("origin"), (k * 3 % n).alias("destination"))
    return A.avoiding(X.edges(spark, d), pairs, c("vertex_id") % 4 != 1)
