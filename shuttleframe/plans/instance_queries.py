"""Queries that build instances: file formats, draws, pairs by rank or distance, location mapping, paths, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network as N
from ..operators import dispatch as D
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import sampling as A
from ..operators import schedule as S
from ..sources import formats as IO
from ..storage import new_path
from . import fixtures as X
from .insertion_queries import PLACES, REQUEST, ROUTES, stops
from .network_queries import E_SQL, FACE_SQL, POINTS, faces

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


def ways(spark, d) -> DataFrame:
    return X.edges(spark, d).select(c("edge_id").alias("way_id"), c("tail").alias("from_node"), c("head").alias("to_node"), "length", "category")


BOTH = "(SELECT edge_id, tail, head, length, category FROM edge UNION ALL SELECT edge_id, head, tail, length, category FROM edge)"


@query("s05_osm_foot_edges", E_SQL + f"SELECT edge_id AS way_id, tail, head, (72*length+5)//10 AS travel_time FROM {BOTH} WHERE category BETWEEN 8 AND 20")
def s05(spark, d) -> DataFrame:
    return IO.osm_foot_edges(ways(spark, d)).select("way_id", "tail", "head", "travel_time")


@query("s06_osm_cycle_edges", E_SQL + f"SELECT edge_id AS way_id, tail, head, (72*length+v)//(2*v) AS travel_time FROM (SELECT *, CASE WHEN category BETWEEN 14 AND 19 THEN 5 ELSE 18 END AS v FROM {BOTH}) WHERE category BETWEEN 6 AND 20 AND category<>18")
def s06(spark, d) -> DataFrame:
    return IO.osm_cycle_edges(ways(spark, d)).select("way_id", "tail", "head", "travel_time")


XATF_SQL = """xv AS (SELECT edge_id, tail, head, length, edge_id%13+1 AS cat FROM edge WHERE edge_id%4<>2 UNION ALL SELECT edge_id, head, tail, length, edge_id%13+1 FROM edge WHERE edge_id%4<>1),
 xs AS (SELECT xv.*, CASE WHEN cat<=12 THEN 140-10*cat END AS v, CASE WHEN cat<=4 THEN 2 WHEN cat<=12 THEN 1 END AS lanes, radians(a.lat/1e6) AS p, radians(b.lat/1e6) AS q, radians(b.lng/1e6)-radians(a.lng/1e6) AS w FROM xv JOIN vertex a ON a.vertex_id=tail JOIN vertex b ON b.vertex_id=head),
 xh AS (SELECT *, pow(sin((q-p)/2),2)+cos(p)*cos(q)*pow(sin(w/2),2) AS h FROM xs)"""


@query(
    "s10_xatf",
    X.ctes("vertex", "edge", more=XATF_SQL)
    + "SELECT tail, head, cat AS category, CASE WHEN cat=13 THEN CAST(floor(2*6371000*atan2(sqrt(h), sqrt(1-h))+0.5) AS BIGINT) ELSE length END AS length, CASE WHEN cat=13 THEN 600*length ELSE (72*length+v)//(2*v) END AS travel_time, lanes, CASE WHEN cat=13 THEN 0 ELSE CAST(floor(9000*lanes*v/(5*v+45)+0.5) AS BIGINT) END AS capacity FROM xh",
)
def s10(spark, d) -> DataFrame:
    k = c("edge_id")
    lines = X.edges(spark, d).select(F.concat_ws(",", k, "tail", "head", F.lit(0), "length", F.lit(0), k % 4, F.lit(0), F.lit(0), k % 13 + 1).alias("value"))
    return IO.parse_xatf(lines, X.vertices(spark, d))


@query("s13_vehicles_csv", X.ctes("vehicle") + "SELECT initial_location, start_of_service_time, end_of_service_time, capacity FROM vehicle")
def s13(spark, d) -> DataFrame:
    """The fleet written in the other dialect, in seconds, and read again."""
    path, second = new_path(spark, "vehicles"), lambda x: (c(x) / 10).cast("long")
    v = X.vehicles(spark, d).withColumns({x: second(x) for x in ("start_of_service_time", "end_of_service_time")})
    IO.write_csv(v, path, IO.VEHICLES_OTHER)
    return IO.read_vehicles(spark, path).drop("vehicle_id")


@query("s14_requests_csv", X.ctes("request") + "SELECT origin, destination, request_time, CAST(1 AS BIGINT) AS num_riders FROM request")
def s14(spark, d) -> DataFrame:
    """Requests written without riders, in seconds, and read again: one rider each."""
    path = new_path(spark, "requests")
    names = {n: to for n, to in IO.REQUESTS.items() if to != "num_riders"}
    IO.write_csv(X.requests(spark, d).withColumn("request_time", (c("request_time") / 10).cast("long")), path, names)
    return IO.read_requests(spark, path).drop("request_id")


@query("s15_od_pairs_csv", X.ctes("request") + "SELECT origin, destination, request_id%20 AS dijkstra_rank FROM request")
def s15(spark, d) -> DataFrame:
    path = new_path(spark, "od")
    rows = X.requests(spark, d).withColumn("dijkstra_rank", c("request_id") % 20)
    IO.write_csv(rows, path, {n: n for n in ("origin", "destination", "dijkstra_rank")})
    return IO.read_od_pairs(spark, path)


@query("s16_poly_round_trip", f"WITH {FACE_SQL} SELECT face, orient, k, x1, y1, x2, y2 FROM face")
def s16(spark, d) -> DataFrame:
    path = new_path(spark, "poly")
    IO.poly_lines(faces(spark), "area").coalesce(1).write.text(path)
    return IO.read_poly(spark, path).select(*[c(n).cast("long").alias(n) for n in ("face", "orient", "k", "x1", "y1", "x2", "y2")])


@query("s19_attributes", "SELECT unnest(['edge_id', 'tail', 'head', 'travel_time', 'length', 'category', 'psg_edge_id']) AS attribute")
def s19(spark, d) -> DataFrame:
    return IO.attributes(X.edges(spark, d))


@query("e09_visum_edges", E_SQL + "SELECT tail, head, length, least(30+10*(edge_id%10), 50+10*(category%5)) AS free_flow_speed, CAST(1+edge_id%3 AS BIGINT) AS lanes, CAST(floor(category*100/24.0::DOUBLE+0.5) AS BIGINT) AS capacity FROM edge WHERE edge_id%3<>0 AND category>0")
def e09(spark, d) -> DataFrame:
    k, text = c("edge_id"), lambda x: x.cast("string")
    rows = X.edges(spark, d).select(
        "tail", "head", (c("category") % 5).alias("type"), F.when(k % 3 == 0, "B,P").when(k % 3 == 1, "B,CAR").otherwise("CAR").alias("systems"), F.format_string("%.3fkm", c("length") / 1000).alias("length"),
        text(1 + k % 3).alias("lanes"), text(c("category") * 100).alias("capacity"), F.concat(text(30 + 10 * (k % 10)), F.lit("km/h")).alias("speed"),
    )
    top = spark.createDataFrame([(t, 50 + 10 * t) for t in range(5)], "type int, top long")
    return IO.visum_edges(rows, top, "CAR", 24)


@query("e11_coordinate_precision", X.ctes("vertex") + "SELECT vertex_id, lng//10*10 AS lng, lat//10*10 AS lat FROM vertex")
def e11(spark, d) -> DataFrame:
    """Coordinates of five decimals as micro-degrees."""
    tenth = lambda x: F.floor(c(x) / 10)
    lines = X.vertices(spark, d).select(F.concat_ws(" ", F.lit("v"), c("vertex_id") + 1, tenth("lng"), tenth("lat")).alias("value"))
    return IO.parse_dimacs_coordinates(lines, 5)


@query("e22_category_names", E_SQL + "SELECT edge_id, list_extract([" + ",".join(f"'{n}'" for n in N.CATEGORIES) + "], category+1) AS name, CAST(category AS INT) AS rank, category IN (1,3,5,7,9) AS link FROM edge")
def e22(spark, d) -> DataFrame:
    """Names of categories, and their ranks parsed from the names, which may have spaces around and capitals."""
    name = F.get(F.array(*[F.lit(n) for n in N.CATEGORIES]), c("category"))
    rows = X.edges(spark, d).select("edge_id", name.alias("name"))
    text = F.concat(F.lit("  "), F.upper("name"), F.lit(" "))
    ranks = F.create_map(*[F.lit(x) for i, n in enumerate(N.CATEGORIES) for x in (n, i)])
    return rows.select("edge_id", "name", ranks[F.lower(F.trim(text))].cast("int").alias("rank"), c("name").endswith("_link").alias("link"))


SOURCES = """src AS (SELECT DISTINCT (s_suppkey*53+7)%n AS s FROM supplier CROSS JOIN n),
 r(s, v, d) USING KEY (s, v) AS (SELECT s, s, CAST(0 AS BIGINT) FROM src UNION SELECT q.s, q.head, min(q.d) FROM (SELECT r.s, head, r.d+travel_time AS d FROM r JOIN edge ON tail=r.v) q LEFT JOIN recurring.r o ON o.s=q.s AND o.v=q.head WHERE o.d IS NULL OR q.d<o.d GROUP BY q.s, q.head)"""
FROM_SOURCES = X.ctes("edge", recursive=True, more=SOURCES)


def sources(spark, d) -> DataFrame:
    n = X.vertices(spark, d).count()
    return X.table(spark, d, "supplier").select(((X.L("s_suppkey") * 53 + 7) % n).alias("source"))


@query("g03_simultaneous_searches", FROM_SOURCES + "SELECT s AS source, count(*) AS reached, max(d) AS farthest, CAST(sum(d) AS BIGINT) AS total FROM r GROUP BY s")
def g03(spark, d) -> DataFrame:
    return H.totals_from(H.index_of(X.edges(spark, d)), sources(spark, d))


@query("g24_search_space", FROM_SOURCES + "SELECT a.s AS source, t AS target, a.v AS vertex_id, a.d AS dist FROM r a JOIN (SELECT s, v AS t, d AS u FROM r JOIN n ON v=(s*7+3)%n) g USING (s) WHERE a.d<u OR a.d=u AND a.v<=t")
def g24(spark, d) -> DataFrame:
    n = X.vertices(spark, d).count()
    return H.settled_before(H.index_of(X.edges(spark, d)), sources(spark, d).withColumn("target", (c("source") * 7 + 3) % n))


@query("g26_nearest_other_vertex", FROM_SOURCES + "SELECT s AS source, m.v AS vertex_id, m.d AS dist FROM (SELECT s, min({'d': d, 'v': v}) AS m FROM r WHERE v<>s AND v%3=0 GROUP BY s)")
def g26(spark, d) -> DataFrame:
    third = c("vertex_id") % 3 == 0
    return A.nearest_other(A.until(X.edges(spark, d), sources(spark, d), lambda rows: A.nearest_other(rows, third), 2), third)


@query("a16_pairs_by_rank", FROM_SOURCES + "SELECT s AS source, v AS vertex_id, d AS dist FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, v)-1 AS k FROM r) WHERE k=64")
def a16_rank(spark, d) -> DataFrame:
    return A.at_rank(A.until(X.edges(spark, d), sources(spark, d), A.more_than(64), 5), 64)


@query("a16_pairs_by_distance", FROM_SOURCES + "SELECT s AS source, m.v AS vertex_id, m.d AS dist FROM (SELECT s, min({'d': d, 'v': v}) AS m FROM r WHERE d>=1500 GROUP BY s)")
def a16_distance(spark, d) -> DataFrame:
    return A.at_distance(A.until(X.edges(spark, d), sources(spark, d), lambda rows: A.at_distance(rows, 1500), 8), 1500)


@query("a16_uniform_pairs", X.ctes("edge", more="pool AS (SELECT edge_id, row_number() OVER (ORDER BY edge_id)-1 AS k, count(*) OVER () AS m FROM edge WHERE category<=13)") + "SELECT c_custkey AS id, a.edge_id AS origin, b.edge_id AS destination FROM customer JOIN pool a ON a.k=(c_custkey*7919+13)%a.m JOIN pool b ON b.k=(c_custkey*104729+31)%b.m")
def a16_uniform(spark, d) -> DataFrame:
    pool = X.edges(spark, d).where(N.open_to_cars(c("category")))
    k = X.L("c_custkey")
    rows = X.table(spark, d, "customer").select(k.alias("id"), (k * 7919 + 13).alias("u"), (k * 104729 + 31).alias("w"))
    rows = A.draw(rows, pool.select(c("edge_id").alias("origin")), "origin")
    return A.draw(rows, pool.select(c("edge_id").alias("destination")), "destination", "w").select("id", "origin", "destination")


@query("a16_pairs_until_total", "SELECT event_id FROM (SELECT event_id, sum(100+event_id%37) OVER (ORDER BY event_id) - (100+event_id%37) AS before FROM events) WHERE before<60000")
def a16_total(spark, d) -> DataFrame:
    rows = X.table(spark, d, "events").select(X.L("event_id").alias("event_id")).withColumn("length", 100 + c("event_id") % 37)
    return A.until_total(rows, ["event_id"], "length", 60_000).select("event_id")


@query("a15_random_vehicles", X.ctes("edge", more="pool AS (SELECT edge_id, row_number() OVER (ORDER BY edge_id)-1 AS k, count(*) OVER () AS m FROM edge WHERE category<=13 AND psg_edge_id IS NOT NULL)") + "SELECT s_suppkey AS vehicle_id, edge_id AS initial_location, CAST(0 AS BIGINT) AS start_of_service_time, CAST(864000 AS BIGINT) AS end_of_service_time, CAST(4 AS BIGINT) AS capacity FROM supplier JOIN pool ON k=(s_suppkey*7919+5)%m")
def a15(spark, d) -> DataFrame:
    """A fleet at edges drawn from those open to cars and people."""
    pool = X.edges(spark, d).where(N.open_to_cars(c("category")) & c("psg_edge_id").isNotNull()).select(c("edge_id").alias("initial_location"))
    rows = A.draw(X.table(spark, d, "supplier").select(X.L("s_suppkey").alias("vehicle_id"), (X.L("s_suppkey") * 7919 + 5).alias("u")), pool, "initial_location")
    long = lambda x: F.lit(x).cast("long")
    return rows.select("vehicle_id", "initial_location", long(0).alias("start_of_service_time"), long(864_000).alias("end_of_service_time"), long(4).alias("capacity"))


@query("a19_share_of_edges", E_SQL + "SELECT edge_id FROM edge WHERE edge_id*7919%100<20")
def a19(spark, d) -> DataFrame:
    return A.share(X.edges(spark, d), "edge_id", 20).select("edge_id")


@query("a21_merged_runs", "SELECT t, id, row_number() OVER (ORDER BY t, id)-1 AS place FROM (SELECT c_custkey*37%1000 AS t, c_custkey AS id FROM customer UNION ALL SELECT s_suppkey*91%1000, 1000000+s_suppkey FROM supplier)")
def a21(spark, d) -> DataFrame:
    a = X.table(spark, d, "customer").select((X.L("c_custkey") * 37 % 1000).alias("t"), X.L("c_custkey").alias("id"))
    b = X.table(spark, d, "supplier").select((X.L("s_suppkey") * 91 % 1000).alias("t"), (1_000_000 + X.L("s_suppkey")).alias("id"))
    return G.numbered(a.unionByName(b), ["t", "id"], "place")


@query(
    "a18_mapped_locations",
    X.ctes("vertex", "edge", more=POINTS + ", near AS (SELECT id, min({'d2': (p.lat-v.lat)*(p.lat-v.lat)+(p.lng-v.lng)*(p.lng-v.lng), 'v': vertex_id}) AS m FROM p, vertex v GROUP BY id), own AS (SELECT tail, min(edge_id) AS location FROM edge WHERE category<=13 AND psg_edge_id IS NOT NULL GROUP BY tail)")
    + "SELECT id, location FROM near JOIN own ON tail=m.v WHERE m.d2<=360000",
)
def a18(spark, d) -> DataFrame:
    """Cells "(lat|lng)" to the nearest vertex to an edge there; what is too far off or has no edge goes."""
    k = X.L("c_custkey")
    lat, lng = 52_400_000 + k * 7919 % 45_000, 13_100_000 + k * 104_729 % 60_000
    cells = X.table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("("), lat, F.lit("|"), lng, F.lit(")")).alias("cell"))
    p = cells.select("id", N.pair(c("cell")).alias("p")).select("id", c("p.a").cast("long").alias("lat"), c("p.b").cast("long").alias("lng"))
    near = G.nearest(p, X.vertices(spark, d)).where("d2 <= 360000")
    own = X.edges(spark, d).where(N.open_to_cars(c("category")) & c("psg_edge_id").isNotNull()).groupBy(c("tail").alias("vertex_id")).agg(F.min("edge_id").alias("location"))
    return near.join(own, "vertex_id").select("id", "location")


@query(
    "g21_region",
    X.ctes("vertex", "edge", more=FACE_SQL + ", hit AS (SELECT vertex_id, face, any_value(orient) AS orient FROM vertex, face GROUP BY vertex_id, face HAVING sum(CASE WHEN (y1<=lat)<>(y2<=lat) AND ((y2>y1)=((x2-x1)::BIGINT*(lat-y1)-(lng-x1)*(y2-y1)::BIGINT>0)) THEN 1 ELSE 0 END)%2=1), inside AS (SELECT vertex_id, row_number() OVER (ORDER BY vertex_id)-1 AS k FROM (SELECT vertex_id, arg_max(orient, face) AS o FROM hit GROUP BY vertex_id) WHERE o>0)")
    + "SELECT edge_id, a.k AS tail, b.k AS head FROM edge JOIN inside a ON a.vertex_id=tail JOIN inside b ON b.vertex_id=head",
)
def g21(spark, d) -> DataFrame:
    """Edges between the vertices of an area, renumbered."""
    inside = G.in_area(X.vertices(spark, d), faces(spark), "vertex_id", "lng", "lat")
    return G.subgraph(X.edges(spark, d), inside).select("edge_id", "tail", "head")


@query("u15_event_order", X.ctes("vehicle", "request") + "SELECT kind, id, time, row_number() OVER (ORDER BY time, kind, id)-1 AS place FROM (SELECT 0 AS kind, request_id AS id, request_time AS time FROM request UNION ALL SELECT 1, vehicle_id, vehicle_id*100 FROM vehicle)")
def u15(spark, d) -> DataFrame:
    """Events in the order that a replay takes them: by time, requests before vehicles, then by id."""
    r = X.requests(spark, d).select(F.lit(0).alias("kind"), c("request_id").alias("id"), c("request_time").alias("time"))
    v = X.vehicles(spark, d).select(F.lit(1).alias("kind"), c("vehicle_id").alias("id"), (c("vehicle_id") * 100).alias("time"))
    return G.numbered(r.unionByName(v), ["time", "kind", "id"], "place")


PATHS = """ls AS (SELECT vehicle_id, stop_idx, x.head AS v0, y.tail AS goal, lead(arr) OVER w AS arr_time, dep AS dep_time, y.edge_id AS last FROM (SELECT *, lead(location) OVER (PARTITION BY vehicle_id ORDER BY stop_idx) AS nl FROM rs) JOIN edge x ON x.edge_id=location LEFT JOIN edge y ON y.edge_id=nl WINDOW w AS (PARTITION BY vehicle_id ORDER BY stop_idx)),
 nx AS (SELECT a.t, e.tail AS v, min({'e': e.edge_id, 'h': e.head}) AS m FROM rt a JOIN edge e ON e.tail=a.v JOIN rt b ON b.t=a.t AND b.v=e.head WHERE a.v<>a.t AND b.d+e.travel_time=a.d GROUP BY a.t, e.tail),
 pth AS (SELECT vehicle_id, stop_idx, goal, v0 AS v, CAST('' AS VARCHAR) AS edges, CAST(v0 AS VARCHAR) AS nodes FROM ls WHERE last IS NOT NULL UNION ALL SELECT vehicle_id, stop_idx, goal, m.h, edges||m.e||':', nodes||':'||m.h FROM pth JOIN nx ON nx.t=goal AND nx.v=pth.v)"""


@query("u19_vehicle_paths", X.ctes("edge", recursive=True, more=f"{REQUEST}, {PLACES}, {ROUTES}, {PATHS}") + "SELECT vehicle_id, stop_idx, dep_time, arr_time, edges||last AS edges, nodes FROM pth JOIN ls USING (vehicle_id, stop_idx, goal) WHERE pth.v=goal")
def u19(spark, d) -> DataFrame:
    """The way of every vehicle on every leg: edges up to the next stop's own, and nodes, in order."""
    e = X.edges(spark, d)
    ends = e.select("edge_id", "tail", "head")
    legs = stops(spark, d).select("vehicle_id", "stop_idx", "location", c("dep").alias("dep_time"), F.lead("arr").over(S.by()).alias("arr_time"), F.lead("location").over(S.by()).alias("last")).where("last IS NOT NULL")
    legs = legs.join(ends.select(c("edge_id").alias("location"), c("head").alias("from_vertex")), "location").join(ends.select(c("edge_id").alias("last"), c("tail").alias("to_vertex")), "last")
    legs = legs.withColumn("leg", c("vehicle_id") * 1000 + c("stop_idx"))
    steps = D.leg_paths(e, legs).join(ends.select("edge_id", "head"), "edge_id")
    one = steps.groupBy("leg").agg(F.array_sort(F.collect_list(F.struct("step", "edge_id", "head"))).alias("s"))
    line = lambda x: F.transform(c(f"s.{x}"), lambda y: y.cast("string"))
    rows = legs.join(one, "leg", "left").withColumns({"e": F.coalesce(line("edge_id"), F.array().cast("array<string>")), "h": F.coalesce(line("head"), F.array().cast("array<string>"))})
    joined = lambda x: F.array_join(x, ":")
    return rows.select(
        "vehicle_id", "stop_idx", "dep_time", "arr_time", joined(F.concat("e", F.array(c("last").cast("string")))).alias("edges"), joined(F.concat(F.array(c("from_vertex").cast("string")), "h")).alias("nodes"),
    )
