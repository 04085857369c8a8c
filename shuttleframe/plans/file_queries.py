"""Queries over files of networks and their features, with their SQL: written, and read again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network as N
from ..functions import projection as PR
from ..operators import graph as G
from ..operators import hierarchy as H
from ..sources import formats as IO
from ..sources.pbf import read_pbf, write_pbf
from ..storage import new_path
from . import fixtures as X
from .network_queries import CAP, E_SQL, MANY, SPEED

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("s01_network_tables", E_SQL + "SELECT edge_id, tail, head, travel_time FROM edge")
def s01(spark, d) -> DataFrame:
    """Written without the category, read with the travel time alone; an attribute that isn't there is left out."""
    path = new_path(spark, "network")
    IO.write_network(X.vertices(spark, d), X.edges(spark, d), path, ("category",))
    return IO.read_network(spark, path, ("lat", "travel_time", "category"))[1]


@query(
    "s02_imported_network",
    E_SQL + "SELECT row_number() OVER (ORDER BY tail, travel_time, old)-1 AS edge_id, tail, head, travel_time, old FROM (SELECT n-1-tail AS tail, n-1-head AS head, travel_time, edge_id AS old FROM edge CROSS JOIN n)",
)
def s02(spark, d) -> DataFrame:
    """A network under foreign ids, edges in any order."""
    v = X.vertices(spark, d).select((-c("vertex_id") * 3).alias("node"))
    e = X.edges(spark, d).select((-c("tail") * 3).alias("tail"), (-c("head") * 3).alias("head"), "travel_time", c("edge_id").alias("old"))
    return IO.import_network(v, e.repartition(7, "old"), ["travel_time", "old"])[1].select("edge_id", "tail", "head", "travel_time", "old")


@query(
    "s03_dimacs_files",
    X.ctes("edge", "vertex")
    + """SELECT 'a' AS kind, tail AS a, head AS b, CAST(travel_time AS BIGINT) AS w FROM edge UNION ALL SELECT 'v', vertex_id, lng, lat FROM vertex
 UNION ALL SELECT 'p', n, (SELECT count(*) FROM edge), 0 FROM n""",
)
def s03(spark, d) -> DataFrame:
    """A network exported to a graph and a coordinate file, with their problem lines, and imported again."""
    path = new_path(spark, "dimacs")
    IO.write_dimacs(X.vertices(spark, d), X.edges(spark, d), path)
    v, e = IO.read_dimacs(spark, f"{path}.gr", f"{path}.co")
    p = F.split("value", " ")
    problem = spark.read.text(f"{path}.gr").where(c("value").startswith("p sp ")).select(F.lit("p").alias("kind"), p[2].cast("long").alias("a"), p[3].cast("long").alias("b"), F.lit(0).cast("long").alias("w"))
    return problem.unionByName(e.select(F.lit("a").alias("kind"), c("tail").alias("a"), c("head").alias("b"), c("weight").alias("w"))).unionByName(v.select(F.lit("v").alias("kind"), c("vertex_id").alias("a"), c("lng").alias("b"), c("lat").alias("w")))


TAGS = {
    "maxspeed": ("CASE edge_id % 6 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN '0' WHEN 3 THEN 'walk' END", "CASE WHEN edge_id%6=0 THEN 50 WHEN edge_id%6=1 THEN 30*1.609344::DOUBLE END"),
    "lanes": ("CASE edge_id % 7 WHEN 0 THEN '3' WHEN 1 THEN 'many' END", "CASE WHEN edge_id%7=0 THEN 3 END"),
    "lanes_forward": ("CASE edge_id % 5 WHEN 0 THEN '2' WHEN 1 THEN '0' END", "CASE WHEN edge_id%5=0 THEN 2 END"),
    "lanes_backward": ("CASE edge_id % 11 WHEN 0 THEN '4' END", "CASE WHEN edge_id%11=0 THEN 4 END"),
    "oneway": ("CASE edge_id % 8 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN '-1' WHEN 4 THEN 'maybe' END", ""),
    "junction": ("CASE WHEN edge_id % 8 = 3 THEN 'roundabout' END", ""),
}
DIRECTION = "CASE WHEN edge_id%8=0 THEN 'both' WHEN edge_id%8=1 THEN 'forward' WHEN edge_id%8=2 THEN 'reverse' WHEN edge_id%8=3 THEN 'forward' WHEN category<2 THEN 'forward' ELSE 'both' END"
OSM = f"""ways AS (SELECT *, {DIRECTION} AS direction, CAST(round(coalesce({TAGS['maxspeed'][1]}, {SPEED})) AS BIGINT) AS lim, edge_id%6<2 AS given,
  {TAGS['lanes'][1]} AS l, {TAGS['lanes_forward'][1]} AS lf, {TAGS['lanes_backward'][1]} AS lb FROM edge WHERE category<=13),
 dirs AS (SELECT *, unnest(CASE direction WHEN 'both' THEN [1,-1] WHEN 'forward' THEN [1] ELSE [-1] END) AS dir FROM ways),
 own AS (SELECT *, CAST(coalesce(CASE WHEN dir=1 THEN lf ELSE lb END, CASE WHEN direction='both' THEN l/2 ELSE l END, CASE WHEN category IN (0) THEN 2 ELSE 1 END) AS DOUBLE) AS lanes,
  CAST(floor(CASE WHEN given THEN CASE WHEN lim<51 THEN lim*0.5::DOUBLE ELSE lim END WHEN category BETWEEN 2 AND 9 AND length<300 THEN (lim-10)*length/300.0::DOUBLE+10 ELSE lim END + 0.5) AS BIGINT) AS ff FROM dirs)"""


@query(
    "s04_osm_car_edges",
    X.ctes("edge", more=OSM)
    + f"""SELECT edge_id AS way_id, CASE WHEN dir=1 THEN tail ELSE head END AS tail, CASE WHEN dir=1 THEN head ELSE tail END AS head, lim AS speed_limit, lanes, ff AS free_flow_speed,
 CASE WHEN ff>0 THEN (72*length+ff)//(2*ff) END AS travel_time, CAST(floor(lanes*({CAP})*CASE WHEN length<100 THEN 2 ELSE 1 END+0.5) AS BIGINT) AS capacity FROM own""",
)
def s04(spark, d) -> DataFrame:
    ways = X.edges(spark, d).select(c("edge_id").alias("way_id"), "edge_id", c("tail").alias("from_node"), c("head").alias("to_node"), "length", "category")
    ways = ways.withColumns({n: F.expr(t) for n, (t, _) in TAGS.items()})
    return IO.osm_edges(ways).select("way_id", "tail", "head", "speed_limit", "lanes", "free_flow_speed", "travel_time", "capacity")


NAMES = ", ".join(f"'{x}'" for x in N.CATEGORIES)


@query(
    "s04_pbf_ways",
    X.ctes("edge", "vertex")
    + f"""SELECT edge_id AS way_id, tail AS from_node, head AS to_node, ([{NAMES}])[category+1] AS highway, CASE WHEN edge_id%3=0 THEN 'Straße '||(edge_id%50) END AS name, a.lat, a.lng, -b.lat AS to_lat, b.lng AS to_lng
 FROM edge JOIN vertex a ON a.vertex_id=tail JOIN vertex b ON b.vertex_id=head""",
)
def s04_pbf(spark, d) -> DataFrame:
    """Ways and their ends' places from PBF files that the network has been written to."""
    path, e, v = new_path(spark, "osm"), X.edges(spark, d), X.vertices(spark, d)
    names = F.array(*[F.lit(x) for x in N.CATEGORIES])
    named = F.when(c("edge_id") % 3 == 0, F.create_map(F.lit("name"), F.concat(F.lit("Straße "), (c("edge_id") % 50).cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(F.create_map(F.lit("highway"), names[c("category")]), named)
    write_pbf(e.select(c("edge_id").alias("way_id"), F.array("tail", "head").alias("refs"), tags.alias("tags")), path, "ways")
    # Nodes come in two lots; the second one lies south of the equator, and each vertex has a node there, too.
    nodes = v.select(c("vertex_id").alias("node_id"), "lat", "lng", F.create_map(F.lit("highway"), F.lit("crossing")).alias("tags"))
    south = v.select((-1 - c("vertex_id")).alias("node_id"), (-c("lat")).alias("lat"), "lng", F.create_map().cast("map<string,string>").alias("tags"))
    write_pbf(nodes, path, "nodes")
    write_pbf(south, path, "nodes")
    places = read_pbf(spark, path, "nodes")
    ends = read_pbf(spark, path, "ways").select("way_id", c("refs")[0].alias("from_node"), F.element_at("refs", -1).alias("to_node"), c("tags")["highway"].alias("highway"), c("tags")["name"].alias("name"))
    at = places.where("tags['highway'] = 'crossing'").select(c("node_id").alias("from_node"), "lat", "lng")
    beyond = places.where("node_id < 0").select((-1 - c("node_id")).alias("to_node"), c("lat").alias("to_lat"), c("lng").alias("to_lng"))
    return ends.join(at, "from_node").join(beyond, "to_node")


#: Lines that one task writes to a file, about.
FILE_LINES = 200_000


def enclosed(before: str, after: str):
    """Puts a line before and one after the lines of each task."""

    def lines(frames):
        yield pd.DataFrame({"value": [before]})
        yield from frames
        yield pd.DataFrame({"value": [after]})

    return lines


@query("s08_matsim_network", E_SQL + "SELECT 'l'||edge_id AS link, 'n'||tail AS tail, 'n'||head AS head, CAST(length AS DOUBLE) AS length, CAST(floor(3.6::DOUBLE*length/((5+category)*3.6::DOUBLE)) AS BIGINT)*10+10 AS travel_time FROM edge WHERE edge_id%3<>0")
def s08(spark, d) -> DataFrame:
    """A network file of this format, written and read: links open to cars."""
    path = new_path(spark, "matsim")
    v, e = X.vertices(spark, d), X.edges(spark, d)
    nodes = v.select(F.format_string('<node id="n%d" x="%d.4" y="%d.2"/>', "vertex_id", 4_500_000 + c("lng") - 13_000_000, c("lat") - 46_600_000).alias("value"))
    modes = F.when(c("edge_id") % 3 == 0, "bike").when(c("edge_id") % 3 == 1, "car").otherwise("bike, car")
    links = e.select(F.format_string('<link id="l%d" from="n%d" to="n%d" length="%d.0" freespeed="%d.0" capacity="600.0" permlanes="1.0" modes="%s"/>', "edge_id", "tail", "head", "length", 5 + c("category"), modes).alias("value"))
    # Every file is a document of its own, with some of the nodes or links, as a reader's task takes whole files.
    for lines, name in ((nodes, "nodes"), (links, "links")):
        pieces = lines.repartition(max(1, -(-lines.count() // FILE_LINES)))
        pieces.mapInPandas(enclosed(f"<network><{name}>", f"</{name}></network>"), "value string").write.mode("append").text(path)
    return IO.read_matsim(spark, path)[1]


VISUM_SQL = """SELECT tail, head, length, least(30+10*(edge_id%10), 50+10*(category%5)) AS free_flow_speed, CAST(1+edge_id%3 AS BIGINT) AS lanes, CAST(floor(category*100/24.0::DOUBLE+0.5) AS BIGINT) AS capacity,
 CASE WHEN tail%50=7 AND edge_id%4=0 THEN 2 WHEN head%50=7 AND tail=(head+1)%n THEN 2 ELSE 0 END AS bends FROM edge CROSS JOIN n WHERE edge_id%3<>0 AND category>0"""


@query("s09_visum_network", E_SQL + VISUM_SQL)
def s09(spark, d) -> DataFrame:
    """The tables of an export, written and read line by line: nodes, edges, their polylines, top speeds by type."""
    path = new_path(spark, "visum")
    v, e, k = X.vertices(spark, d), X.edges(spark, d), c("edge_id")
    order = lambda rows, head: spark.createDataFrame([(head,)], "value string").coalesce(1).unionByName(rows)
    decimal = lambda x: F.format_string("%.6f", x / 1e6)
    nodes = v.select(F.concat_ws(";", c("vertex_id") + 1000, decimal(c("lng")), decimal(c("lat"))).alias("value"))
    systems = F.when(k % 3 == 0, "B,P").when(k % 3 == 1, "B,CAR").otherwise("CAR")
    links = e.select(F.concat_ws(";", k, c("tail") + 1000, c("head") + 1000, c("category") % 5, systems, F.format_string("%.3fkm", c("length") / 1000), 1 + k % 3, c("category") * 100, F.concat((30 + 10 * (k % 10)).cast("string"), F.lit("km/h"))).alias("value"))
    types = spark.range(5).select(F.concat_ws(";", "id", F.concat((50 + 10 * c("id")).cast("string"), F.lit("km/h"))).alias("value"))
    bends = e.where("tail % 50 = 7 and edge_id % 4 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    bends = bends.select(F.concat_ws(";", c("tail") + 1000, c("head") + 1000, "k", decimal(13_000_000 + c("k")), decimal(52_000_000 + c("tail"))).alias("value"))
    tables = {"KNOTEN": (nodes, "NR;XKOORD;YKOORD"), "STRECKE": (links, "NR;VONKNOTNR;NACHKNOTNR;TYPNR;VSYSSET;LAENGE;ANZFAHRSTREIFEN;KAPIV;V0IV"), "STRECKENTYP": (types, "NR;VMAX-IVSYS(CAR)"), "STRECKENPOLY": (bends, "VONKNOTNR;NACHKNOTNR;INDEX;XKOORD;YKOORD")}
    for name, (rows, columns) in tables.items():
        order(rows, f"$VISION\n* a comment\n${name}:{columns}").write.text(f"{path}/{name}.csv")
    _, edges = IO.visum_network(spark, path, "CAR", lambda x, y: (y, x), 24)
    return edges.select("tail", "head", "length", "free_flow_speed", "lanes", "capacity", F.coalesce(F.size("polyline"), F.lit(0)).alias("bends"))


@query("s17_named_logs", X.ctes("vehicle") + "SELECT vehicle_id, capacity, 'fleet' AS log FROM vehicle UNION ALL SELECT vehicle_id, initial_location, 'start' FROM vehicle")
def s17(spark, d) -> DataFrame:
    """Two logs under one base name, each with its own header, read again."""
    base, v = new_path(spark, "run"), X.vehicles(spark, d)
    IO.write_log(v.select("vehicle_id", "capacity"), base, "fleet")
    IO.write_log(v.select("vehicle_id", c("initial_location").alias("capacity")), base, "start")
    read = lambda n: IO.read_log(spark, base, n, "vehicle_id long, capacity long").withColumn("log", F.lit(n))
    return read("fleet").unionByName(read("start"))


LINES = """f(id, kind, colour, e) AS ({0}), pts AS (SELECT id, kind, colour, e, t.lng/1e6 AS x1, t.lat/1e6 AS y1, h.lng/1e6 AS x2, h.lat/1e6 AS y2 FROM f JOIN edge ON edge_id=e JOIN vertex t ON t.vertex_id=tail JOIN vertex h ON h.vertex_id=head)
SELECT id, kind, colour, e AS edge_id, x1, y1, x2, y2 FROM pts"""
FEATURE = "type string, properties struct<edge_id: bigint, request_id: bigint, vehicle_id: bigint, source: bigint, dist: bigint, type: string, stroke: string, fill: string>, geometry struct<type: string, coordinates: {0}>"


def parsed(features: DataFrame, path: str, coordinates: str) -> DataFrame:
    """Features written as a collection, read again and parsed."""
    IO.collection(features, path)
    f = F.from_json("value", FEATURE.format(coordinates))
    return features.sparkSession.read.text(path).select(f.alias("f")).select("f.properties.*", c("f.geometry.type").alias("shape"), c("f.geometry.coordinates").alias("at"))


def lines(spark, features: DataFrame, key: str, kind: str) -> DataFrame:
    p, at = parsed(features, new_path(spark, "geojson"), "array<array<double>>"), c("at")
    own = c("type") if kind == "" else F.lit(kind)
    return p.where("shape = 'LineString'").select(c(key).alias("id"), own.alias("kind"), c("stroke").alias("colour"), c("edge_id"), at[0][0].alias("x1"), at[0][1].alias("y1"), at[1][0].alias("x2"), at[1][1].alias("y2"))


@query("s18_edge_features", X.ctes("edge", "vertex", more=LINES.format("SELECT edge_id, 'edge', 'black', edge_id FROM edge WHERE edge_id*7919%100<30")))
def s18_edges(spark, d) -> DataFrame:
    return lines(spark, IO.edge_features(X.edges(spark, d), X.vertices(spark, d), 30), "edge_id", "edge").withColumn("id", c("edge_id"))


@query("s18_request_features", X.ctes("edge", "vertex", "request", more=LINES.format("SELECT request_id, 'origin', 'blue', origin FROM request UNION ALL SELECT request_id, 'destination', 'red', destination FROM request")))
def s18_requests(spark, d) -> DataFrame:
    return lines(spark, IO.request_features(X.requests(spark, d), X.edges(spark, d), X.vertices(spark, d)), "request_id", "")


@query("s18_vehicle_features", X.ctes("edge", "vertex", "vehicle", more=LINES.format("SELECT vehicle_id, 'vehicle', 'blue', initial_location FROM vehicle")))
def s18_vehicles(spark, d) -> DataFrame:
    return lines(spark, IO.vehicle_features(X.vehicles(spark, d), X.edges(spark, d), X.vertices(spark, d)), "vehicle_id", "vehicle")


@query(
    "s18_request_squares",
    X.ctes("edge", "vertex", "request")
    + """SELECT request_id, kind, round(lng/1e6 - degrees(50/(6371000*cos(radians(lat/1e6)))), 9) AS west, round(lat/1e6 + degrees(50/6371000.0::DOUBLE), 9) AS north, 5 AS corners
 FROM (SELECT request_id, 'origin' AS kind, origin AS e FROM request UNION ALL SELECT request_id, 'destination', destination FROM request) JOIN edge ON edge_id=e JOIN vertex ON vertex_id=head""",
)
def s18_squares(spark, d) -> DataFrame:
    p = parsed(IO.request_squares(X.requests(spark, d), X.edges(spark, d), X.vertices(spark, d), 100, 0.5), new_path(spark, "geojson"), "array<array<array<double>>>")
    ring = c("at")[0]
    return p.select("request_id", c("type").alias("kind"), ring[0][0].alias("west"), ring[0][1].alias("north"), F.size(ring).alias("corners"))


@query(
    "s18_search_space",
    X.ctes("edge", "vertex", "vehicle", recursive=True, more=MANY) + "SELECT s AS source, d AS dist, lng/1e6 AS x, lat/1e6 AS y FROM m JOIN vertex ON vertex_id=v JOIN (SELECT s AS z, d AS upto, v AS goal FROM m WHERE v=0) ON z=s WHERE d<upto OR (d=upto AND v<=goal)",
)
def s18_space(spark, d) -> DataFrame:
    """What searches from the vehicles settle until they reach vertex 0."""
    e = X.edges(spark, d)
    sources = X.vehicles(spark, d).select(c("initial_location").alias("edge_id")).join(e, "edge_id").select(c("head").alias("source")).distinct()
    space = H.settled_before(H.index_of(e), sources.withColumn("target", F.lit(0).cast("long")))
    p = parsed(IO.search_space_features(space, X.vertices(spark, d)), new_path(spark, "geojson"), "array<double>")
    return p.select("source", "dist", c("at")[0].alias("x"), c("at")[1].alias("y"))


LAEA_SQL = """SELECT vertex_id, round(4321000+b*1.0004253945280137*cos(beta)*sin(dl), 1) AS x, round(3210000+b/1.0004253945280137*(0.6173729139148921*sin(beta)-0.7866706332158556*cos(beta)*cos(dl)), 1) AS y
 FROM (SELECT *, 6371007.1808835175*sqrt(2/(1+0.7866706332158556*sin(beta)+0.6173729139148921*cos(beta)*cos(dl))) AS b FROM (SELECT vertex_id, dl, asin((0.9933056199770992*(s/(1-0.006694380022900787*s*s)-ln((1-0.08181919104281579*s)/(1+0.08181919104281579*s))/0.16363838208563158))/1.9955310874809387) AS beta
 FROM (SELECT vertex_id, sin(radians(lat/1e6)) AS s, radians(lng/1e6)-radians(10) AS dl FROM vertex)))"""


@query("e15_equal_area_europe", X.ctes("vertex") + LAEA_SQL)
def e15(spark, d) -> DataFrame:
    x, y = PR.from_degrees(PR.LAEA_EUROPE, c("lat") / 1e6, c("lng") / 1e6)
    return X.vertices(spark, d).select("vertex_id", F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))


@query("e15_there_and_back", X.ctes("vertex") + "SELECT vertex_id, unnest([3035, 27700, 31467, 31468, 4326]) AS epsg, lat, lng FROM vertex")
def e15_back(spark, d) -> DataFrame:
    """Coordinates in every system and back to micro-degrees."""
    v, out = X.vertices(spark, d), None
    for epsg in (3035, 27700, 31467, 31468, 4326):
        x, y = PR.from_degrees(epsg, c("lat") / 1e6, c("lng") / 1e6)
        lat, lng = PR.to_degrees(epsg, c("x"), c("y"))
        rows = v.select("vertex_id", x.alias("x"), y.alias("y")).select("vertex_id", F.lit(epsg).alias("epsg"), F.round(lat * 1e6).cast("long").alias("lat"), F.round(lng * 1e6).cast("long").alias("lng"))
        out = rows if out is None else out.unionByName(rows)
    return out


# Polygons by their points in order: a square, a bow tie, one that turns back on itself, a dart, two points.
SHAPES = {0: ((0, 0), (4, 0), (4, 4), (0, 4)), 1: ((0, 0), (4, 4), (4, 0), (0, 4)), 2: ((0, 0), (6, 0), (3, 0), (3, 5)), 3: ((0, 0), (4, 1), (8, 0), (4, 8)), 4: ((0, 0), (1, 1))}
SHAPE_ROWS = [(s, k, len(p), *p[k], *p[(k + 1) % len(p)]) for s, p in SHAPES.items() for k in range(len(p))]
SHAPE_SQL = "side AS (SELECT * FROM (VALUES " + ",".join(map(str, SHAPE_ROWS)) + ") t(face, k, n, x1, y1, x2, y2))"
ORIENT = "sign((({2})-({0}))*(({5})-({1}))-(({3})-({1}))*(({4})-({0})))"


def _orient(*a: str) -> str:
    return ORIENT.format(*a)


MEET_SQL = f"""(({_orient('a.x1', 'a.y1', 'a.x2', 'a.y2', 'b.x1', 'b.y1')}<>{_orient('a.x1', 'a.y1', 'a.x2', 'a.y2', 'b.x2', 'b.y2')} AND {_orient('b.x1', 'b.y1', 'b.x2', 'b.y2', 'a.x1', 'a.y1')}<>{_orient('b.x1', 'b.y1', 'b.x2', 'b.y2', 'a.x2', 'a.y2')})
 OR ({_orient('a.x1', 'a.y1', 'a.x2', 'a.y2', 'b.x1', 'b.y1')}=0 AND {_orient('a.x1', 'a.y1', 'a.x2', 'a.y2', 'b.x2', 'b.y2')}=0 AND greatest(a.x1,a.x2)>=least(b.x1,b.x2) AND least(a.x1,a.x2)<=greatest(b.x1,b.x2) AND greatest(a.y1,a.y2)>=least(b.y1,b.y2) AND least(a.y1,a.y2)<=greatest(b.y1,b.y2)))"""
SIMPLE_SQL = f"""bad AS (SELECT a.face FROM side a JOIN side b ON a.face=b.face AND a.k<b.k WHERE CASE WHEN b.k=a.k+1 THEN {_orient('a.x1', 'a.y1', 'a.x2', 'a.y2', 'b.x2', 'b.y2')}=0 AND (a.x1-a.x2)*(b.x2-b.x1)+(a.y1-a.y2)*(b.y2-b.y1)>0
  WHEN a.k=0 AND b.k=a.n-1 THEN {_orient('b.x1', 'b.y1', 'b.x2', 'b.y2', 'a.x2', 'a.y2')}=0 AND (b.x1-b.x2)*(a.x2-a.x1)+(b.y1-b.y2)*(a.y2-a.y1)>0 ELSE {MEET_SQL} END)"""


@query("e17_simple_polygons", f"WITH {SHAPE_SQL}, {SIMPLE_SQL} SELECT CAST(face AS BIGINT) AS face, any_value(n)>=3 AND face NOT IN (SELECT face FROM bad) AS simple FROM side GROUP BY face")
def e17(spark, d) -> DataFrame:
    return G.simple_faces(spark.createDataFrame([(s, k, x1, y1, x2, y2) for s, k, _, x1, y1, x2, y2 in SHAPE_ROWS], "face long, k long, x1 long, y1 long, x2 long, y2 long"))


TWO_EDGES = "pairs AS (SELECT a.edge_id, t.lng AS x1, t.lat AS y1, h.lng AS x2, h.lat AS y2 FROM edge a JOIN vertex t ON t.vertex_id=a.tail JOIN vertex h ON h.vertex_id=a.head)"


@query("e20_segments_meet", X.ctes("edge", "vertex", more=TWO_EDGES) + f"SELECT a.edge_id, {MEET_SQL} AS meet FROM pairs a, (SELECT 13100000 AS x1, 52401000 AS y1, 13159000 AS x2, 52440500 AS y2) b")
def e20(spark, d) -> DataFrame:
    """Which edges a line across the network meets."""
    return _with_ends(spark, d).select("edge_id", N.segments_meet(c("x1"), c("y1"), c("x2"), c("y2"), F.lit(13_100_000), F.lit(52_401_000), F.lit(13_159_000), F.lit(52_440_500)).alias("meet"))


def _with_ends(spark, d) -> DataFrame:
    v = X.vertices(spark, d)
    end = lambda name, k: v.select(c("vertex_id").alias(name), c("lng").alias(f"x{k}"), c("lat").alias(f"y{k}"))
    return X.edges(spark, d).join(end("tail", 1), "tail").join(end("head", 2), "head")


@query("e19_rectangles_meet", X.ctes("edge", "vertex", more=TWO_EDGES) + "SELECT edge_id, greatest(x1,x2)>=13110000 AND least(x1,x2)<=13120500 AND greatest(y1,y2)>=52405000 AND least(y1,y2)<=52412000 AS meet FROM pairs")
def e19(spark, d) -> DataFrame:
    """Which edges' bounding boxes meet a rectangle."""
    low, high = lambda a: F.least(f"{a}1", f"{a}2"), lambda a: F.greatest(f"{a}1", f"{a}2")
    box = [F.lit(x) for x in (13_110_000, 52_405_000, 13_120_500, 52_412_000)]
    return _with_ends(spark, d).select("edge_id", N.rectangles_meet(low("x"), low("y"), high("x"), high("y"), *box).alias("meet"))


@query("e23_weekday_seconds", "SELECT event_id, CAST((isodow(ts)-1)*86400 + hour(ts)*3600 + minute(ts)*60 + CASE WHEN event_id%2=0 THEN second(ts) ELSE 0 END AS INT) AS s FROM events")
def e23(spark, d) -> DataFrame:
    """Seconds since Monday midnight from a day's name and a time with or without seconds."""
    names = F.array(*[F.array(*[F.lit(n) for n in day]) for day in N.DAYS])
    name = F.element_at(names, F.weekday("ts") + 1)
    text = F.when(c("event_id") % 2 == 0, F.date_format("ts", "HH:mm:ss")).otherwise(F.date_format("ts", "HH:mm"))
    day = F.element_at(name, (c("event_id") % 4 + 1).cast("int"))
    return X.table(spark, d, "events").select("event_id", N.seconds_since_monday(day, text).alias("s"))


@query(
    "e24_bit_places",
    E_SQL + """SELECT edge_id, CAST(64-CASE WHEN edge_id=0 THEN 0 ELSE length(bin(edge_id)) END AS INT) AS leading, CAST(CASE WHEN edge_id=0 THEN 64 ELSE length(bin(edge_id))-length(rtrim(bin(edge_id), '0')) END AS INT) AS trailing,
 CAST(CASE WHEN edge_id=0 THEN 0 ELSE length(bin(edge_id)) END-1 AS INT) AS highest, CAST(bit_count(edge_id % (1<<(edge_id%9))) AS INT) AS ones_before FROM edge""",
)
def e24(spark, d) -> DataFrame:
    x = c("edge_id")
    return X.edges(spark, d).select("edge_id", N.leading_zeros(x).alias("leading"), N.trailing_zeros(x).alias("trailing"), (63 - N.leading_zeros(x)).cast("int").alias("highest"), N.ones_before(x, x % 9).alias("ones_before"))


@query("e13_plate_carree", X.ctes("vertex") + "SELECT vertex_id, lng AS x, lat AS y FROM vertex")
def e13(spark, d) -> DataFrame:
    x, y = N.plate_carree(c("lng"), c("lat"))
    return X.vertices(spark, d).select("vertex_id", x.alias("x"), y.alias("y"))
