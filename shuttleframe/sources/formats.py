"""File formats of networks, fleets, requests and areas, as readers and writers on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import network as N
from ..functions.projection import to_degrees

c = F.col


def dimacs_arcs(edges: DataFrame, weight: str = "travel_time") -> DataFrame:
    """Arc lines of a DIMACS graph file; vertices count from 1."""
    return edges.select(F.concat_ws(" ", F.lit("a"), c("tail") + 1, c("head") + 1, c(weight)).alias("line"))


def parse_dimacs_arcs(lines: DataFrame) -> DataFrame:
    """(tail, head, weight) of the arc lines in ``value``; comment and problem lines don't count."""
    p = F.split("value", r"\s+")
    at = lambda i: p[i].cast("long")
    return lines.where(c("value").startswith("a ")).select((at(1) - 1).alias("tail"), (at(2) - 1).alias("head"), at(3).alias("weight"))


def parse_dimacs_coordinates(lines: DataFrame, precision: int = 6) -> DataFrame:
    """(vertex_id, lng, lat) in micro-degrees from 'v id lng lat' lines of ``precision`` decimals."""
    p, scale = F.split("value", r"\s+"), 10.0 ** (6 - precision)
    deg = lambda i: F.round(p[i].cast("double") * scale).cast("long")
    return lines.where(c("value").startswith("v ")).select((p[1].cast("long") - 1).alias("vertex_id"), deg(2).alias("lng"), deg(3).alias("lat"))


def read_dimacs(spark: SparkSession, arcs: str, coordinates: str, precision: int = 6) -> tuple[DataFrame, DataFrame]:
    return parse_dimacs_coordinates(spark.read.text(coordinates), precision), parse_dimacs_arcs(spark.read.text(arcs))


# Column names of the two dialects.
VEHICLES = {"initial_location": "initial_location", "start_of_service_time": "start_of_service_time", "end_of_service_time": "end_of_service_time", "capacity": "capacity"}
VEHICLES_OTHER = {"initial_location": "initial_location", "start_service_time": "start_of_service_time", "end_service_time": "end_of_service_time", "seating_capacity": "capacity"}
REQUESTS = {"origin": "origin", "destination": "destination", "req_time": "request_time", "num_riders": "num_riders"}
REQUESTS_OTHER = {"pickup_spot": "origin", "dropoff_spot": "destination", "min_dep_time": "request_time", "num_riders": "num_riders"}


def _csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.withColumn("__at", F.monotonically_increasing_id())


def _named(raw: DataFrame, dialects: tuple[dict[str, str], ...], optional: tuple[str, ...] = ()) -> DataFrame:
    for names in dialects:
        if all(n in raw.columns for n, to in names.items() if to not in optional):
            return raw.select("__at", *[(c(n) if n in raw.columns else F.lit(None)).cast("long").alias(to) for n, to in names.items()])
    raise ValueError(f"columns {raw.columns} are of no known dialect")


def read_vehicles(spark: SparkSession, path: str) -> DataFrame:
    """Fleet, ids by row, times in deciseconds; service must end after it starts."""
    from ..operators.graph import numbered

    v = numbered(_named(_csv(spark, path), (VEHICLES, VEHICLES_OTHER)), ["__at"], "vehicle_id").drop("__at")
    start, end = c("start_of_service_time") * 10, c("end_of_service_time") * 10
    checked = F.when(end > start, end).otherwise(F.raise_error(F.lit("service ends before it starts")).cast("long"))
    return v.withColumns({"start_of_service_time": start, "end_of_service_time": checked})


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests, ids by row, times in deciseconds, one rider where none is given."""
    from ..operators.graph import numbered

    r = numbered(_named(_csv(spark, path), (REQUESTS, REQUESTS_OTHER), ("num_riders",)), ["__at"], "request_id").drop("__at")
    return r.withColumns({"request_time": c("request_time") * 10, "num_riders": F.coalesce("num_riders", F.lit(1)).cast("long")})


def read_od_pairs(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    return raw.select(*[c(n).cast("long") for n in raw.columns if n != "__at"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, i): the lines of a file or folder, numbered in the order of files and of lines in them, each range by itself."""
    lines = spark.read.text(path).select("value", c("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    from ..operators.graph import numbered

    return numbered(lines, ["file", "at"], "i").select("value", "i")


def carried(lines: DataFrame, head: str, size: int = 65_536) -> DataFrame:
    """``lines`` (i, ...) with ``head`` filled from the last line before that has one: blocks of lines side by side, each block's
    first lines from the last head of the blocks before."""
    rows = lines.withColumn("__block", F.floor(c("i") / size))
    heads = rows.groupBy("__block").agg(F.max_by(head, F.when(c(head).isNotNull(), c("i"))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each block of lines.
    rows = rows.join(heads.withColumn("__before", before).drop("__last"), "__block")
    inside = F.last(head, ignorenulls=True).over(Window.partitionBy("__block").orderBy("i"))
    return rows.withColumn(head, F.coalesce(inside, "__before")).drop("__block", "__before")


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """(face, orient, k, x1, y1, x2, y2) of an OSM POLY file; a section whose name begins with "!" is a hole.

    Coordinates come as plain or exponential decimals.
    """
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & (c("i") > 0))
    is_point = c("value").rlike(r"^\s+[-+]?[0-9.]")
    header = F.when(~is_point & (F.trim("value") != "END"), F.struct(c("i").alias("at"), c("value").startswith("!").alias("hole")))
    rows = carried(lines.withColumn("section", header), "section").where(is_point & c("section").isNotNull())
    faces = rows.select(c("section.at").alias("at")).distinct().withColumn("face", F.row_number().over(Window.orderBy("at")) - 1)  # a row for each face
    xy = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    micro = [F.round(xy[k].cast("double") * 1e6).cast("long").alias(n) for k, n in enumerate(("x1", "y1"))]
    pts = rows.join(faces, c("section.at") == c("at")).select("face", "i", c("section.hole").alias("hole"), *micro)
    f = Window.partitionBy("face").orderBy("i")
    whole = f.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda n: F.coalesce(F.lead(n).over(f), F.first(n).over(whole))
    return pts.select("face", F.when(c("hole"), -1).otherwise(1).alias("orient"), (F.row_number().over(f) - 1).alias("k"), "x1", "y1", nxt("x1").alias("x2"), nxt("y1").alias("y2"))


def poly_lines(faces: DataFrame, title: str) -> DataFrame:
    """Lines of an OSM POLY file, in order of (face, k)."""
    deg = lambda n: F.format_string("%.6f", c(n) / 1e6)
    body = faces.groupBy("face", "orient").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("\t"), deg("x1"), F.lit("\t"), deg("y1")).alias("t")))).alias("p"))
    head = F.concat(F.when(c("orient") < 0, "!").otherwise(""), (c("face") + 1).cast("string"))
    block = F.concat_ws("\n", head, F.array_join(F.transform("p", lambda p: p["t"]), "\n"), F.lit("END"))
    text = F.concat(F.lit(title + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("face", block.alias("b")))), lambda s: s["b"]), "\n"), F.lit("\nEND"))
    return body.agg(text.alias("value"))


def osm_edges(ways: DataFrame) -> DataFrame:
    """Directed car edges of ways (way_id, from_node, to_node, length, category, maxspeed, lanes, oneway, junction, and the lanes of
    one direction, lanes_forward and lanes_backward, if there are such columns).

    One row for each open direction, with speed limit, lanes, free-flow speed, travel time and capacity.
    """
    open_ = ways.where(N.open_to_cars(c("category"))).withColumn("direction", N.direction(c("oneway"), c("junction"), c("category")))
    both = F.array(F.lit(1), F.lit(-1))
    dirs = open_.withColumn("dir", F.explode(F.when(c("direction") == "both", both).when(c("direction") == "forward", F.array(F.lit(1))).otherwise(F.array(F.lit(-1)))))
    limit = F.round(N.speed_limit(c("maxspeed"), c("category"))).cast("long")
    given = F.regexp_extract("maxspeed", r"([0-9]+)", 1).try_cast("long") > 0
    tag = lambda n: c(n).try_cast("double") if n in ways.columns else F.lit(None).cast("double")
    own = F.when(c("dir") == 1, tag("lanes_forward")).otherwise(tag("lanes_backward"))
    n_lanes = N.lanes(tag("lanes"), F.when(own > 0, own), c("direction") == "both", c("category"))
    out = dirs.select(
        "way_id", F.when(c("dir") == 1, c("from_node")).otherwise(c("to_node")).alias("tail"), F.when(c("dir") == 1, c("to_node")).otherwise(c("from_node")).alias("head"),
        "length", "category", limit.alias("speed_limit"), n_lanes.alias("lanes"), N.free_flow_speed(limit, F.coalesce(given, F.lit(False)), c("category"), c("length")).alias("free_flow_speed"),
    )
    return out.withColumns({"travel_time": N.travel_time(c("length"), c("free_flow_speed")), "capacity": N.capacity(c("lanes"), c("category"), c("length"))})


def read_matsim(spark: SparkSession, path: str, mode: str = "car", epsg: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a MATSim network XML file, links of one mode; with ``epsg`` also lat and lng in micro-degrees, coordinates
    being rounded to whole units first."""
    xml = lambda tag: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").load(path)
    nodes = xml("node").select(c("_id").cast("string").alias("node"), c("_x").cast("double").alias("x"), c("_y").cast("double").alias("y"))
    if epsg is not None:
        lat, lng = to_degrees(epsg, F.round("x"), F.round("y"))
        nodes = nodes.withColumns({"lat": F.round(lat * 1e6).cast("long"), "lng": F.round(lng * 1e6).cast("long")})
    links = xml("link").where(F.array_contains(F.split("_modes", r"\s*,\s*"), mode))
    return nodes, links.select(
        c("_id").cast("string").alias("link"), c("_from").cast("string").alias("tail"), c("_to").cast("string").alias("head"), c("_length").cast("double").alias("length"),
        N.matsim_travel_time(c("_length").cast("double"), c("_freespeed").cast("double") * 3.6).alias("travel_time"),
    )


def read_visum(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a Visum export (sections headed "$TABLE:COL;COL"), by its columns, with the line's number ``i``."""
    lines = numbered_lines(spark, path)
    names = lines.where(c("value").startswith(f"${table}:")).orderBy("i").first()
    if names is None:
        raise ValueError(f"no table {table}")
    cut = carried(lines.withColumn("head", F.when(c("value").startswith("$"), c("value"))), "head")
    own = cut.where(c("head").startswith(f"${table}:")).where(~c("value").startswith("$") & ~c("value").startswith("*") & (F.trim("value") != ""))
    cells = F.split("value", ";", -1)
    return own.select("i", *[F.trim(cells[k]).alias(n) for k, n in enumerate(names["value"].split(":", 1)[1].split(";"))])


def visum_network(spark: SparkSession, path: str, system: str, to_degrees, period: int = 1) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a folder with KNOTEN.csv, STRECKE.csv, STRECKENPOLY.csv and STRECKENTYP.csv.

    vertices: (vertex_id, node, lat, lng), ids in the order of lines; edges: tail, head, length, free_flow_speed, lanes,
    capacity, and the polyline [(lat, lng)] between the ends, which both directions of a pair of nodes have, one of them
    reversed. ``to_degrees`` (x, y) gives (lat, lng) in degrees.
    """
    from ..operators.graph import numbered

    number = lambda n: F.regexp_replace(n, ",", ".").cast("double")
    at = lambda: [F.round(v * 1e6).cast("long").alias(n) for v, n in zip(to_degrees(number("XKOORD"), number("YKOORD")), ("lat", "lng"), strict=True)]
    nodes = read_visum(spark, f"{path}/KNOTEN.csv", "KNOTEN").select("i", c("NR").cast("long").alias("node"), *at())
    vertices = numbered(nodes, ["i"], "vertex_id").drop("i")
    types = read_visum(spark, f"{path}/STRECKENTYP.csv", "STRECKENTYP")
    top = F.regexp_extract(f"`VMAX-IVSYS({system.upper()})`", r"([0-9]+)", 1).cast("long")
    types = types.select(c("NR").cast("int").alias("type"), top.alias("top"))
    raw = read_visum(spark, f"{path}/STRECKE.csv", "STRECKE").select(
        c("VONKNOTNR").cast("long").alias("tail"), c("NACHKNOTNR").cast("long").alias("head"), c("TYPNR").cast("int").alias("type"), c("VSYSSET").alias("systems"),
        c("LAENGE").alias("length"), c("ANZFAHRSTREIFEN").alias("lanes"), c("KAPIV").alias("capacity"), c("V0IV").alias("speed"),
    )
    edges = visum_edges(raw, types, system, period)
    bends = read_visum(spark, f"{path}/STRECKENPOLY.csv", "STRECKENPOLY").select(c("VONKNOTNR").cast("long").alias("u"), c("NACHKNOTNR").cast("long").alias("v"), c("INDEX").cast("int").alias("k"), *at())
    lines = bends.groupBy("u", "v").agg(F.array_sort(F.collect_list(F.struct("k", "lat", "lng"))).alias("p")).withColumn("p", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))))
    both = lines.select(c("u").alias("tail"), c("v").alias("head"), "p", F.lit(0).alias("turned")).unionByName(lines.select(c("v").alias("tail"), c("u").alias("head"), F.reverse("p").alias("p"), F.lit(1).alias("turned")))
    own = both.groupBy("tail", "head").agg(F.min_by("p", "turned").alias("polyline"))
    edges = edges.join(own, ["tail", "head"], "left")
    ends = lambda name: vertices.select(c("node").alias(name), c("vertex_id").alias(f"{name}_id"))
    edges = edges.join(ends("tail"), "tail").join(ends("head"), "head").drop("tail", "head").withColumnsRenamed({"tail_id": "tail", "head_id": "head"})
    return vertices, edges


def feature(properties: dict, kind: str, coordinates) -> object:
    """One GeoJSON feature as JSON text."""
    shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"), shape.alias("geometry")))


def point_features(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """GeoJSON point features, one JSON text a row."""
    return rows.select(feature({"id": c(key)}, "Point", F.array(x, y)).alias("feature"))


def _line(rows: DataFrame, edges: DataFrame, vertices: DataFrame, at: str, properties: dict) -> DataFrame:
    """Line features of the edges that rows (``at``) lie on, in degrees."""
    end = lambda e: vertices.select(c("vertex_id").alias(e), F.array(c("lng") / 1e6, c("lat") / 1e6).alias(f"{e}_at"))
    found = rows.join(edges.select(c("edge_id").alias(at), "tail", "head"), at).join(end("tail"), "tail").join(end("head"), "head")
    return found.select(feature(properties, "LineString", F.array("tail_at", "head_at")).alias("feature"))


def edge_features(edges: DataFrame, vertices: DataFrame, percent: int = 100) -> DataFrame:
    """Edges as black lines; ``percent`` of a hundred, the same ones each time."""
    some = edges.where(F.pmod(c("edge_id") * 7919, F.lit(100)) < percent)
    return _line(some.select("edge_id"), edges, vertices, "edge_id", {"edge_id": c("edge_id"), "stroke": F.lit("black")})


def request_features(requests: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Origins as blue lines and destinations as red ones."""
    def side(name: str, colour: str) -> DataFrame:
        rows = requests.select("request_id", c(name).alias("edge_id"))
        return _line(rows, edges, vertices, "edge_id", {"stroke": F.lit(colour), "edge_id": c("edge_id"), "request_id": c("request_id"), "type": F.lit(name)})

    return side("origin", "blue").unionByName(side("destination", "red"))


def request_squares(requests: DataFrame, edges: DataFrame, vertices: DataFrame, side: int, opacity: float = 1.0) -> DataFrame:
    """Squares of ``side`` metres around the heads of origins (blue) and destinations (red), from the north-west corner against the clock."""
    def squares(name: str, colour: str) -> DataFrame:
        rows = requests.select("request_id", c(name).alias("edge_id")).join(edges.select("edge_id", c("head").alias("vertex_id")), "edge_id").join(vertices, "vertex_id")
        dy = F.degrees(F.lit(side / 2) / N.EARTH)
        dx = F.degrees(F.lit(side / 2) / (N.EARTH * F.cos(F.radians(c("lat") / 1e6))))
        corner = lambda sx, sy: F.array(F.round(c("lng") / 1e6 + sx * dx, 9), F.round(c("lat") / 1e6 + sy * dy, 9))
        ring = F.array(corner(-1, 1), corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
        properties = {"fill": F.lit(colour), "stroke-width": F.lit(0), "opacity": F.lit(opacity), "vertex_id": c("vertex_id"), "request_id": c("request_id"), "type": F.lit(name)}
        return rows.select(feature(properties, "Polygon", F.array(ring)).alias("feature"))

    return squares("origin", "blue").unionByName(squares("destination", "red"))


def vehicle_features(vehicles: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    rows = vehicles.select("vehicle_id", c("initial_location").alias("edge_id"))
    return _line(rows, edges, vertices, "edge_id", {"stroke": F.lit("blue"), "edge_id": c("edge_id"), "vehicle_id": c("vehicle_id")})


def search_space_features(space: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices that a search settles (source, target, vertex_id, dist) as points."""
    rows = space.join(vertices, "vertex_id")
    return rows.select(feature({"vertex_id": c("vertex_id"), "source": c("source"), "dist": c("dist")}, "Point", F.array(c("lng") / 1e6, c("lat") / 1e6)).alias("feature"))


def collection(features: DataFrame, path: str) -> None:
    """A GeoJSON file collection: one feature a line, which readers of newline-delimited GeoJSON take."""
    features.write.mode("overwrite").text(path)


def write_log(rows: DataFrame, base: str, name: str) -> None:
    """A named CSV log: one dataset a log, with a header."""
    rows.write.mode("overwrite").option("header", True).csv(f"{base}.{name}.csv")


def read_log(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(f"{base}.{name}.csv")


def write_network(vertices: DataFrame, edges: DataFrame, path: str, ignore: tuple[str, ...] = ()) -> None:
    """A network as two tables, without the attributes to ignore."""
    for name, rows in (("vertices", vertices), ("edges", edges)):
        rows.drop(*ignore).write.mode("overwrite").parquet(f"{path}/{name}")


def read_network(spark: SparkSession, path: str, attributes: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges), of their attributes those that are asked for; the scan reads no others, and a missing one is null."""
    out = []
    for name, own in (("vertices", ("vertex_id",)), ("edges", ("edge_id", "tail", "head"))):
        rows = spark.read.parquet(f"{path}/{name}")
        out.append(rows if attributes is None else rows.select(*own, *[c(a) for a in attributes if a in rows.columns]))
    return out[0], out[1]


def import_network(vertices: DataFrame, edges: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """A network whose vertices (node, ...) and edges (tail, head, ...) come in any order and under any ids: vertices are
    numbered by node, edges by tail and then by ``order``; edges with an unknown end are an error."""
    from ..operators.graph import numbered

    v = numbered(vertices, ["node"], "vertex_id")
    ends = lambda name: v.select(c("node").alias(name), c("vertex_id").alias(f"{name}_id"))
    rows = edges.join(ends("tail"), "tail", "left").join(ends("head"), "head", "left")
    known = lambda name: F.when(c(f"{name}_id").isNotNull(), c(f"{name}_id")).otherwise(F.raise_error(F.lit(f"an edge's {name} is no vertex")).cast("long"))
    rows = rows.withColumns({"__t": known("tail"), "__h": known("head")}).drop("tail", "head", "tail_id", "head_id").withColumnsRenamed({"__t": "tail", "__h": "head"})
    return v, numbered(rows, ["tail", *order], "edge_id")


def write_dimacs(vertices: DataFrame, edges: DataFrame, path: str, weight: str = "travel_time") -> None:
    """A graph file (path.gr) and a coordinate file (path.co): problem lines first, then a line for each arc or vertex."""
    n, m = vertices.count(), edges.count()
    spark = vertices.sparkSession
    head = lambda text: spark.createDataFrame([(text,)], "line string")
    places = vertices.select(F.concat_ws(" ", F.lit("v"), c("vertex_id") + 1, "lng", "lat").alias("line"))
    for suffix, first, rows in (("gr", f"p sp {n} {m}", dimacs_arcs(edges, weight)), ("co", f"p aux sp co {n}", places)):
        # Part files are read in order: the problem line has the first one.
        head(first).coalesce(1).unionByName(rows).write.mode("overwrite").text(f"{path}.{suffix}")


#: Whole km/h of those on foot, who push a bicycle, and who ride one, as the integer attribute keeps them.
ON_FOOT, RIDING = 5, 18


def _both_ways(ways: DataFrame, speed) -> DataFrame:
    ends = F.explode(F.array(F.struct(c("from_node").alias("tail"), c("to_node").alias("head")), F.struct(c("to_node").alias("tail"), c("from_node").alias("head"))))
    rows = ways.select("way_id", "length", "category", ends.alias("e"), speed.alias("free_flow_speed"))
    return rows.select("way_id", "e.tail", "e.head", "length", "category", "free_flow_speed", N.travel_time(c("length"), c("free_flow_speed")).alias("travel_time"))


def osm_foot_edges(ways: DataFrame) -> DataFrame:
    """Edges on foot, both directions of every way that is open to pedestrians."""
    return _both_ways(ways.where(N.open_to_pedestrians(c("category"))), F.lit(ON_FOOT))


def osm_cycle_edges(ways: DataFrame) -> DataFrame:
    """Edges of cyclists, both directions; on paths for those on foot (but cycleways) they push."""
    pushing = c("category").between(14, 19)
    return _both_ways(ways.where(N.open_to_cyclists(c("category"))), F.when(pushing, ON_FOOT).otherwise(RIDING))


# km/h and lanes of the road categories 1 to 15; 13 are ferries, 14 isn't used.
XATF_SPEED = {1: 130, 2: 120, 3: 110, 4: 100, 5: 90, 6: 80, 7: 70, 8: 60, 9: 50, 10: 40, 11: 30, 12: 20, 15: 10}
XATF_LANES = {1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 15: 1}


def parse_xatf(lines: DataFrame, vertices: DataFrame) -> DataFrame:
    """Directed edges of XATF edge lines (``value``), with vertices (vertex_id, lat, lng).

    Direction 0 and 3 (closed) give both directions, 1 forward, 2 backward. A ferry's field holds minutes; its length is that of
    the great circle.
    """
    f = F.split("value", ",")
    at = lambda i: F.trim(f[i]).cast("long")
    rows = lines.select(at(1).alias("a"), at(2).alias("b"), at(4).alias("given"), at(6).alias("direction"), at(9).cast("int").alias("category"))
    forward, back = F.struct(c("a").alias("tail"), c("b").alias("head")), F.struct(c("b").alias("tail"), c("a").alias("head"))
    ends = F.when(c("direction") == 1, F.array(forward)).when(c("direction") == 2, F.array(back)).otherwise(F.array(forward, back))
    rows = rows.withColumn("e", F.explode(ends)).select("e.tail", "e.head", "given", "category")
    for end in ("tail", "head"):
        rows = rows.join(vertices.select(c("vertex_id").alias(end), c("lat").alias(f"{end}_lat"), c("lng").alias(f"{end}_lng")), end)
    table = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])[c("category")]
    ferry, speed, n = c("category") == 13, table(XATF_SPEED), table(XATF_LANES)
    circle = F.floor(N.great_circle(c("tail_lat"), c("tail_lng"), c("head_lat"), c("head_lng")) + 0.5).cast("long")
    return rows.select(
        "tail", "head", "category", F.when(ferry, circle).otherwise(c("given")).alias("length"),
        F.when(ferry, 600 * c("given")).otherwise(N.travel_time(c("given"), speed)).alias("travel_time"), n.cast("long").alias("lanes"),
        F.when(ferry, 0).otherwise(F.floor(9000.0 * n * speed / (5 * speed + 45) + 0.5)).cast("long").alias("capacity"),
    )


def visum_edges(rows: DataFrame, max_speed: DataFrame, system: str, period: int = 1) -> DataFrame:
    """(tail, head, length, free_flow_speed, lanes, capacity) of rows (tail, head, type, systems, length, lanes, capacity, speed) as text.

    Rows that the transport system may not use, without capacity or at speed 0 go; max_speed: (type, top).
    """
    number = lambda n, unit="": F.regexp_replace(F.trim(n), f"{unit}$", "").cast("double")
    speed = F.least(number("speed", "km/h").cast("long"), c("top"))
    open_ = F.array_contains(F.split("systems", ","), system)
    kept = rows.where(open_).join(max_speed, "type").withColumn("free_flow_speed", speed).where((c("free_flow_speed") > 0) & (number("capacity") > 0))
    return kept.select(
        "tail", "head", F.floor(number("length", "km") * 1000 + 0.5).cast("long").alias("length"), "free_flow_speed", number("lanes").cast("long").alias("lanes"),
        F.floor(number("capacity") / period + 0.5).cast("long").alias("capacity"),
    )


def attributes(rows: DataFrame) -> DataFrame:
    """(attribute): the names of a table's columns, by its schema alone."""
    return rows.sparkSession.createDataFrame([(n,) for n in rows.columns], "attribute string")


def write_csv(rows: DataFrame, path: str, names: dict[str, str]) -> None:
    """Columns under the names of a dialect, with a header."""
    rows.select(*[c(to).alias(n) for n, to in names.items()]).write.mode("overwrite").option("header", True).csv(path)
