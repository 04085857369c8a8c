"""Queries over pickup and dropoff locations, location distances, other metrics and report columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network as N
from ..operators import graph as G
from ..operators import locations as P
from . import fixtures as X
from .network_queries import SP

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}
#: Deciseconds on foot.
RADIUS = 300


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


FOOT = "foot AS (SELECT * FROM edge WHERE psg_edge_id IS NOT NULL)"
PICKUP = FOOT + f""", w(s, v, d) AS (SELECT DISTINCT head, head, CAST(0 AS BIGINT) FROM request JOIN edge ON edge_id=origin
   UNION SELECT s, head, d+travel_time FROM w JOIN foot ON tail=v WHERE d+travel_time<={RADIUS}),
 pickup AS (SELECT request_id, f.edge_id AS location, min(d+f.travel_time) AS walk FROM request JOIN edge o ON o.edge_id=origin JOIN w ON s=o.head JOIN foot f ON f.tail=v
   WHERE d+f.travel_time<={RADIUS} AND f.category<=13 GROUP BY 1, 2)"""
DROPOFF = FOOT + f""", w(s, v, d) AS (SELECT DISTINCT edge_id, tail, CAST(travel_time AS BIGINT) FROM request JOIN edge ON edge_id=destination WHERE travel_time<={RADIUS}
   UNION SELECT s, tail, d+travel_time FROM w JOIN foot ON head=v WHERE d+travel_time<={RADIUS}),
 dropoff AS (SELECT request_id, f.edge_id AS location, min(d) AS walk FROM request JOIN w ON s=destination JOIN foot f ON f.head=v WHERE f.category<=13 GROUP BY 1, 2)"""
CENTRED = ", own AS (SELECT request_id, location, min(walk) AS walk FROM (SELECT * FROM pickup UNION ALL SELECT request_id, origin, 0 FROM request) GROUP BY 1, 2)"


def with_requests(more: str) -> str:
    return X.ctes("edge", "request", recursive=True, more=more)


def foot(spark, d) -> DataFrame:
    return X.edges(spark, d).where("psg_edge_id IS NOT NULL")


@query("j01_pickups", with_requests(PICKUP) + "SELECT * FROM pickup")
def j01(spark, d) -> DataFrame:
    return P.pickups(X.requests(spark, d), X.edges(spark, d), foot(spark, d), RADIUS)


@query("j02_dropoffs", with_requests(DROPOFF) + "SELECT * FROM dropoff")
def j02(spark, d) -> DataFrame:
    return P.dropoffs(X.requests(spark, d), X.edges(spark, d), foot(spark, d), RADIUS)


@query(
    "j03_numbered_pickups",
    with_requests(PICKUP + CENTRED) + """SELECT request_id, location, walk, CASE WHEN location=origin THEN 0 WHEN r=0 THEN max(CASE WHEN location=origin THEN r END) OVER (PARTITION BY request_id) ELSE r END AS pd_id
 FROM (SELECT own.*, origin, row_number() OVER (PARTITION BY request_id ORDER BY location)-1 AS r FROM own JOIN request USING (request_id))""",
)
def j03(spark, d) -> DataFrame:
    return P.with_centre(j01(spark, d), X.requests(spark, d).select("request_id", c("origin").alias("centre")))


@query("j07_pickups_at_stops", X.ctes("edge", "request", "route_stop", recursive=True, more=PICKUP + CENTRED) + "SELECT request_id, location, vehicle_id, stop_idx FROM own JOIN route_stop USING (location)")
def j07(spark, d) -> DataFrame:
    return P.at_stops(j03(spark, d), X.route_stops(spark, d))


ONE = X.ctes("edge", recursive=True, more=SP) + "SELECT CAST(5 AS BIGINT) AS source, CAST(150 AS BIGINT) AS target, d AS dist FROM r WHERE s=5 AND v=150"


@query("g06_bidirectional", ONE)
def g06(spark, d) -> DataFrame:
    """From both ends, by joins."""
    return G.one_to_one(X.edges(spark, d), 5, 150)


@query("g02_one_to_one", ONE)
def g02(spark, d) -> DataFrame:
    one = lambda v, name: spark.createDataFrame([(v,)], f"{name} long")
    return G.many_to_many(X.edges(spark, d), one(5, "source"), one(150, "target"))


@query("g12_length_metric", X.ctes("edge", recursive=True, more=SP.replace("travel_time", "length")) + "SELECT CAST(s AS BIGINT) AS source, CAST(v AS BIGINT) AS vertex_id, d AS dist FROM r")
def g12(spark, d) -> DataFrame:
    start = spark.createDataFrame([(5, 5, 0), (77, 77, 0)], "source long, vertex_id long, dist long")
    return G.distances(X.edges(spark, d), start, weight="length").select("source", "vertex_id", "dist")


@query(
    "g14_location_distances",
    X.ctes("edge", recursive=True, more=SP) + "SELECT a.edge_id AS from_location, b.edge_id AS to_location, CASE WHEN a.edge_id=b.edge_id THEN 0 ELSE d+b.travel_time END AS dist FROM edge a JOIN r ON s=a.head JOIN edge b ON b.tail=v",
)
def g14(spark, d) -> DataFrame:
    e = X.edges(spark, d)
    sources = spark.createDataFrame([(5,), (77,)], "source long")
    reached = G.many_to_many(e, sources, X.vertices(spark, d).select(c("vertex_id").alias("target")))
    a = e.select(c("edge_id").alias("from_location"), c("head").alias("source"))
    b = e.select(c("edge_id").alias("to_location"), c("tail").alias("target"), "travel_time")
    dist = F.when(c("from_location") == c("to_location"), 0).otherwise(c("dist") + c("travel_time"))
    return reached.join(a, "source").join(b, "target").select("from_location", "to_location", dist.cast("long").alias("dist"))


@query("e25_clock_formats", "SELECT event_id, lpad(CAST(s//60 AS VARCHAR), greatest(2, length(CAST(s//60 AS VARCHAR))::INT), '0') || ':' || lpad(CAST(s%60 AS VARCHAR), 2, '0') AS mm_ss, lpad(CAST(s//3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s%3600//60 AS VARCHAR), 2, '0') AS hh_mm FROM (SELECT event_id, event_id*7919%60000 AS s FROM events)")
def e25(spark, d) -> DataFrame:
    s = X.L("event_id") * 7919 % 60000
    return X.table(spark, d, "events").select("event_id", N.minutes_seconds(s).alias("mm_ss"), N.hours_minutes(s).alias("hh_mm"))


@query("a08_column_means", "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def a08(spark, d) -> DataFrame:
    return X.table(spark, d, "lineitem").agg(*[F.round(F.avg(x), 6).alias(x) for x in ("l_quantity", "l_discount", "l_tax")])
