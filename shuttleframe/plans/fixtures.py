"""Network, fleet, requests and schedules as derived from the test tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut

L = lambda x: F.col(x).cast("long")

STOP_TIME = 600

SQL = {
    "n": "n AS (SELECT count(*) AS n FROM part)",
    "vertex": "vertex AS (SELECT p_partkey AS vertex_id, 52400000 + 900*(p_partkey // 40) AS lat, 13100000 + 1500*(p_partkey % 40) AS lng FROM part)",
    "edge": """edge AS (SELECT 4*p_partkey+k AS edge_id, p_partkey AS tail,
       CASE k WHEN 0 THEN (p_partkey+1)%n WHEN 1 THEN (p_partkey+n-1)%n WHEN 2 THEN (p_partkey+40)%n ELSE (p_partkey+n-40)%n END AS head,
       60 + 10*((p_partkey*7+k*3+p_size)%30) AS travel_time, 100 + 5*((p_partkey*11+k*17)%60) AS length,
       CAST((p_partkey*5+k)%22 AS INT) AS category, CASE WHEN (4*p_partkey+k)%5=0 THEN NULL ELSE 4*p_partkey+k END AS psg_edge_id
       FROM part CROSS JOIN n CROSS JOIN (SELECT unnest([0,1,2,3]) AS k))""",
    "vehicle": """vehicle AS (SELECT s_suppkey AS vehicle_id, (s_suppkey*37+1)%(4*n) AS initial_location, CAST(0 AS BIGINT) AS start_of_service_time,
       CAST(1080000 AS BIGINT) AS end_of_service_time, CAST(2+s_nationkey%4 AS BIGINT) AS capacity FROM supplier CROSS JOIN n)""",
    "request": """request AS (SELECT event_id AS request_id, o + CASE WHEN o%5=0 THEN 1 ELSE 0 END AS origin, d + CASE WHEN d%5=0 THEN 1 ELSE 0 END AS destination,
       request_time, num_riders FROM (SELECT event_id, (user_id*53+event_id*7)%(4*n-1) AS o, (event_id*131+17)%(4*n-1) AS d, event_id*10 AS request_time,
       CAST(1+CASE WHEN event_id%7=0 THEN 1 ELSE 0 END AS BIGINT) AS num_riders FROM events CROSS JOIN n) q)""",
    "route_stop": """route_stop AS (SELECT vehicle_id, stop_idx, location, cum AS arr, cum + 600 + wait AS dep, cum + slack AS max_arr, n_dropoffs, occupancy, wait
       FROM (SELECT *, CAST(sum(leg_in + 600 + wait) OVER (PARTITION BY vehicle_id ORDER BY stop_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - 600 - wait AS cum
       FROM (SELECT l_orderkey AS vehicle_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)-1 AS BIGINT) AS stop_idx,
       CAST(4*l_partkey + l_linenumber%4 AS BIGINT) AS location, 60+10*(l_partkey%30) AS leg_in, CASE WHEN l_suppkey%3=0 THEN 10*(l_partkey%20) ELSE 0 END AS wait,
       CAST(l_linenumber%2 AS BIGINT) AS n_dropoffs, CAST(1+l_linenumber%3 AS BIGINT) AS occupancy, 1000+10*(l_suppkey%50) AS slack FROM lineitem) l) s)""",
}
NEEDS = {"edge": ["n"], "vehicle": ["n"], "request": ["n"]}


def ctes(*names: str, recursive: bool = False, more: str = "") -> str:
    """WITH clause of the fixtures named, and of what they need."""
    want = list(dict.fromkeys(d for x in names for d in (*NEEDS.get(x, []), x)))
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([SQL[x] for x in want] + ([more] if more else [])) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, d: str) -> DataFrame:
    key = L("p_partkey")
    return table(spark, d, "part").select(
        key.alias("vertex_id"), (52400000 + 900 * F.floor(key / 40)).cast("long").alias("lat"), (13100000 + 1500 * (key % 40)).alias("lng")
    )


def _n(spark: SparkSession, d: str) -> int:
    return table(spark, d, "part").count()


_EDGES: dict[tuple[str, str], DataFrame] = {}


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The network, written as a table once in an application: four edges a part, which Spark takes for fewer bytes than parts have, so that
    it would send millions of edges to the driver and from there to all executors, where they are joined."""
    at = spark.sparkContext.applicationId, d
    if at not in _EDGES:
        _EDGES[at] = cut(_edges(spark, d), "edges")
    return _EDGES[at]


def _edges(spark: SparkSession, d: str) -> DataFrame:
    n, key, k = _n(spark, d), L("p_partkey"), F.col("k")
    head = F.when(k == 0, (key + 1) % n).when(k == 1, (key + n - 1) % n).when(k == 2, (key + 40) % n).otherwise((key + n - 40) % n)
    edge_id = 4 * key + k
    return (
        table(spark, d, "part")
        .select("p_partkey", "p_size", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("k"))
        .select(
            edge_id.alias("edge_id"),
            key.alias("tail"),
            head.alias("head"),
            (60 + 10 * ((key * 7 + k * 3 + F.col("p_size")) % 30)).alias("travel_time"),
            (100 + 5 * ((key * 11 + k * 17) % 60)).alias("length"),
            ((key * 5 + k) % 22).cast("int").alias("category"),
            F.when(edge_id % 5 != 0, edge_id).alias("psg_edge_id"),
        )
    )


def vehicles(spark: SparkSession, d: str) -> DataFrame:
    n, key = _n(spark, d), L("s_suppkey")
    return table(spark, d, "supplier").select(
        key.alias("vehicle_id"),
        ((key * 37 + 1) % (4 * n)).alias("initial_location"),
        F.lit(0).cast("long").alias("start_of_service_time"),
        F.lit(1080000).cast("long").alias("end_of_service_time"),
        (2 + F.col("s_nationkey") % 4).cast("long").alias("capacity"),
    )


def _off_five(x: Column) -> Column:
    return x + F.when(x % 5 == 0, 1).otherwise(0)


def requests(spark: SparkSession, d: str) -> DataFrame:
    n, e, u = _n(spark, d), L("event_id"), L("user_id")
    return table(spark, d, "events").select(
        e.alias("request_id"),
        _off_five((u * 53 + e * 7) % (4 * n - 1)).alias("origin"),
        _off_five((e * 131 + 17) % (4 * n - 1)).alias("destination"),
        (e * 10).alias("request_time"),
        (1 + F.when(e % 7 == 0, 1).otherwise(0)).cast("long").alias("num_riders"),
    )


def route_stops(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    line, part, supp = L("l_linenumber"), L("l_partkey"), L("l_suppkey")
    rows = table(spark, d, "lineitem").select(
        L("l_orderkey").alias("vehicle_id"),
        (F.row_number().over(order) - 1).cast("long").alias("stop_idx"),
        (4 * part + line % 4).alias("location"),
        (60 + 10 * (part % 30)).alias("leg_in"),
        F.when(supp % 3 == 0, 10 * (part % 20)).otherwise(0).alias("wait"),
        (line % 2).alias("n_dropoffs"),
        (1 + line % 3).alias("occupancy"),
        (1000 + 10 * (supp % 50)).alias("slack"),
    )
    run = Window.partitionBy("vehicle_id").orderBy("stop_idx").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(F.col("leg_in") + STOP_TIME + F.col("wait")).over(run) - STOP_TIME - F.col("wait")
    return rows.withColumn("arr", cum).select(
        "vehicle_id", "stop_idx", "location", "arr", (F.col("arr") + STOP_TIME + F.col("wait")).alias("dep"),
        (F.col("arr") + F.col("slack")).alias("max_arr"), "n_dropoffs", "occupancy", "wait",
    )
