"""Buckets of legs at hubs of the network: which legs can reach a hub, or be reached from it, within their leeway.

The table is stored by parts of the hubs. Changes of routes rewrite the parts that the changed legs' hubs are in, and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, new_path
from .hierarchy import Index, hub_rows

c = F.col
#: Parts that the hubs are dealt to.
PARTS = 64
ENTRY = ["hub", "onward", "vehicle_id", "at"]
SCHEMA = "hub long, onward boolean, vehicle_id long, at long, dist long, part int"


def entries(index: Index, legs: DataFrame) -> DataFrame:
    """(hub, onward, vehicle_id, at, dist) of legs (vehicle_id, at, stop_head, next_tail, leeway): the way from the stop's head to each hub
    within the leeway, or onward from the hub to the next stop's tail."""
    ends = legs.select(c("stop_head").alias("vertex_id"), F.lit(False).alias("back"), c("leeway").alias("most")).union(legs.select("next_tail", F.lit(True), "leeway"))
    hubs = cut(hub_rows(index, ends))
    legs = legs.select("vehicle_id", "at", "stop_head", "next_tail", "leeway")
    side = lambda end, onward: legs.join(hubs.where(c("back") == onward), c(end) == c("vertex_id")).where("dist <= leeway").select("hub", F.lit(onward).alias("onward"), "vehicle_id", "at", "dist")
    return side("stop_head", False).union(side("next_tail", True))


def _part(hub: Column) -> Column:
    return F.pmod(F.xxhash64(hub), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Buckets:
    index: Index
    path: str

    @staticmethod
    def of(index: Index, legs: DataFrame) -> Buckets:
        path = new_path(legs.sparkSession, "buckets")
        entries(index, legs).withColumn("part", _part(c("hub"))).write.partitionBy("part").parquet(path)
        return Buckets(index, path)

    def rows(self, spark: SparkSession) -> DataFrame:
        """Rows without a hub only stand for parts that have become empty."""
        return spark.read.schema(SCHEMA).parquet(self.path).where("hub is not null")

    def change(self, gone: DataFrame, new: DataFrame) -> None:
        """Takes the legs ``gone`` out and puts ``new`` ones in, both with the columns of ``entries``' legs."""
        spark = gone.sparkSession
        out, add = (cut(entries(self.index, legs).withColumn("part", _part(c("hub")))) for legs in (gone, new))
        touched = [r["part"] for r in out.select("part").union(add.select("part")).distinct().collect()]
        if not touched:
            return
        kept = self.rows(spark).where(c("part").isin(touched)).join(out.select(*ENTRY), ENTRY, "left_anti")
        still = spark.createDataFrame([(p,) for p in touched], "part int")
        rows = kept.unionByName(add).unionByName(still, allowMissingColumns=True)
        cut(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)


def feasible_by_buckets(buckets: Buckets, edges: DataFrame, legs: DataFrame, locations: DataFrame) -> DataFrame:
    """(vehicle_id, at, x, to_x, from_x): locations (x) between a stop and the next one within the leg's leeway, with both ways, by joins at
    hubs alone. legs: (vehicle_id, at, stop, next, next_tt, leeway), those that the buckets hold."""
    spark = edges.sparkSession
    x = cut(locations.select("x").distinct().join(edges.select(c("edge_id").alias("x"), c("tail").alias("x_tail"), c("head").alias("x_head"), c("travel_time").alias("x_tt")), "x"))
    most = legs.agg(F.max("leeway").alias("most"))
    ends = x.select(c("x_tail").alias("vertex_id"), F.lit(True).alias("back")).union(x.select("x_head", F.lit(False))).join(F.broadcast(most))
    near, table = cut(hub_rows(buckets.index, ends)), buckets.rows(spark)

    def way(onward: bool, to: str) -> DataFrame:
        met = table.where(c("onward") == onward).withColumnRenamed("dist", "way").join(near.where(c("back") != onward), "hub")
        return met.groupBy("vehicle_id", "at", "vertex_id").agg(F.min(c("way") + c("dist")).alias(to))

    own = legs.select("vehicle_id", "at", "stop", "next", "next_tt", "leeway")
    to = way(False, "to").withColumnRenamed("vertex_id", "x_tail").join(x, "x_tail").join(own.select("vehicle_id", "at", "stop"), ["vehicle_id", "at"]).where("x <> stop")
    to = to.select("vehicle_id", "at", "x", "x_head", (c("to") + c("x_tt")).alias("to_x"))
    here = x.join(own, c("x") == c("stop")).select("vehicle_id", "at", "x", "x_head", F.lit(0).cast("long").alias("to_x"))
    both = to.unionByName(here).join(way(True, "on").withColumnRenamed("vertex_id", "x_head"), ["vehicle_id", "at", "x_head"]).join(own, ["vehicle_id", "at"])
    both = both.where("next <> x").withColumn("from_x", c("on") + c("next_tt"))
    return both.where("to_x + from_x <= leeway").select("vehicle_id", "at", "x", "to_x", "from_x")
