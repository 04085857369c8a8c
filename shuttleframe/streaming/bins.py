"""Request streams: event time is the request time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import fixtures as X
from ..storage import new_path


def binned(requests: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests by tumbling bins of their time; rows later than the watermark are dropped by the engine."""
    timed = requests.withColumn("ts", F.timestamp_millis(F.col("request_time") * 100)).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"))


def request_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins of all requests, run as a stream over files to its end."""
    folder = new_path(spark, "stream")
    rows = X.requests(spark, d)
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    name = f"bins_{uuid.uuid4().hex}"
    run = binned(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    out = spark.table(name)
    return out.select(F.floor(F.unix_timestamp(out["window.start"]) / 300).alias("bin"), "n")
