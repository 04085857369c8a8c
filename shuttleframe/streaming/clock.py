"""A simulated clock over streams: timers of vehicles in event time, and rows that come too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans import fixtures as X
from ..storage import new_path

c = F.col
#: A day after everything: the clock's last time.
FAR = 4_000_000_000_000


#: Vehicles by whose ids in a row a clock is shared: a call for each vehicle and each time would be far more costly than its rows.
FLEET = 64
NAMES = ["vehicle_id", "time_ms", "kind"]


class VehicleClock(StatefulProcessor):
    """Arrivals and departures of some vehicles as the clock reaches them: the state is the list of what is to come, with a timer for
    the first time in it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coming = handle.getListState("coming", "vehicle_id long, time_ms long, kind string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, passed = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            who = frame["vehicle_id"].tolist()
            both = sorted(zip([*who, *who], [*frame["arr_ms"].tolist(), *frame["dep_ms"].tolist()], ["arrival"] * len(frame) + ["departure"] * len(frame), strict=True))
            passed += [x for x in both if x[1] <= now]
            if later := [x for x in both if x[1] > now]:
                self.coming.appendList(later)
                self.handle.registerTimer(min(t for _, t, _ in later))
        yield _told(passed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, rows = timerValues.getCurrentWatermarkInMs(), [(int(r[0]), int(r[1]), r[2]) for r in self.coming.get()]
        passed, later = [x for x in rows if x[1] <= now], [x for x in rows if x[1] > now]
        # An earlier timer of this batch may have told all there is.
        if passed and later:
            self.coming.put(later)
            self.handle.registerTimer(min(t for _, t, _ in later))
        elif passed:
            self.coming.clear()
        yield _told(sorted(passed))

    def close(self) -> None:
        pass


def _told(rows: list[tuple[int, int, str]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({"vehicle_id": "int64", "time_ms": "int64", "kind": "object"})


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def vehicle_events(stops: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(vehicle_id, time_ms, kind) of a stream of planned stops (vehicle_id, arr_ms, dep_ms, ts): a row as its time comes.

    ts is the event time; a plan that comes after its own time is told at once, if it isn't later than the watermark allows.
    """
    timed = stops.withWatermark("ts", late).withColumn("fleet", F.floor(c("vehicle_id") / FLEET))
    return timed.groupBy("fleet").transformWithStateInPandas(VehicleClock(), "vehicle_id long, time_ms long, kind string", "append", "eventTime")


def told(stops: DataFrame, folder: str) -> None:
    """Runs a stream of planned stops over what has come since the last run, and adds its events to folder/events as Parquet.

    The state and what has been read stand in folder/state, so that a run goes on where the last one ended or broke off; a batch
    that is run again writes its files again.
    """
    spark = stops.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        run = vehicle_events(stops).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)


def with_lateness(rows: DataFrame, reached: int) -> DataFrame:
    """Rows (time_ms, ...) with ``late``: whether the clock had passed them as they came."""
    return rows.withColumn("late", c("time_ms") < F.lit(reached))


def split_late(stream: DataFrame, folder: str, allowed_ms: int, checkpoint: str) -> None:
    """Writes a stream's rows (time_ms, ...) batch by batch to folder/in_time and folder/late.

    A row is late if an earlier batch held one that is over ``allowed_ms`` newer. The clock is a table of one row a batch,
    so a restart goes on where it stood, and a batch that is run again writes the same rows.
    """
    spark = stream.sparkSession
    schema = "batch long, newest long"

    def write(batch: DataFrame, number: int) -> None:
        clock = spark.read.schema(schema).json(f"{folder}/clock") if number else spark.createDataFrame([], schema)
        before = clock.where(c("batch") < number).agg(F.max("newest")).first()[0]
        reached = -FAR if before is None else before - allowed_ms
        rows = with_lateness(batch, reached).persist()
        for name, keep in (("in_time", ~c("late")), ("late", c("late"))):
            rows.where(keep).drop("late").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        newest = rows.agg(F.max("time_ms")).first()[0]
        rows.unpersist()
        spark.createDataFrame([(number, newest)], schema).write.mode("overwrite").json(f"{folder}/clock/part={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replayed_stops(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals and departures of all planned stops, by a stream that is run anew as more comes and ends with the end of time."""
    folder = new_path(spark, "clock")
    plan = X.route_stops(spark, d).select("vehicle_id", (c("arr") * 100).alias("arr_ms"), (c("dep") * 100).alias("dep_ms"))
    plan = plan.withColumn("ts", F.timestamp_millis(F.lit(1)))  # the clock begins at 0
    end = spark.createDataFrame([(-1, FAR, FAR)], "vehicle_id long, arr_ms long, dep_ms long").withColumn("ts", F.timestamp_millis(F.lit(FAR - 1000)))
    # The first end moves the clock on, and the second gives it a batch in which timers fire.
    for k, rows in enumerate((plan, end, end)):
        rows.write.parquet(f"{folder}/in/part={k}")
        told(spark.readStream.schema(plan.schema).parquet(f"{folder}/in/part=*"), folder)
    return spark.read.schema("vehicle_id long, time_ms long, kind string").parquet(f"{folder}/events").where("vehicle_id >= 0").select("vehicle_id", "time_ms", "kind")


def late_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests in three batches, some of them a batch too late: (request_id, late)."""
    folder = new_path(spark, "late")
    rows = X.requests(spark, d).select("request_id", (c("request_time") * 100).alias("time_ms"))
    n = rows.agg(F.max("time_ms")).first()[0] or 0
    batch = F.least(F.floor(c("time_ms") * 3 / (n + 1)) + F.when(c("request_id") % 10 == 3, 1).otherwise(0), F.lit(2))
    for k in range(3):
        rows.where(batch == k).write.parquet(f"{folder}/in/part={k}")
        split_late(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/part=*"), folder, 60_000, f"{folder}/state")
    read = lambda name, late: spark.read.parquet(f"{folder}/{name}").select("request_id", F.lit(late).alias("late"))
    return read("in_time", False).unionByName(read("late", True))
