"""Streams that stop and go on: timers and state outlive the run."""

import pandas as pd
from pyspark.sql import functions as F

from shuttleframe.streaming import clock


def test_timers_outlive_a_restart(spark, tmp_path):
    """Plans come in one run, the clock reaches them in others; nothing is told twice or lost."""
    schema = "vehicle_id long, arr_ms long, dep_ms long"
    stream = lambda: spark.readStream.schema(f"{schema}, ts timestamp").parquet(f"{tmp_path}/in/part=*")

    def come(k, rows, at):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis(F.lit(at))).write.parquet(f"{tmp_path}/in/part={k}")
        clock.told(stream(), str(tmp_path))

    def told():
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/events").select("vehicle_id", "time_ms", "kind").where("vehicle_id >= 0").collect()))

    come(0, [(1, 5_000, 9_000), (1, 5_000, 9_000), (2, 100_000, 200_000)], 1)
    assert told() == []
    come(1, [(-1, 10**12, 10**12)], 50_000)
    come(2, [(-1, 10**12, 10**12)], 50_000)
    first = [(1, 5_000, "arrival"), (1, 5_000, "arrival"), (1, 9_000, "departure"), (1, 9_000, "departure")]
    assert told() == first
    come(3, [(3, 60_000, 150_000)], 55_000)
    come(4, [(-1, 10**12, 10**12)], 160_000)
    come(5, [(-1, 10**12, 10**12)], 160_000)
    assert told() == [*first, (2, 100_000, "arrival"), (3, 60_000, "arrival"), (3, 150_000, "departure")]


class Calls:
    """Stands for the handle, the list and the clock of a state, and counts what is asked of them."""

    def __init__(self):
        self.rows, self.timers, self.now = [], [], 0

    def getListState(self, *_):  # noqa: N802
        return self

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def get(self):
        return iter(list(self.rows))


def test_one_timer_tells_all_that_has_passed():
    """Vehicles side by side share a clock: one timer for a plan, and one call for all times that a batch has passed."""
    calls, clocks = Calls(), clock.VehicleClock()
    clocks.init(calls)
    plan = pd.DataFrame({"vehicle_id": [1, 2, 2], "arr_ms": [5, 7, 20], "dep_ms": [6, 9, 30]})
    assert [len(f) for f in clocks.handleInputRows((0,), iter([plan]), calls)] == [0]
    assert calls.timers == [5]
    calls.now = 10
    (first,) = clocks.handleExpiredTimer((0,), calls, None)
    assert list(map(tuple, first.to_numpy().tolist())) == [(1, 5, "arrival"), (1, 6, "departure"), (2, 7, "arrival"), (2, 9, "departure")]
    assert calls.timers == [5, 20] and calls.rows == [(2, 20, "arrival"), (2, 30, "departure")]
    (again,) = clocks.handleExpiredTimer((0,), calls, None)
    assert again.empty and calls.timers == [5, 20]
    calls.now = 30
    (last,) = clocks.handleExpiredTimer((0,), calls, None)
    assert len(last) == 2 and calls.rows == []
