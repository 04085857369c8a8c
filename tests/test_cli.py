"""The command line: typed and repeated values, and a replay from files to files."""

import pytest

from shuttleframe import __main__ as cli
from shuttleframe.operators.cost import Config
from shuttleframe.plans import fixtures as X
from shuttleframe.sources import formats as IO

D = "/root/testdata/sf0.001"


def test_values_are_typed():
    args = cli.parser().parse_args("replay --network n --vehicles v --requests r --out o --log legs stops --alpha 2.5 --stop-time 300 --walk 2".split())
    assert args.log == ["legs", "stops"] and cli.config(args) == Config(alpha=2.5, stop_time=300, walk=2)
    for bad in ("replay --network n", "query", "replay --network n --vehicles v --requests r --out o --log none", "replay --network n --vehicles v --requests r --out o --beta x"):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad.split())


def test_replay_from_files(spark, tmp_path):
    second = lambda rows, *names: rows.withColumns({n: (rows[n] / 10).cast("long") for n in names})
    IO.write_network(X.vertices(spark, D), X.edges(spark, D), str(tmp_path / "net"))
    IO.write_csv(second(X.vehicles(spark, D), "start_of_service_time", "end_of_service_time"), str(tmp_path / "v"), IO.VEHICLES)
    IO.write_csv(second(X.requests(spark, D).where("request_id < 40"), "request_time"), str(tmp_path / "r"), IO.REQUESTS)
    cli.main(f"replay --network {tmp_path}/net --vehicles {tmp_path}/v --requests {tmp_path}/r --out {tmp_path}/run --log quality stops".split())
    quality = spark.read.option("header", True).csv(f"{tmp_path}/run.quality.csv")
    stops = spark.read.option("header", True).csv(f"{tmp_path}/run.stops.csv")
    assert quality.count() > 0 and "trip_time" in quality.columns and stops.where("picked_up <> ''").count() > 0
