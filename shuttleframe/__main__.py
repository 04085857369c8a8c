"""Command line: runs a registered query, or replays requests against a fleet from files.

``python -m shuttleframe query NAME --tables DIR [--out PATH]`` writes a query's result as Parquet, or shows its first rows.
``python -m shuttleframe replay --network DIR --vehicles CSV --requests CSV --out BASE [--log NAME ...]`` writes named CSV logs.
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from .operators.cost import Config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shuttleframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    todo = top.add_subparsers(dest="todo", required=True)
    query = todo.add_parser("query", help="run a registered query")
    query.add_argument("name")
    query.add_argument("--tables", required=True, help="folder of the Parquet tables")
    query.add_argument("--out", help="folder for the result; without it, rows are shown")
    query.add_argument("--rows", type=int, default=20, help="rows to show")
    replay = todo.add_parser("replay", help="replay requests against a fleet")
    for name, what in (("network", "folder with vertices and edges"), ("vehicles", "CSV, either dialect"), ("requests", "CSV, either dialect"), ("out", "base name of the logs")):
        replay.add_argument(f"--{name}", required=True, help=what)
    replay.add_argument("--log", nargs="+", default=["quality", "legs", "chosen"], choices=["quality", "legs", "chosen", "events", "stops"])
    for f in fields(Config):
        replay.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    return top


def config(args: argparse.Namespace) -> Config:
    return Config(**{f.name: getattr(args, f.name) for f in fields(Config)})


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    from pyspark.sql import functions as F

    from . import catalog
    from .plans.simulation import simulate
    from .session import session
    from .sources import formats as IO

    spark = session()
    if args.todo == "query":
        found = catalog.queries()[args.name](spark, args.tables)
        found.write.mode("overwrite").parquet(args.out) if args.out else found.show(args.rows, truncate=False)
        return
    _, edges = IO.read_network(spark, args.network, ("travel_time",))
    vehicles, requests = IO.read_vehicles(spark, args.vehicles), IO.read_requests(spark, args.requests)
    for name in args.log:
        log = simulate(edges, vehicles, requests, config(args), name).drop("instance")
        lists = [n for n, t in log.dtypes if t.startswith("array")]
        IO.write_log(log.withColumns({n: F.array_join(n, " ") for n in lists}), args.out, name)


if __name__ == "__main__":
    main()
