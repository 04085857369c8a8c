"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import dispatch_queries, file_queries, fleet_queries, insertion_queries, instance_queries, location_queries, network_queries, update_queries

Query = Callable[[SparkSession, str], DataFrame]

#: The nearest idle vehicle of every request.
FLAGSHIP: Query = dispatch_queries.j23


def queries() -> dict[str, Query]:
    return network_queries.Q | location_queries.Q | dispatch_queries.Q | insertion_queries.Q | instance_queries.Q | file_queries.Q | fleet_queries.Q | update_queries.Q


def oracle_sql() -> dict[str, str]:
    return network_queries.SQL | location_queries.SQL | dispatch_queries.SQL | insertion_queries.SQL | instance_queries.SQL | file_queries.SQL | fleet_queries.SQL | update_queries.SQL
