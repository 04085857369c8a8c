"""Searches that end when they have found enough."""

from pyspark.sql import functions as F

from shuttleframe.operators import graph
from shuttleframe.operators import sampling as A


def test_searches_end_when_done_and_lose_nothing(spark, monkeypatch):
    """A long way, one vertex far beyond all bounds, and a source that leads nowhere."""
    monkeypatch.setattr(A, "DOUBLED", 1)
    n = 90
    rows = [(k, k + 1, 5) for k in range(n)] + [(n, 1000, 100_000), (2000, 2001, 1)]
    edges = spark.createDataFrame(rows, "tail long, head long, travel_time long")
    edges = edges.withColumn("travel_time", F.when(F.col("tail") == n, F.col("travel_time")).otherwise(5))
    asked = spark.createDataFrame([(0,), (80,), (2001,)], "source long")
    searched = []
    monkeypatch.setattr(A, "distances", lambda e, seeds, bound: searched.append((bound, seeds.count())) or graph.distances(e, seeds, bound))
    monkeypatch.setattr(graph, "SENT_BOUNDED", 0)
    got = A.at_rank(A.until(edges, asked, A.more_than(11), 1), 11).collect()
    assert sorted(map(tuple, got)) == [(0, 11, 55), (80, 1000, 100_050)]
    assert [n for _, n in searched] == [3, 2, 2] and searched[-1][0] is None
