"""Labels of pairs and dropoffs leave out insertions, and never the best of a kind."""

from pyspark.sql import functions as F

from shuttleframe.operators import graph
from shuttleframe.operators import cost as C
from shuttleframe.operators import dispatch as D
from shuttleframe.plans import insertion_queries as I

SF = "/root/testdata/sf0.001"


def test_labels_leave_the_best(spark):
    every, some = (I.candidates(spark, SF, False, x).cache() for x in (False, True))
    for kind in (D.AFTER_LAST, D.DROPOFF_AFTER_LAST):
        a, b = (x.where(F.col("kind") == kind) for x in (every, some))
        assert 0 < b.count() <= (a.count() / 2 if kind == D.AFTER_LAST else a.count())
        assert sorted(map(tuple, C.best(a).collect())) == sorted(map(tuple, C.best(b).collect()))
        assert b.select("request_id", "vehicle_id", "i", "p_id", "d_id").exceptAll(a.select("request_id", "vehicle_id", "i", "p_id", "d_id")).isEmpty()
    rest = ~F.col("kind").isin(D.AFTER_LAST, D.DROPOFF_AFTER_LAST)
    assert every.where(rest).count() == some.where(rest).count() > 0


def test_dropoffs_that_a_shorter_walk_beats(spark):
    """A line of edges both ways: the far dropoffs with long walks are worse than the destination, a pickup isn't what they lose to."""
    edges = [(2 * i, i, i + 1, 50) for i in range(9)] + [(2 * i + 1, i + 1, i, 50) for i in range(9)]
    edges = spark.createDataFrame(edges, "edge_id long, tail long, head long, travel_time long")
    schema = "request_id long, location long, walk long, pd_id long"
    drops = spark.createDataFrame([(1, 8, 0, 0), (1, 6, 400, 1), (1, 10, 90, 2), (2, 8, 0, 0), (2, 6, 400, 1)], schema)
    picks = spark.createDataFrame([(1, 0, 0, 0), (2, 8, 0, 0)], schema)
    got = {(r["request_id"], r["d_loc"]): r["d_worse"] for r in D.dropoff_labels(edges, picks, drops, C.Config()).collect()}
    assert got == {(1, 8): False, (1, 6): True, (1, 10): False, (2, 8): False, (2, 6): False}


def test_nearest_labels_of_wanted_vertices_take_no_rounds(spark, monkeypatch):
    """A network that is too large to send is asked by its index, whatever the number of edges on the way; the same labels as of a search."""
    rows = [(k, k, k + 1, 3 + k % 4) for k in range(70)] + [(100 + k, k + 1, k, 2 + k % 5) for k in range(70)]
    edges = spark.createDataFrame(rows, "edge_id long, tail long, head long, travel_time long")
    seeds = spark.createDataFrame([(1, 0, 5, 8), (1, 0, 5, 7), (1, 60, 40, 9), (2, 30, 0, 4), (2, 33, 9, 3)], "level long, vertex_id long, dist long, label long")
    wanted = spark.createDataFrame([(v,) for v in (0, 17, 31, 32, 32, 70, 500)], "vertex_id long")
    want = [tuple(r) for r in graph.nearest_labels(edges, seeds).join(wanted, "vertex_id", "left_semi").select("level", "vertex_id", "dist", "label").collect()]
    monkeypatch.setattr(graph, "SENT_EDGES", 0)
    monkeypatch.setattr(graph, "_relaxed_labels", None)
    got = graph.nearest_labels(edges, seeds, wanted=wanted)
    assert got.columns == ["level", "vertex_id", "dist", "label"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 10


def test_one_kind_alone(spark):
    """Insertions of one kind have the best one that all insertions have, and no other kind."""
    every = I.candidates(spark, SF).cache()
    for kind in (D.AFTER_LAST, D.DROPOFF_AFTER_LAST):
        got = I.candidates(spark, SF, labelled=True, kind=kind).cache()
        assert [r["kind"] for r in got.select("kind").distinct().collect()] == [kind]
        assert sorted(map(tuple, C.best(got).collect())) == sorted(map(tuple, C.best(every.where(F.col("kind") == kind)).collect()))


def test_growing_tables_are_not_sent(spark):
    """Ways of pairs are joined with the rows by a shuffle, whatever size Spark takes these tables for."""
    edges = spark.createDataFrame([(k, k, (k + 1) % 9, 3) for k in range(9)], "edge_id long, tail long, head long, travel_time long")
    rows = spark.createDataFrame([(1, 0, 3), (2, 4, 4)], "request_id long, a long, b long")
    got = D.location_ways(rows, edges, "a", "b", "way")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, 9), (2, 4, 4, 0)]
