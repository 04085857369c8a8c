"""The distance index against Floyd and Warshall, on random networks and cells of a few vertices."""

import random

import pytest
from pyspark.sql import functions as F

from shuttleframe.operators import buckets, dispatch, graph, hierarchy
from shuttleframe.plans import fixtures

from .test_graph import brute, network


@pytest.mark.parametrize("places", [False, True])
@pytest.mark.parametrize("leaf", [1, 1000])
def test_distances_equal_brute_force(spark, monkeypatch, leaf, places):
    monkeypatch.setattr(hierarchy, "LEAF", leaf)
    monkeypatch.setattr(hierarchy, "TOGETHER", 7)
    edges, rows = network(spark)
    d = brute(rows)
    r = random.Random(5)
    at = spark.createDataFrame([(v, r.randrange(9), r.randrange(9)) for v in range(50)], "vertex_id long, x long, y long") if places else None
    order = hierarchy.nested_order(edges, at)
    assert (order.levels > 1) == (leaf == 1)
    index = hierarchy.contracted(order, edges)
    pairs = [(a, b) for a in range(0, 60, 7) for b in range(0, 60, 3)] + [(0, 0), (0, 3), (0, 3), (999, 1), (1, 999), (999, 999)]
    far = lambda a, b: 0 if a == b else d[a][b] if max(a, b) < 60 else float("inf")
    want = sorted({(a, b, far(a, b)) for a, b in pairs if far(a, b) < float("inf")})
    asked = spark.createDataFrame(pairs, "source long, target long")
    assert sorted(map(tuple, hierarchy.distances_between(index, asked).collect())) == want
    sources, targets = ({p[i] for p in pairs} for i in (0, 1))
    got = hierarchy.distances_among(index, spark.createDataFrame([(s,) for s in sources], "source long"), spark.createDataFrame([(t,) for t in targets], "target long"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b, far(a, b)) for a in sources for b in targets if far(a, b) < float("inf"))


def test_another_weight_on_the_same_order(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "LEAF", 1)
    edges, rows = network(spark, seed=8)
    edges = edges.selectExpr("*", "if(edge_id % 9 = 0, null, edge_id * 7 % 11) length")
    order = hierarchy.nested_order(edges)
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(60)], "source long, target long")
    for weight, costs in (("travel_time", rows), ("length", [(k, t, h, k * 7 % 11) for k, t, h, _ in rows if k % 9])):
        d = brute(costs)
        got = hierarchy.distances_between(hierarchy.contracted(order, edges, weight), pairs).collect()
        assert {(r["source"], r["target"]): r["dist"] for r in got} == {(a, b): d[a][b] for a in range(60) for b in range(60) if d[a][b] < float("inf")}


def test_hubs_part_the_cells(spark, monkeypatch):
    """No edge joins two cells neither of which is above the other."""
    monkeypatch.setattr(hierarchy, "LEAF", 1)
    edges, rows = network(spark)
    home = {r["vertex_id"]: r["cell"] for r in hierarchy.nested_order(edges).vertices.collect()}
    for _, t, h, _ in rows:
        low, high = sorted((home[t], home[h]))
        while high > low:
            high >>= hierarchy.SPLITS
        assert low == high


def test_index_is_built_once(spark):
    edges, _ = network(spark)
    assert hierarchy.index_of(edges) is hierarchy.index_of(edges.select("*"))


def test_empty_network(spark):
    edges = spark.createDataFrame([], "edge_id long, tail long, head long, travel_time long")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "source long, target long")
    assert list(map(tuple, graph.pair_distances(edges, pairs).collect())) == [(1, 1, 0)]


def test_paths_of_legs_by_joins(spark, monkeypatch):
    """The same paths from a network that is sent and from one that isn't."""
    r = random.Random(2)
    rows = [(k, r.randrange(40), r.randrange(40), r.choice((3, 5, 5, 8))) for k in range(160)]
    edges = spark.createDataFrame(rows, "edge_id long, tail long, head long, travel_time long")
    legs = spark.createDataFrame([(i, r.randrange(40), r.randrange(40)) for i in range(30)] + [(99, 7, 7)], "leg long, from_vertex long, to_vertex long")
    sent = sorted(map(tuple, dispatch.leg_paths(edges, legs).collect()))
    monkeypatch.setattr(dispatch, "SENT_EDGES", 0)
    assert sorted(map(tuple, dispatch.leg_paths(edges, legs).collect())) == sent and len(sent) > 50


def test_buckets_after_changes_equal_new_ones(spark, monkeypatch):
    """Batches that move, take and add legs leave what a rebuild gives, and rewrite only the parts that they touch."""
    monkeypatch.setattr(hierarchy, "LEAF", 1)
    edges, _ = network(spark, seed=6)
    index = hierarchy.contracted(hierarchy.nested_order(edges), edges)
    r = random.Random(4)
    schema = "vehicle_id long, at long, stop_head long, next_tail long, leeway long"
    leg = lambda v, k: (v, k, r.randrange(60), r.randrange(60), r.randrange(25))
    now = {(v, k): leg(v, k) for v in range(12) for k in range(2)}
    made = lambda legs: spark.createDataFrame(sorted(legs), schema)
    table = buckets.Buckets.of(index, made(now.values()))
    for _ in range(3):
        gone = [now.pop(x) for x in r.sample(sorted(now), 6)]
        new = {x: leg(*x) for x in [*((g[0], g[1]) for g in gone[:4]), (100 + r.randrange(99), 0)]}
        table.change(made(gone), made(new.values()))
        now |= new
        want = sorted(map(tuple, buckets.entries(index, made(now.values())).collect()))
        got = table.rows(spark)
        assert sorted(map(tuple, got.select("hub", "onward", "vehicle_id", "at", "dist").collect())) == want and want
    table.change(made(now.values()), made([(1, 0, 999, 999, 5)]))
    assert table.rows(spark).isEmpty()


def test_large_networks_keep_no_labels(spark, monkeypatch):
    """Labels of all vertices take far more room than the network; beyond KEPT vertices only those asked for are made."""
    monkeypatch.setattr(hierarchy, "KEPT", 20)
    edges, rows = network(spark, seed=29)
    d = brute(rows)
    assert hierarchy.index_of(edges).labels is None
    pairs = [(a, b) for a in range(0, 60, 11) for b in range(0, 60, 7)]
    found = graph.pair_distances(edges, spark.createDataFrame(pairs, "source long, target long")).collect()
    assert {(r["source"], r["target"]): r["dist"] for r in found} == {(a, b): d[a][b] for a, b in pairs if d[a][b] < float("inf")}


def test_the_derived_network_is_as_large_as_it_is(spark):
    """Spark must not take the edges for a small table: what it does is sent whole by way of the driver."""
    edges = fixtures.edges(spark, "/root/testdata/sf0.01")
    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_size")
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size(edges) > 4 * size(parts)
    assert edges is fixtures.edges(spark, "/root/testdata/sf0.01")


def test_labels_are_made_once_for_each_vertex(spark, monkeypatch):
    """An index without all labels makes those that weren't asked for before, and others are as before."""
    monkeypatch.setattr(hierarchy, "LEAF", 1)
    edges, rows = network(spark, seed=31)
    d = brute(rows)
    index = hierarchy.contracted(hierarchy.nested_order(edges), edges)
    for pairs in ([(1, 2), (3, 999)], [(1, 2), (1, 4)], [(2, 1), (5, 5)], [(1, 4)]):
        found = hierarchy.distances_between(index, spark.createDataFrame(pairs, "source long, target long")).collect()
        assert {(r["source"], r["target"]): r["dist"] for r in found} == {(a, b): d[a][b] for a, b in pairs if b < 60 and d[a][b] < float("inf")}
    made = [(r["vertex_id"], r["back"]) for t in index.made for r in t.collect()]
    assert sorted(made) == sorted({(1, False), (2, True), (3, False), (999, True), (4, True), (2, False), (1, True), (5, False), (5, True)})


def test_pairs_dealt_by_a_number(spark, monkeypatch):
    """Pairs with one number meet in one task; a label goes where its pairs do, and nowhere else. Distances may need 64 bits."""
    monkeypatch.setattr(hierarchy, "LEAF", 1)
    edges, rows = network(spark, seed=32)
    edges = edges.withColumn("travel_time", F.col("travel_time") * (1 << 30))
    d = brute(rows)
    index = hierarchy.contracted(hierarchy.nested_order(edges), edges)
    pairs = [(a, b, a % 3) for a in range(0, 60, 5) for b in range(0, 60, 9)] + [(0, 9, 7)]
    found = hierarchy.distances_between(index, spark.createDataFrame(pairs, "source long, target long, part long")).collect()
    assert sorted((r["source"], r["target"], r["dist"]) for r in found) == sorted({(a, b, d[a][b] << 30) for a, b, _ in pairs if d[a][b] < float("inf")})


def test_a_field_gives_its_distances_some_sources_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "AT_ONCE", 3)
    edges, rows = network(spark, seed=33)
    d = brute(rows)
    index = hierarchy.contracted(hierarchy.nested_order(edges), edges)
    held = hierarchy.labels(index, spark.createDataFrame([(v, b) for v in range(10) for b in (False, True)], "vertex_id long, back boolean"))
    parts = list(hierarchy._all_met(iter([held.withColumn("most", F.lit(None).cast("double")).toPandas()])))
    assert max(p["source"].nunique() for p in parts) == 3
    assert {(s, t): x for p in parts for s, t, x in p.itertuples(index=False)} == {(a, b): d[a][b] for a in range(10) for b in range(10) if d[a][b] < float("inf")}


@pytest.mark.parametrize("shift", [0, 29])
def test_two_weights_meet_in_one_task(spark, monkeypatch, shift):
    """Both distances of all pairs in one row, of those that both weights connect, in 32 bits and in 64; and no join of results."""
    monkeypatch.setattr(hierarchy, "LEAF", 1)
    monkeypatch.setattr(hierarchy, "TOGETHER", 3)
    edges, rows = network(spark, seed=8)
    edges = edges.selectExpr("*", f"if(edge_id % 9 = 0, null, shiftleft(edge_id * 7 % 11, {shift})) length")
    order = hierarchy.nested_order(edges)
    both = [hierarchy.contracted(order, edges, w) for w in ("travel_time", "length")]
    a, b = brute(rows), brute([(k, t, h, (k * 7 % 11) << shift) for k, t, h, _ in rows if k % 9])
    all_ = spark.range(60).union(spark.createDataFrame([(999,)], "id long"))
    found = hierarchy.distances_by(both, all_.withColumnRenamed("id", "source"), all_.withColumnRenamed("id", "target"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(s, t, a[s][t], b[s][t]) for s in range(60) for t in range(60) if max(a[s][t], b[s][t]) < float("inf")] + [(999, 999, 0, 0)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_totals_from_sources(spark, monkeypatch):
    """What leaves a task is a row for each source, which may be outside the network."""
    monkeypatch.setattr(hierarchy, "LEAF", 1)
    edges, rows = network(spark, seed=34)
    d = brute(rows)
    index = hierarchy.contracted(hierarchy.nested_order(edges), edges)
    held = hierarchy.labels(index, spark.createDataFrame([(v, b) for v in range(20) for b in (False, True)], "vertex_id long, back boolean"))
    assert sum(map(len, hierarchy._totals(iter([held.toPandas()])))) == 20
    far = lambda v: [0] if v == 999 else [x for x in d[v] if x < float("inf")]
    asked = [0, 7, 7, 31, 59, 999]
    got = hierarchy.totals_from(index, spark.createDataFrame([(v,) for v in asked], "source long")).collect()
    assert sorted(map(tuple, got)) == [(v, len(far(v)), max(far(v)), sum(far(v))) for v in sorted(set(asked))]


def test_settled_before_targets(spark, monkeypatch):
    """Ties go by vertex; a target that isn't reached gives no rows, the source itself gives one at least."""
    monkeypatch.setattr(hierarchy, "LEAF", 1)
    edges, rows = network(spark, seed=35)
    d = brute(rows)
    index = hierarchy.contracted(hierarchy.nested_order(edges), edges)
    pairs = [(s, (s * 7 + 3) % 60) for s in range(0, 60, 4)] + [(1, 1), (5, 999), (999, 999)]
    got = hierarchy.settled_before(index, spark.createDataFrame(pairs, "source long, target long")).collect()
    want = [(s, t, v, d[s][v]) for s, t in pairs if max(s, t) < 60 and d[s][t] < float("inf") for v in range(60) if (d[s][v], v) <= (d[s][t], t)]
    assert sorted(map(tuple, got)) == sorted([*want, (999, 999, 999, 0)])


def test_search_space_of_vehicles_needs_no_search(spark, monkeypatch):
    """What is settled before vertex 0 comes from labels: no executor searches the whole network from a vehicle."""
    from shuttleframe import catalog
    from shuttleframe.operators import graph

    monkeypatch.setattr(graph, "csr", lambda *_: (_ for _ in ()).throw(AssertionError("searched")))
    assert catalog.queries()["s18_search_space"](spark, "/root/testdata/sf0.001").count() > 0


def test_pairs_meet_once_with_the_hubs_they_share(spark):
    """All sources and targets meet in one field each, where labels have no cells but those that are above both."""
    edges = spark.createDataFrame([(k, (k + d) % 1200, 1 + k % 7) for k in range(1200) for d in (1, 40)], "tail long, head long, travel_time long")
    index = hierarchy.contracted(hierarchy.nested_order(edges), edges)
    ends = spark.createDataFrame([(v, False) for v in range(0, 1200, 100)] + [(v, True) for v in range(0, 1200, 60)], "vertex_id long, back boolean")
    known = hierarchy.labels(index, ends).cache()
    a, b = hierarchy._fields(known, index.order.levels, {False: 12, True: 20}, 8)
    field = ["cell", "part", "i", "j"]
    met = a.toDF(*[x if x in field else f"a_{x}" for x in a.columns]).join(b.toDF(*[x if x in field else f"b_{x}" for x in b.columns]), field)
    assert met.count() == 240 == met.select("a_vertex_id", "b_vertex_id").distinct().count()
    assert index.order.levels > 0 and met.where("a_cells <> b_cells").count() == 0 and met.where("size(a_cells) = 1").count() > 100
