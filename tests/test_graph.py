"""Searches against brute force, within and beyond the size of a network that is sent to the executors."""

import pytest

from shuttleframe.operators import graph


def test_edges_without_a_weight_lead_nowhere(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1, 5), (1, 2, None), (2, 3, 4), (0, 3, 9)], "tail long, head long, travel_time long")
    seeds = spark.createDataFrame([(0, 0, 0)], "source long, vertex_id long, dist long")
    sent = sorted(map(tuple, graph.distances(edges, seeds).collect()))
    monkeypatch.setattr(graph, "SENT_EDGES", 0)
    assert sorted(map(tuple, graph.distances(edges, seeds).collect()), key=str) == sent == [(0, 0, 0), (0, 1, 5), (0, 3, 9)]


def network(spark, n=60, seed=3):
    import random

    r = random.Random(seed)
    rows = [(k, r.randrange(n), r.randrange(n), r.choice((0, 3, 5, 5, 8))) for k in range(2 * n)]
    return spark.createDataFrame(rows, "edge_id long, tail long, head long, travel_time long"), rows


def brute(rows, n=60):
    """All distances by Floyd and Warshall."""
    inf = float("inf")
    d = [[0 if i == j else inf for j in range(n)] for i in range(n)]
    for _, t, h, w in rows:
        d[t][h] = min(d[t][h], w)
    for k in range(n):
        for i in range(n):
            for j in range(n):
                d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_searches_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(graph, "SENT_EDGES", sent)
    edges, rows = network(spark)
    d, inf = brute(rows), float("inf")
    seeds = spark.createDataFrame([(s, s, 0, r) for s, r in ((1, None), (2, 9), (3, 0))], "source long, vertex_id long, dist long, radius long")
    got = {(r["source"], r["vertex_id"]): r["dist"] for r in graph.distances(edges, seeds).collect()}
    assert got == {(s, v): d[s][v] for s, m in ((1, inf), (2, 9), (3, 0)) for v in range(60) if d[s][v] <= m and d[s][v] < inf}
    pairs = [(a, b) for a in range(0, 60, 7) for b in range(0, 60, 3)]
    found = graph.pair_distances(edges, spark.createDataFrame(pairs, "source long, target long")).collect()
    assert {(r["source"], r["target"]): r["dist"] for r in found} == {(a, b): d[a][b] for a, b in pairs if d[a][b] < inf}
    labelled = [(lv, v, off, 100 + v) for lv in (1, 2) for v, off in ((4, 0), (9, 2), (33, 0)) if lv == 1 or v != 4]
    near = graph.nearest_labels(edges, spark.createDataFrame(labelled, "level long, vertex_id long, dist long, label long")).collect()
    want = {}
    for lv, v, off, label in labelled:
        for x in range(60):
            if d[v][x] < inf:
                want[lv, x] = min(want.get((lv, x), (inf, 0)), (off + d[v][x], label))
    assert {(r["level"], r["vertex_id"]): (r["dist"], r["label"]) for r in near} == want


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_components_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(graph, "SENT_EDGES", sent)
    for seed in (3, 4):
        edges, rows = network(spark, seed=seed)
        d = brute(rows)
        touched = {v for _, t, h, _ in rows for v in (t, h)}
        got = {r["vertex_id"]: r["scc"] for r in graph.strong_components(edges).collect()}
        assert got == {v: min(u for u in touched if d[u][v] < float("inf") and d[v][u] < float("inf")) for v in touched}


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_paths_are_shortest(spark, monkeypatch, sent):
    monkeypatch.setattr(graph, "SENT_EDGES", sent)
    edges, rows = network(spark)
    d, by_id = brute(rows), {k: (t, h, w) for k, t, h, w in rows}
    for a, b in ((1, 2), (5, 40), (7, 7), (3, 11)):
        steps = sorted(map(tuple, graph.path(edges, a, b).collect()))
        if d[a][b] == float("inf") or a == b:
            assert steps == []
            continue
        at, total = a, 0
        for i, (step, e, dist) in enumerate(steps):
            t, h, w = by_id[e]
            total += w
            assert (step, t, dist) == (i, at, total)
            at = h
        assert at == b and total == d[a][b]


def test_both_ends_meet_at_the_shortest(spark):
    edges, rows = network(spark, seed=11)
    d = brute(rows)
    for a, b in ((1, 2), (5, 40), (7, 7), (3, 11), (30, 8)):
        assert [tuple(r) for r in graph.one_to_one(edges, a, b).collect()] == ([(a, b, d[a][b])] if d[a][b] < float("inf") else [])


@pytest.mark.parametrize("leaf", [3, 1000])
def test_every_point_has_a_nearest_vertex(spark, monkeypatch, leaf):
    """Points amid the vertices, between them at ties, and far from all, on a tree of many leaves and of one."""
    monkeypatch.setattr(graph, "TREE_LEAF", leaf)
    vertices = [(i, 10 * (i % 7), 13 * (i // 7)) for i in range(60)] + [(100, 4000, -9000), (101, 4000, -9000)]
    points = [(1, 0, 0), (2, 33, 41), (3, 10**9, -(10**9)), (4, -5000, 77), (5, 3900, -9100), (6, 5, 6), (6, 5, 6)] + [(10 + i, i * 7 % 80, i * 11 % 140) for i in range(40)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = made(points, "id long, lat long, lng long"), made(vertices, "vertex_id long, lat long, lng long")
    best = lambda p: min(((p[1] - y) ** 2 + (p[2] - x) ** 2, v) for v, y, x in vertices)
    got = graph.nearest(*tables).collect()
    assert {r["id"]: (r["d2"], r["vertex_id"]) for r in got} == {p[0]: best(p) for p in points} and len(got) == len({p[0] for p in points})
    assert {r["id"] for r in graph.nearest(*tables, within=20.0).collect()} == {p[0] for p in points} - {3, 4}
    assert graph.nearest(tables[0], tables[1].limit(0)).count() == graph.nearest(tables[0].limit(0), tables[1]).count() == 0


def test_points_go_down_a_deep_tree(spark, monkeypatch):
    """With leaves of one vertex, some of them empty."""
    monkeypatch.setattr(graph, "TREE_LEAF", 1)
    points = spark.createDataFrame([(i, i * 37 % 900, i * 53 % 900) for i in range(50)], "id long, lat long, lng long")
    vertices = [(i, i * 71 % 997, i * 29 % 991) for i in range(400)]
    got = {r["id"]: (r["d2"], r["vertex_id"]) for r in graph.nearest(points, spark.createDataFrame(vertices, "vertex_id long, lat long, lng long")).collect()}
    assert got == {i: min(((i * 37 % 900 - y) ** 2 + (i * 53 % 900 - x) ** 2, v) for v, y, x in vertices) for i in range(50)}


def test_labels_take_rounds_by_blocks_not_by_edges(spark, monkeypatch):
    """A line of 70 edges in five blocks takes some rounds, not seventy; the same labels as of a search."""
    rows = [(k, k, k + 1, 3 + k % 4) for k in range(70)] + [(100 + k, k + 1, k, 2 + k % 5) for k in range(70)]
    edges = spark.createDataFrame(rows, "edge_id long, tail long, head long, travel_time long")
    seeds = spark.createDataFrame([(1, 0, 5, 8), (1, 0, 5, 7), (1, 60, 40, 9), (2, 30, 0, 4), (2, 33, 9, 3), (2, 500, 1, 6)], "level long, vertex_id long, dist long, label long")
    want = sorted(map(tuple, graph.nearest_labels(edges, seeds).where("vertex_id < 500").collect()))
    tables, cut = [], graph._cut
    monkeypatch.setattr(graph, "SENT_EDGES", 0)
    monkeypatch.setattr(graph, "LABELLED", 16, raising=False)
    monkeypatch.setattr(graph, "_cut", lambda df: tables.append(1) or cut(df))
    got = sorted(map(tuple, graph.nearest_labels(edges, seeds).where("vertex_id < 500").collect()))
    assert got == want and len(want) == 142
    assert len(tables) < 20
