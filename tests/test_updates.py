"""Numbers of stops with reuse, and levels of networks without cycles, against plain implementations."""

import random

import pytest

from shuttleframe.operators import graph, updates

STOPS = "fleet string, stop long, entered long, left long"


def plain_ids(rows):
    """A stack of freed numbers for each fleet."""
    out = {}
    for fleet in {r[0] for r in rows}:
        moves = []
        for f, s, e, g in rows:
            if f == fleet and e is not None:
                moves.append((e, 0, s))
                if g is not None and g >= e:
                    moves.append((g, 1, s))
        free, count = [], 0
        for _, leaves, s in sorted(moves):
            if leaves:
                free.append(out[fleet, s])
            elif free:
                out[fleet, s] = free.pop()
            else:
                out[fleet, s], count = count, count + 1
    return out


def ids(spark, rows):
    got = updates.reused_ids(spark.createDataFrame(rows, STOPS)).collect()
    assert len(got) == len({(r["fleet"], r["stop"]) for r in got})
    return {(r["fleet"], r["stop"]): r["id"] for r in got}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reused_ids_equal_a_stack(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(1500):
        # Two thirds of the stops are of one fleet; ties in time, stops that never leave or enter, or leave before they enter.
        e = rng.choice([None, *[rng.randrange(3000) for _ in range(30)]])
        g = None if e is None or rng.random() < 0.05 else e + rng.choice([-4, 0, 1, 7, 40, 900])
        rows.append((rng.choice(["a", "a", "a", "a", "b", None]), s, e, g))
    assert ids(spark, rows) == plain_ids(rows)


def test_reused_ids_in_turn_and_at_once(spark):
    """One number for all, which is one long chain of pointers; all numbers freed before any is taken again."""
    turns = [("a", s, 2 * s, 2 * s + 1) for s in range(400)]
    assert set(ids(spark, turns).values()) == {0}
    once = [("a", s, s, 1000 + s) for s in range(300)] + [("a", 1000 + s, 5000 + s, None) for s in range(301)]
    got = ids(spark, once)
    assert got == plain_ids(once) and [got["a", 1000 + s] for s in (0, 299, 300)] == [299, 0, 300]
    assert ids(spark, []) == {}


EDGES = "tail long, head long, travel_time long"


def plain_levels(edges, seeds):
    level, dist = {}, {}
    for v in sorted({x for e in edges for x in e[:2]} | {v for v, _ in seeds}):
        into = [e for e in edges if e[1] == v]
        level[v] = max((level[t] + 1 for t, _, _ in into), default=0)
        ways = [d for x, d in seeds if x == v] + [dist[t] + w for t, _, w in into if dist[t] is not None]
        dist[v] = min(ways, default=None)
    return {v: (level[v], dist[v]) for v in level}


@pytest.mark.parametrize("seed", [1, 2])
def test_topological_equals_plain_order(spark, seed):
    rng = random.Random(seed)
    edges = []
    for v in range(0, 120):
        # Parallel edges, a vertex that a third of the edges lead to, edges within blocks of twelve ids.
        edges += [(v, rng.randrange(v + 1, v - v % 12 + 13), rng.randrange(50)) for _ in range(2)]
        edges.append((v, 1000, rng.randrange(9)))
    seeds = [(3, 5), (3, 9), (40, 0), (5000, 7)]
    got = graph.topological(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, "vertex_id long, dist long"))
    assert {r["vertex_id"]: (r["level"], r["dist"]) for r in got.collect()} == plain_levels(edges, seeds)


def test_topological_without_edges_and_with_a_cycle(spark):
    none = spark.createDataFrame([], "vertex_id long, dist long")
    assert graph.topological(spark.createDataFrame([], EDGES), none).count() == 0
    for ring in ([(1, 2, 1), (2, 3, 1), (3, 2, 1), (3, 4, 1)], [(1, 1, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            graph.topological(spark.createDataFrame(ring, EDGES), none)


def test_topological_writes_each_vertex_once_a_level(spark, monkeypatch):
    """Neither the edges nor what is ready are written a second time."""
    monkeypatch.setattr(graph, "_cut", None)
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 1), (1, 3, 9)], EDGES)
    got = graph.topological(edges, spark.createDataFrame([(1, 0)], "vertex_id long, dist long"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0), (2, 1, 5), (3, 2, 6)]
