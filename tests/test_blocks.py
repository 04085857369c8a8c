"""Searches in blocks of a network against brute force."""

import pytest

from shuttleframe.operators import graph

from .test_graph import brute, network


@pytest.mark.parametrize(("block", "front"), [(7, 2), (1, 4096), (8192, 4096)])
def test_blocks_of_any_size_give_all_distances(spark, monkeypatch, block, front):
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "FRONT", front)
    edges, rows = network(spark)
    d = brute(rows)
    asked = [(s, s, 0, r) for s, r in ((1, None), (2, 9), (3, 0), (5, 20), (99, 4))]
    got = {(r["source"], r["vertex_id"]): r["dist"] for r in graph.relaxed(edges, spark.createDataFrame(asked, "source long, vertex_id long, dist long, radius long")).collect()}
    want = {(s, v): d[s][v] for s, _, _, r in asked[:-1] for v in range(60) if d[s][v] < float("inf") and (r is None or d[s][v] <= r)}
    assert got == want | {(99, 99): 0}
