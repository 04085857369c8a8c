"""Road-network operators on (edge_id, tail, head, travel_time, ...) tables."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import crossings, great_circle, orientation, segments_meet
from ..storage import cut as _cut
from ..storage import new_path
from .hierarchy import bisections, distances_among, distances_between, index_of

c = F.col
#: Edges up to which a network is sent to every executor (24 bytes each) by way of the driver; beyond, searches go by blocks or joins of the
#: edge table, as bounded searches do beyond the second number.
SENT_EDGES, SENT_BOUNDED = 1_000_000, 20_000


_SENT: list[tuple[str, DataFrame, Broadcast]] = []


def csr(edges: DataFrame, weight: str = "travel_time", most: int | None = None) -> Broadcast | None:
    """(vertex ids, first, heads, weights) of a network of ``most`` (SENT_EDGES) edges at most, sent to the executors once for each plan of its
    edges, else None."""
    most = SENT_EDGES if most is None else min(most, SENT_EDGES)
    if most <= 0:
        return None
    app, plan = edges.sparkSession.sparkContext.applicationId, edges.select("tail", "head", c(weight).alias("w"))
    for known, arcs, sent in _SENT:
        if known == app and arcs.sameSemantics(plan):
            return sent
    if edges.count() > most:
        return None
    _SENT.append((app, plan, edges.sparkSession.sparkContext.broadcast(_arrays(edges, weight))))
    if len(_SENT) > 8:
        _SENT.pop(0)
    return _SENT[-1][2]


def _arrays(edges: DataFrame, weight: str) -> tuple[np.ndarray, ...]:
    p = edges.select("tail", "head", c(weight).alias("w")).where("w is not null").toPandas()
    ids = np.unique(np.concatenate((p["tail"], p["head"])))
    tail, head = np.searchsorted(ids, p["tail"]), np.searchsorted(ids, p["head"])
    order = np.argsort(tail, kind="stable")
    return ids, np.searchsorted(tail[order], np.arange(len(ids) + 1)), head[order], p["w"].to_numpy()[order]


def dijkstra(graph: tuple[np.ndarray, ...], seeds: list[tuple[int, int]], radius: int | None = None) -> dict[int, int]:
    """Distances from (vertex, offset) seeds, by vertex id, within the radius."""
    ids, first, heads, weights = graph
    queue = []
    for v, off in seeds:
        i = int(np.searchsorted(ids, v))
        if i < len(ids) and ids[i] == v:
            queue.append((off, i))
        elif radius is None or off <= radius:
            queue.append((off, -1 - v))
    heapq.heapify(queue)
    done: set[int] = set()
    out: dict[int, int] = {}
    while queue:
        d, i = heapq.heappop(queue)
        if i in done or (radius is not None and d > radius):
            continue
        done.add(i)
        out[int(ids[i]) if i >= 0 else -1 - i] = d
        if i < 0:
            continue
        for k in range(first[i], first[i + 1]):
            j = int(heads[k])
            if j not in done:
                heapq.heappush(queue, (d + int(weights[k]), j))
    return out


def distances(edges: DataFrame, seeds: DataFrame, radius: int | None = None, weight: str = "travel_time") -> DataFrame:
    """(source, vertex_id, dist) for seeds (source, vertex_id, dist): shortest paths, within the radius if there is one.

    A column ``radius`` of the seeds bounds each source on its own. Sources are independent, so each is searched on one
    executor over the network's arrays, sources side by side; a network that is too large to send is searched by blocks, round by
    round, until nothing changes.
    """
    sent = csr(edges, weight, None if radius is None and "radius" not in seeds.columns else SENT_BOUNDED)
    seeds = seeds.withColumn("radius", c("radius").cast("long") if "radius" in seeds.columns else F.lit(radius).cast("long"))
    if sent is None:
        return relaxed(edges, seeds, radius, weight)
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        most = None if rows["radius"].isna().any() else int(rows["radius"].max())
        found = dijkstra(sent.value, list(zip(rows["vertex_id"].tolist(), rows["dist"].tolist(), strict=True)), most)
        return pd.DataFrame({"source": rows["source"].iloc[0], "vertex_id": list(found), "dist": list(found.values())})

    return seeds.select("source", "vertex_id", "dist", "radius").groupBy("source").applyInPandas(search, "source long, vertex_id long, dist long")


def pair_distances(edges: DataFrame, pairs: DataFrame, weight: str = "travel_time") -> DataFrame:
    """(source, target, dist) for pairs (source, target) of vertices, by the network's index; pairs without a path have no row."""
    return distances_between(index_of(edges, weight), pairs)


#: Ids of vertices that a block of the network spans, and rows of a front that one task takes; ids that a block spans where a level has one search of it.
BLOCK, FRONT, LABELLED = 8_192, 4_096, 65_536
#: More than any distance: a source without a bound.
FAR = 1 << 62


def relaxed(edges: DataFrame, seeds: DataFrame, radius: int | None = None, weight: str = "travel_time") -> DataFrame:
    """``distances`` for networks of any size, by rounds of searches in blocks.

    A block is the edges whose tails lie in a range of BLOCK ids. Each round searches the blocks that the front has entered,
    side by side, and what leaves a block nearer than known before is the next front; so there are as many rounds as
    shortest paths go from block to block. Near ids for near vertices give few; any ids give right distances.
    """
    if "radius" not in seeds.columns:
        seeds = seeds.withColumn("radius", F.lit(radius).cast("long"))
    wide = BLOCK
    block = lambda v: F.floor(c(v) / wide)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _search_block(batches, wide)

    arcs = edges.select(c("tail").cast("long").alias("tail"), c("head").cast("long").alias("head"), c(weight).cast("long").alias("w")).where("w is not null")
    packed = _cut(arcs.withColumn("block", block("tail")).groupBy("block").applyInPandas(_packed, "block long, arcs binary"))
    most = seeds.groupBy("source").agg(F.when(F.max(c("radius").isNull()), F.lit(FAR)).otherwise(F.max("radius")).cast("long").alias("most"))
    start = seeds.groupBy("source", "vertex_id").agg(F.min("dist").cast("long").alias("dist")).join(most, "source").where("dist <= most")
    best, front = None, _cut(start.select(c("source").cast("long").alias("source"), c("vertex_id").cast("long").alias("vertex_id"), "dist", "most"))
    while best is None or not front.isEmpty():
        rows = front.withColumn("block", block("vertex_id"))
        sizes = _cut(rows.groupBy("block").agg(F.ceil(F.count("*") / FRONT).alias("chunks")))
        entered = rows.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("source"), c("chunks"))).drop("chunks")
        known = sizes.join(packed, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), c("chunks") - 1))).drop("chunks")
        known = known.select("*", *[F.lit(0).cast("long").alias(x) for x in ("source", "vertex_id", "dist", "most")])
        found = entered.withColumn("arcs", F.lit(None).cast("binary")).unionByName(known).groupBy("block", "chunk").applyInPandas(search, "source long, vertex_id long, dist long, most long, left boolean")
        new = found.groupBy("source", "vertex_id", "most").agg(F.min(F.struct("dist", "left")).alias("new"))
        if best is None:
            state = new.select("source", "vertex_id", "most", "new.dist", c("new.left").alias("moved"))
        else:
            both = best.select("source", "vertex_id", "most", c("dist").alias("old"), F.lit(None).cast(new.schema["new"].dataType).alias("new"))
            both = both.unionByName(new.withColumn("old", F.lit(None).cast("long"))).groupBy("source", "vertex_id", "most").agg(F.min("old").alias("old"), F.min("new").alias("new"))
            nearer = c("new").isNotNull() & (c("old").isNull() | (c("new.dist") < c("old")))
            state = both.select("source", "vertex_id", "most", F.least("old", "new.dist").alias("dist"), (nearer & c("new.left")).alias("moved"))
        best = _cut(state)
        front = best.where("moved").drop("moved")
    return best.select("source", "vertex_id", "dist")


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's edges as bytes: tails in order, heads, weights."""
    rows = rows.sort_values(["tail", "w"])
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "arcs": [rows[["tail", "head", "w"]].to_numpy(np.int64).T.tobytes()]})


def _search_block(batches: Iterator[pd.DataFrame], wide: int) -> Iterator[pd.DataFrame]:
    """Searches from all entries (source, vertex_id, dist, most) of a block along its edges, a search for each source. The row
    with ``arcs`` has these."""
    rows = pd.concat(list(batches), ignore_index=True)
    block, packed, rows = int(rows["block"].iloc[0]), rows["arcs"].dropna(), rows[rows["arcs"].isna()]
    tails, heads, weights = np.frombuffer(packed.iloc[0] if len(packed) else b"", np.int64).reshape(3, -1)
    ids = np.unique(tails)
    first = dict(zip(ids.tolist(), zip(np.searchsorted(tails, ids).tolist(), np.searchsorted(tails, ids, "right").tolist(), strict=True), strict=True))
    heads, weights, low, high = heads.tolist(), weights.tolist(), block * wide, (block + 1) * wide
    out: list[tuple[int, int, int, int, bool]] = []
    names = ["source", "vertex_id", "dist", "most", "left"]
    entries: dict[tuple[int, int], dict[int, int]] = {}
    for source, v, d, most in zip(*[rows[x].tolist() for x in names[:4]], strict=True):
        entries.setdefault((source, most), {})[v] = d
    for (source, most), best in entries.items():
        queue = [(d, v) for v, d in best.items()]
        heapq.heapify(queue)
        while queue:
            d, v = heapq.heappop(queue)
            if d > best[v]:
                continue
            a, b = first.get(v, (0, 0))
            for k in range(a, b):
                h, n = heads[k], d + weights[k]
                if n <= most and n < best.get(h, n + 1):
                    best[h] = n
                    if low <= h < high:
                        heapq.heappush(queue, (n, h))
        out += [(source, v, d, most, not low <= v < high) for v, d in best.items()]
        if len(out) > 100_000:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


def nearest_labels(edges: DataFrame, seeds: DataFrame, weight: str = "travel_time", wanted: DataFrame | None = None) -> DataFrame:
    """(level, vertex_id, dist, label): at every vertex the least (dist, label) over the seeds (level, vertex_id, dist, label) of a level.

    One search a level from all of its seeds at once, whatever their number; levels side by side. A network that is too large
    to send is searched by blocks, round by round, as far as shortest paths go from block to block; where vertices that are ``wanted``
    (vertex_id) are named, its index gives their distances instead, and other vertices may be missing: for few seeds.
    """
    sent = csr(edges, weight)
    if sent is None and wanted is not None:
        ways = distances_among(index_of(edges, weight), seeds.select(c("vertex_id").alias("source")), wanted.select(c("vertex_id").alias("target")))
        met = ways.withColumnRenamed("dist", "way").join(seeds.withColumnRenamed("vertex_id", "source"), "source")
        least = F.min(F.struct((c("dist") + c("way")).cast("long").alias("dist"), "label")).alias("m")
        return met.groupBy("level", c("target").alias("vertex_id")).agg(least).select("level", "vertex_id", "m.*")
    if sent is None:
        return _relaxed_labels(edges, seeds, weight)
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        ids, first, heads, weights = sent.value
        at = np.searchsorted(ids, rows["vertex_id"])
        known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == rows["vertex_id"])
        queue = list(zip(rows["dist"][known].tolist(), rows["label"][known].tolist(), at[known].tolist(), strict=True))
        heapq.heapify(queue)
        done: dict[int, tuple[int, int]] = {}
        while queue:
            d, label, i = heapq.heappop(queue)
            if i in done:
                continue
            done[i] = (d, label)
            for k in range(first[i], first[i + 1]):
                if (j := int(heads[k])) not in done:
                    heapq.heappush(queue, (d + int(weights[k]), label, j))
        out = [(int(ids[i]), *v) for i, v in done.items()]
        return pd.DataFrame(out, columns=["vertex_id", "dist", "label"]).assign(level=rows["level"].iloc[0])[["level", "vertex_id", "dist", "label"]]

    # One seed of a vertex can win.
    least = seeds.groupBy("level", "vertex_id").agg(F.min(F.struct("dist", "label")).alias("m")).select("level", "vertex_id", "m.*")
    return least.groupBy("level").applyInPandas(search, "level long, vertex_id long, dist long, label long")


def _relaxed_labels(edges: DataFrame, seeds: DataFrame, weight: str) -> DataFrame:
    """``nearest_labels`` by rounds of searches in blocks, as in ``relaxed``: a round searches the blocks of each level that the front has entered, from
    what has moved there and along what gets nearer, so there are as many rounds as shortest paths go from block to block."""
    wide = LABELLED
    block = lambda v: F.floor(c(v) / wide)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _label_block(pd.concat(list(batches), ignore_index=True), wide)

    arcs = edges.select(c("tail").cast("long").alias("tail"), c("head").cast("long").alias("head"), c(weight).cast("long").alias("w")).where("w is not null")
    packed = _cut(arcs.withColumn("block", block("tail")).groupBy("block").applyInPandas(_packed, "block long, arcs binary"))
    start = seeds.groupBy("level", "vertex_id").agg(F.min(F.struct(c("dist").cast("long").alias("dist"), c("label").cast("long").alias("label"))).alias("m"))
    best = _cut(start.select(c("level").cast("long").alias("level"), c("vertex_id").cast("long").alias("vertex_id"), "m.dist", "m.label", F.lit(True).alias("moved")))
    while not best.where("moved").isEmpty():
        rows = best.withColumn("block", block("vertex_id"))
        entered = _cut(rows.where("moved").select("level", "block").distinct())
        known = entered.join(packed, "block").select("level", "block", *[F.lit(None).cast(t).alias(n) for n, t in best.drop("level").dtypes], "arcs")
        there = rows.join(entered, ["level", "block"], "left_semi").withColumn("arcs", F.lit(None).cast("binary")).unionByName(known)
        found = there.groupBy("level", "block").applyInPandas(search, "level long, vertex_id long, dist long, label long, left boolean")
        new = found.select("level", "vertex_id", F.lit(None).cast("struct<dist: bigint, label: bigint>").alias("old"), F.struct("dist", "label", "left").alias("new"))
        old = best.select("level", "vertex_id", F.struct("dist", "label").alias("old"), F.lit(None).cast(new.schema["new"].dataType).alias("new"))
        both = old.unionByName(new).groupBy("level", "vertex_id").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        came = F.struct("new.dist", "new.label")
        nearer = c("new").isNotNull() & (c("old").isNull() | (came < c("old")))
        both = both.select("level", "vertex_id", F.when(nearer, came).otherwise(c("old")).alias("m"), (nearer & c("new.left")).alias("moved"))
        best = _cut(both.select("level", "vertex_id", "m.dist", "m.label", "moved"))
    return best.drop("moved")


def _label_block(rows: pd.DataFrame, wide: int) -> pd.DataFrame:
    """What gets a lesser (dist, label) by a search in one block of a level, from the rows that have ``moved``; other rows are known. The row
    with ``arcs`` has the edges."""
    level, block, packed, rows = int(rows["level"].iloc[0]), int(rows["block"].iloc[0]), rows["arcs"].dropna(), rows[rows["arcs"].isna()]
    tails, heads, weights = np.frombuffer(packed.iloc[0] if len(packed) else b"", np.int64).reshape(3, -1)
    ids = np.unique(tails)
    first = dict(zip(ids.tolist(), zip(np.searchsorted(tails, ids).tolist(), np.searchsorted(tails, ids, "right").tolist(), strict=True), strict=True))
    heads, weights, low, high = heads.tolist(), weights.tolist(), block * wide, (block + 1) * wide
    v, d, label = (rows[x].astype("int64").tolist() for x in ("vertex_id", "dist", "label"))
    best = dict(zip(v, zip(d, label, strict=True), strict=True))
    queue = [(*best[u], u) for u, moved in zip(v, rows["moved"].tolist(), strict=True) if moved]
    heapq.heapify(queue)
    nearer: set[int] = set()
    while queue:
        d, label, u = heapq.heappop(queue)
        if (d, label) > best[u]:
            continue
        a, b = first.get(u, (0, 0))
        for k in range(a, b):
            h, n = heads[k], (d + weights[k], label)
            if h not in best or n < best[h]:
                best[h] = n
                nearer.add(h)
                if low <= h < high:
                    heapq.heappush(queue, (*n, h))
    out = [(level, u, *best[u], not low <= u < high) for u in sorted(nearer)]
    return pd.DataFrame(out, columns=["level", "vertex_id", "dist", "label", "left"]).astype({"level": "int64", "vertex_id": "int64", "dist": "int64", "label": "int64", "left": "bool"})


def one_to_one(edges: DataFrame, source: int, target: int, weight: str = "travel_time") -> DataFrame:
    """(source, target, dist) of one pair by rounds of joins from both ends, for networks of any size; no row without a path.

    Each round relaxes the edges of the smaller front. A shorter path than the best one known would go through what neither
    side has relaxed yet, so the search ends when the two fronts' least distances add up to the best one, and vertices that can't lie on a
    shorter one aren't followed.
    """
    spark = edges.sparkSession
    arcs = _cut(edges.select("tail", "head", c(weight).cast("long").alias("w")).where("w is not null"))
    ways = [arcs.toDF("vertex_id", "to", "w"), arcs.toDF("to", "vertex_id", "w")]
    best = [spark.createDataFrame([(v, 0)], "vertex_id long, dist long") for v in (source, target)]
    front, size, least = list(best), [1, 1], [0, 0]
    most = 0 if source == target else None
    while min(size) > 0 and (most is None or sum(least) < most):
        k = int(size[1] < size[0])
        step = front[k].join(ways[k], "vertex_id").groupBy(c("to").alias("vertex_id")).agg(F.min(c("dist") + c("w")).alias("new"))
        moved = _cut(step.join(best[k], "vertex_id", "left").where("dist is null or new < dist").select("vertex_id", c("new").alias("dist")))
        met = moved.join(best[1 - k].withColumnRenamed("dist", "rest"), "vertex_id").agg(F.min(c("dist") + c("rest"))).first()[0]
        most = met if most is None or (met is not None and met < most) else most
        best[k] = _cut(best[k].unionByName(moved).groupBy("vertex_id").agg(F.min("dist").alias("dist")))
        front[k] = moved if most is None else moved.where(c("dist") + least[1 - k] < most)
        size[k], low = front[k].agg(F.count("*"), F.min("dist")).first()
        least[k] = low if low is not None else least[k]
    return spark.createDataFrame([] if most is None else [(source, target, most)], "source long, target long, dist long")


def many_to_many(edges: DataFrame, sources: DataFrame, targets: DataFrame, weight: str = "travel_time") -> DataFrame:
    """(source, target, dist) for every source (source) and target (target) that is reached, by the network's index."""
    return distances_among(index_of(edges, weight), sources.select("source").distinct(), targets.select("target").distinct())


def dijkstra_rank(found: DataFrame, area: DataFrame | None = None) -> DataFrame:
    """``found`` with ``rank``, the place by distance among the vertices of its source; only those of ``area`` (vertex_id) count."""
    found = found if area is None else found.join(area, "vertex_id", "left_semi")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("dist", "vertex_id")) - 1)


def topological(edges: DataFrame, seeds: DataFrame, weight: str = "travel_time") -> DataFrame:
    """(vertex_id, level, dist) of a network without cycles; ``seeds``: (vertex_id, dist).

    A vertex's level is the length of the longest chain of edges into it. Level by level, vertices that wait for no edge any
    more hand their distance on, a join and a minimum, and each edge is used once. ``dist`` is null where no seed leads.
    The edges are read once a level, so give a table. Parallel edges count one by one. Edges with a cycle raise ValueError. As many rounds as levels: for flat networks of any
    size; a deep one is searched better by ``distances``.
    """
    spark = edges.sparkSession
    arcs = edges.select(c("tail").cast("long"), c("head").cast("long"), c(weight).cast("long").alias("w"))
    least = seeds.groupBy(c("vertex_id").cast("long").alias("vertex_id")).agg(F.min("dist").cast("long").alias("dist"))
    ends = arcs.select(c("head").alias("vertex_id"), F.lit(1).alias("e")).unionByName(arcs.select(c("tail").alias("vertex_id"), F.lit(0).alias("e")))
    ends = ends.unionByName(least.select("vertex_id", F.lit(0).alias("e"))).groupBy("vertex_id").agg(F.sum("e").alias("waits"))
    rest, out, level = ends.join(least, "vertex_id", "left"), new_path(spark, "levels"), 0
    while True:
        # What is ready stays where it is written.
        rest.withColumn("ready", c("waits") == 0).write.partitionBy("ready").parquet(at := f"{out}/level={level}")
        rest = spark.read.schema("vertex_id long, waits long, dist long, ready boolean").parquet(at)
        ready = rest.where("ready").select("vertex_id", "dist")
        n_ready, n_rest = rest.agg(F.count_if(c("waits") == 0), F.count_if(c("waits") > 0)).first()
        if not n_rest:
            return spark.read.schema("vertex_id long, dist long, level int, ready boolean").parquet(out).where("ready").select("vertex_id", "level", "dist")
        if not n_ready:
            raise ValueError("the edges have a cycle")
        came = ready.join(arcs, c("vertex_id") == c("tail")).groupBy(c("head").alias("vertex_id")).agg(F.count("*").alias("n"), F.min(c("dist") + c("w")).alias("d"))
        waits = c("waits") - F.coalesce(c("n"), F.lit(0))
        rest = rest.where("not ready").join(came, "vertex_id", "left").select("vertex_id", waits.alias("waits"), F.least("dist", "d").alias("dist"))
        level += 1


def path(edges: DataFrame, source: int, target: int, weight: str = "travel_time") -> DataFrame:
    """(step, edge_id, dist at head) of a shortest path; of several next edges the smallest id. No rows if there is no path.

    Every vertex knows its next edge on the way to the target; jumps over 1, 2, 4, ... edges find the places of the path's
    edges in as many joins as the path's length has bits. A next edge goes nearer to the target, or, along edges of weight 0,
    to a vertex that is fewer edges away, so no path runs in a circle.
    """
    spark = edges.sparkSession
    both = edges.select("edge_id", "tail", "head", F.struct(c(weight), F.lit(1)).alias("w")).where(c(weight).isNotNull())
    # Distances with the number of edges as their last digits are unique in (weight, edges).
    n = edges.count() + 1
    fine = both.select("edge_id", "tail", "head", (c(f"w.{weight}") * n + 1).alias("fine"), c(f"w.{weight}").alias("plain"))
    dist = _cut(distances(reverse(fine.drop("plain")), spark.createDataFrame([(target, target, 0)], "source long, vertex_id long, dist long"), None, "fine").select("vertex_id", "dist"))
    tight = (
        fine.join(dist.select(c("vertex_id").alias("tail"), c("dist").alias("dt")), "tail")
        .join(dist.select(c("vertex_id").alias("head"), c("dist").alias("dh")), "head")
        .where(c("dt") == c("dh") + c("fine"))
    )
    step = _cut(tight.groupBy(c("tail").alias("v")).agg(F.min(F.struct("edge_id", c("head").alias("to"), "plain")).alias("m")).select("v", "m.*"))
    found = dist.where(c("vertex_id") == source).first()
    steps = int(found["dist"] % n) if found else 0
    at = _cut(spark.createDataFrame([(source, 0)], "v long, step long"))
    jump, length = step.select("v", "to"), 1
    while length < steps:
        twice = jump.join(jump.select(c("v").alias("to"), c("to").alias("far")), "to").select("v", c("far").alias("to"))
        ahead = at.join(jump, "v").select(c("to").alias("v"), (c("step") + length).alias("step"))
        at, jump, length = _cut(at.unionByName(ahead)), _cut(twice), 2 * length
    rows = at.where(c("step") < steps).join(step, "v")
    # The path is one row a step; its running sum stands in one task.
    return rows.select("step", "edge_id", F.sum("plain").over(Window.orderBy("step")).cast("long").alias("dist"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(vertex_id, scc): scc is the smallest vertex of the strongly connected component.

    A network that may be sent is searched on one executor (two depth-first passes). Larger ones go by forward colouring: the
    smallest vertex that reaches each vertex is its colour; within a colour, what reaches the root backwards is its component;
    the rest goes on. Each round settles a component of every colour, and vertices without edges in or out first.
    """
    arcs = edges.select("tail", "head").distinct()
    sent = csr(arcs.withColumn("w", F.lit(1)), "w")
    if sent is None:
        return _coloured(_cut(arcs))

    def search(_) -> pd.DataFrame:
        for _batch in _:
            ids, first, heads, _w = sent.value
            scc = _kosaraju(first, heads)
            least = np.full(len(ids), len(ids))
            np.minimum.at(least, scc, np.arange(len(ids)))
            yield pd.DataFrame({"vertex_id": ids, "scc": ids[least[scc]]})

    return edges.sparkSession.range(0, 1, 1, 1).mapInPandas(search, "vertex_id long, scc long")


def _kosaraju(first: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Component number of each vertex of a graph in arrays, without recursion."""
    n = len(first) - 1
    tails = np.repeat(np.arange(n), np.diff(first))
    by_head = np.argsort(heads, kind="stable")
    back_first, back = np.searchsorted(heads[by_head], np.arange(n + 1)).tolist(), tails[by_head].tolist()
    first, out, order, seen = first.tolist(), heads.tolist(), [], bytearray(n)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = 1
        stack = [(root, first[root])]
        while stack:
            v, k = stack.pop()
            while k < first[v + 1] and seen[out[k]]:
                k += 1
            if k == first[v + 1]:
                order.append(v)
                continue
            stack.append((v, k + 1))
            seen[out[k]] = 1
            stack.append((out[k], first[out[k]]))
    scc, number = [-1] * n, 0
    for root in reversed(order):
        if scc[root] >= 0:
            continue
        stack, scc[root] = [root], number
        while stack:
            v = stack.pop()
            for u in back[back_first[v] : back_first[v + 1]]:
                if scc[u] < 0:
                    scc[u] = number
                    stack.append(u)
        number += 1
    return np.array(scc, np.int64)


def _coloured(arcs: DataFrame) -> DataFrame:
    left = _cut(arcs.select(c("tail").alias("vertex_id")).union(arcs.select("head")).distinct())
    inner = lambda rows, keep: rows.join(keep.withColumnRenamed("vertex_id", "tail"), "tail", "left_semi").join(keep.withColumnRenamed("vertex_id", "head"), "head", "left_semi")
    done = None
    while not left.isEmpty():
        # What no edge enters or none leaves is a component by itself.
        while not (ends := _cut(left.join(arcs.select(c("tail").alias("vertex_id")), "vertex_id", "left_anti").union(left.join(arcs.select(c("head").alias("vertex_id")), "vertex_id", "left_anti")).distinct())).isEmpty():
            alone = ends.select("vertex_id", c("vertex_id").alias("scc"))
            done = alone if done is None else done.unionByName(alone)
            left = _cut(left.join(ends, "vertex_id", "left_anti"))
            arcs = _cut(inner(arcs, left))
        colour = _cut(left.withColumn("colour", c("vertex_id")))
        while True:
            step = colour.join(arcs, c("vertex_id") == c("tail")).groupBy(c("head").alias("vertex_id")).agg(F.min("colour").alias("new"))
            after = _cut(colour.join(step, "vertex_id", "left").select("vertex_id", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (c("new") < c("colour")).alias("moved")))
            colour, moved = after.drop("moved"), not after.where("moved").isEmpty()
            if not moved:
                break
        same = arcs.join(colour.select(c("vertex_id").alias("tail"), c("colour").alias("ct")), "tail").join(colour.select(c("vertex_id").alias("head"), c("colour").alias("ch")), "head").where("ct = ch")
        same = _cut(same.select("tail", "head"))
        reach = front = _cut(colour.where("vertex_id = colour"))
        while not front.isEmpty():
            step = front.join(same, c("vertex_id") == c("head")).select(c("tail").alias("vertex_id"), "colour").distinct()
            front = _cut(step.join(reach, "vertex_id", "left_anti"))
            reach = _cut(reach.unionByName(front))
        found = reach.select("vertex_id", c("colour").alias("scc"))
        done = found if done is None else done.unionByName(found)
        left = _cut(left.join(reach, "vertex_id", "left_anti"))
        arcs = _cut(inner(arcs, left))
    return done


def largest_component(edges: DataFrame) -> DataFrame:
    """Vertices of the largest strongly connected component, of equal ones that with the smallest vertex."""
    scc = strong_components(edges)
    top = scc.groupBy("scc").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "scc").limit(1)
    return scc.join(top, "scc").select("vertex_id")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place (from 0) in the order: ranges are sorted side by side and shifted by the ranges before."""
    ranged = _cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    shift = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(shift.drop("n")), "__part").withColumn(name, c("before") + c("__at") - c("first")).drop("__part", "__at", "before", "first")


def renumbering(vertices: DataFrame) -> DataFrame:
    return numbered(vertices.select("vertex_id"), ["vertex_id"], "new_id")


def permute(edges: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Edges between the vertices of ``new_ids``, renumbered; others go."""
    t = new_ids.select(c("vertex_id").alias("tail"), c("new_id").alias("new_tail"))
    h = new_ids.select(c("vertex_id").alias("head"), c("new_id").alias("new_head"))
    return edges.join(t, "tail").join(h, "head").drop("tail", "head").withColumnsRenamed({"new_tail": "tail", "new_head": "head"})


def subgraph(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return permute(edges, renumbering(vertices))


def reverse(edges: DataFrame) -> DataFrame:
    swap = {"tail": "head", "head": "tail"}
    return edges.select(*[c(x).alias(swap.get(x, x)) for x in edges.columns])


def degrees(edges: DataFrame) -> DataFrame:
    """Degree, first and last edge of each vertex, and how many of its edges are the only ones to their heads."""
    pairs = edges.groupBy("tail", "head").agg(F.count("*").alias("n"), F.min("edge_id").alias("lo"), F.max("edge_id").alias("hi"))
    return pairs.groupBy(c("tail").alias("vertex_id")).agg(
        F.sum("n").alias("degree"), F.min("lo").alias("first_edge"), F.max("hi").alias("last_edge"), F.count(F.when(c("n") == 1, 1)).alias("unique_edges")
    )


def insert(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new)


def remove(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, "edge_id", "left_anti")


def pair_networks(car: DataFrame, psg: DataFrame, car_vertices: DataFrame, psg_vertices: DataFrame) -> DataFrame:
    """(car_edge, psg_edge): edges (edge_id, way_id, tail, head) of the two networks' largest components that follow one way and end at
    one node. The node must lie at the same place in both (vertex_id, lat, lng); an error otherwise.

    A network has one edge a way and head at most; of several the least.
    """
    def links(edges: DataFrame, vertices: DataFrame, name: str) -> DataFrame:
        top = largest_component(edges)
        kept = edges.join(top.withColumnRenamed("vertex_id", "tail"), "tail", "left_semi").join(top.withColumnRenamed("vertex_id", "head"), "head", "left_semi")
        one = kept.groupBy("way_id", "head").agg(F.min("edge_id").alias(f"{name}_edge"))
        return one.join(vertices.select(c("vertex_id").alias("head"), c("lat").alias(f"{name}_lat"), c("lng").alias(f"{name}_lng")), "head")

    met = links(car, car_vertices, "car").join(links(psg, psg_vertices, "psg"), ["way_id", "head"])
    same = (c("car_lat") == c("psg_lat")) & (c("car_lng") == c("psg_lng"))
    bad = F.raise_error(F.concat(F.lit("heads of a way are at different places: "), c("way_id"))).cast("long")
    return met.select(F.when(same, c("car_edge")).otherwise(bad).alias("car_edge"), "psg_edge")


#: Vertices by whose places a tree of leaves is made, at most, and vertices that a leaf should have.
TREE_SAMPLE, TREE_LEAF = 200_000, 128


def nearest(points: DataFrame, vertices: DataFrame, within: float | None = None) -> DataFrame:
    """(id, vertex_id, d2): the vertex with the least squared distance in micro-degrees, ties by id; with ``within``, only vertices not
    farther by great circle, in metres.

    Vertices go to the leaves of a tree that halves a sample of them again and again. A point meets the vertices of the leaf
    that it comes to by the nearer box of two, and then those of other leaves whose boxes may hold a nearer one; both go down the tree, so
    a point sees few boxes, and one far from everything meets few leaves, too. The tree has as many leaves as the sample allows, and their boxes are what tasks know of all vertices.
    """
    n = vertices.count()
    share = min(1.0, TREE_SAMPLE / max(1, n))
    sample = vertices.where(F.pmod(F.xxhash64("vertex_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lat", "lng").toPandas().to_numpy(np.float64)
    depth = max(0, math.ceil(math.log2(max(1, min(n / TREE_LEAF, len(sample) / 8)))))
    side, bound = bisections(sample, depth)

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            node, xy = np.ones(len(f), np.int64), f[["lat", "lng"]].to_numpy()
            for _ in range(depth):
                node = 2 * node + (xy[np.arange(len(f)), side[node]] >= bound[node])
            yield f.assign(leaf=node)

    placed = _cut(vertices.select("vertex_id", c("lat").cast("long"), c("lng").cast("long")).mapInPandas(leaves, "vertex_id long, lat long, lng long, leaf long"))
    boxes = placed.groupBy("leaf").agg(F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng")).orderBy("leaf").toPandas().to_numpy(np.int64)

    # Boxes of all nodes of the tree, from the leaves up; an empty one is turned inside out.
    low = np.full((2 << depth, 2), np.iinfo(np.int64).max // 4)
    high = -low
    low[boxes[:, 0]], high[boxes[:, 0]] = boxes[:, [1, 3]], boxes[:, [2, 4]]
    for node in range((1 << depth) - 1, 0, -1):
        low[node], high[node] = np.minimum(low[2 * node], low[2 * node + 1]), np.maximum(high[2 * node], high[2 * node + 1])
    filled = low[:, 0] <= high[:, 0]

    def squared(xy: np.ndarray, node: np.ndarray) -> np.ndarray:
        """From points to boxes, one each; 0 within."""
        return (np.maximum(np.maximum(low[node] - xy, xy - high[node]), 0) ** 2).sum(1)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Down the tree by the nearer box that isn't empty."""
        for f in frames:
            xy, node = f[["lat", "lng"]].to_numpy(np.int64), np.ones(len(f) if len(boxes) else 0, np.int64)
            xy = xy[: len(node)]
            for _ in range(depth):
                left, right = 2 * node, 2 * node + 1
                turn = ~filled[left] | (filled[right] & (squared(xy, right) < squared(xy, left)))
                node = np.where(turn, right, left)
            yield f.iloc[: len(node)].assign(leaf=node)

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Down the tree by all boxes that may hold a nearer one."""
        for f in frames:
            for at in range(0, len(f), 4096):
                part = f.iloc[at : at + 4096]
                xy, d2 = part[["lat", "lng"]].to_numpy(np.int64), part["d2"].to_numpy()
                i, node = np.arange(len(part)), np.ones(len(part), np.int64)
                for _ in range(depth):
                    i, node = np.concatenate((i, i)), np.concatenate((2 * node, 2 * node + 1))
                    keep = np.flatnonzero(filled[node])
                    keep = keep[squared(xy[i[keep]], node[keep]) <= d2[i[keep]]]
                    i, node = i[keep], node[keep]
                keep = node != part["leaf"].to_numpy()[i]
                yield part[["id", "lat", "lng"]].iloc[i[keep]].assign(leaf=node[keep])

    there = placed.toDF("vertex_id", "v_lat", "v_lng", "leaf")
    d2 = (c("lat") - c("v_lat")) * (c("lat") - c("v_lat")) + (c("lng") - c("v_lng")) * (c("lng") - c("v_lng"))
    best = F.min(F.struct(d2.alias("d2"), "vertex_id", "v_lat", "v_lng")).alias("m")
    asked = points.select(c("id").cast("long"), c("lat").cast("long"), c("lng").cast("long")).distinct()
    found = asked.mapInPandas(first, "id long, lat long, lng long, leaf long").join(there, "leaf").groupBy("id", "lat", "lng", "leaf").agg(best)
    found = _cut(found.select("id", "lat", "lng", "leaf", "m.*"))
    more = found.select("id", "lat", "lng", "leaf", "d2").mapInPandas(others, "id long, lat long, lng long, leaf long").join(there, "leaf").groupBy("id", "lat", "lng").agg(best)
    every = found.select("id", "lat", "lng", F.struct("d2", "vertex_id", "v_lat", "v_lng").alias("m")).unionByName(more)
    out = every.groupBy("id", "lat", "lng").agg(F.min("m").alias("m"))
    if within is not None:
        out = out.where(great_circle(c("lat"), c("lng"), c("m.v_lat"), c("m.v_lng")) <= within)
    return out.select("id", "m.vertex_id", "m.d2")


#: Bands that faces are cut into by height.
BANDS = 256


def in_faces(points: DataFrame, faces: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, face, orient) of the faces that hold a point, by ray crossing.

    A ray crosses only sides in whose height the point lies, so points and sides meet by bands of height: an equi-join.
    """
    low, high = faces.agg(F.least(F.min("y1"), F.min("y2")), F.greatest(F.max("y1"), F.max("y2"))).first()
    if low is None:
        return points.select(key).join(faces.select("face", "orient"), F.lit(False))
    wide = max(1, -(-(high - low + 1) // BANDS))
    band = lambda v: F.floor((v - low) / wide)
    sides = faces.where("y1 <> y2").withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    hits = points.where(c(y).between(low, high)).select(key, c(x).alias("__x"), c(y).alias("__y")).withColumn("band", band(c("__y"))).join(sides, "band")
    n = F.sum(crossings(c("__x"), c("__y"), c("x1"), c("y1"), c("x2"), c("y2")))
    return hits.groupBy(key, "face", "orient").agg(n.alias("n")).where("n % 2 = 1").drop("n")


def simple_faces(sides: DataFrame) -> DataFrame:
    """(face, simple): whether a closed polygon (face, k, x1, y1, x2, y2) of three sides or more doesn't meet itself.

    Sides that follow each other may not fold back; others may not meet. Only sides in one band of height are compared.
    """
    n = F.count("*").over(Window.partitionBy("face"))
    low, high = sides.agg(F.least(F.min("y1"), F.min("y2")), F.greatest(F.max("y1"), F.max("y2"))).first()
    wide = 1 if low is None else max(1, -(-(high - low + 1) // BANDS))
    band = lambda v: F.floor((v - F.lit(low)) / wide)
    rows = sides.withColumn("n", n)
    cut = rows.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    a, b = (cut.select("face", "band", *[c(x).alias(f"{p}_{x}") for x in ("k", "n", "x1", "y1", "x2", "y2")]) for p in "ab")
    pairs = a.join(b, ["face", "band"]).where("a_k < b_k")

    def folds(p: str, q: str) -> Column:
        """The end of p is the start of q, and q goes back along p."""
        v = lambda s: c(s)
        level = orientation(v(f"{p}_x1"), v(f"{p}_y1"), v(f"{p}_x2"), v(f"{p}_y2"), v(f"{q}_x2"), v(f"{q}_y2")) == 0
        return level & ((v(f"{p}_x1") - v(f"{p}_x2")) * (v(f"{q}_x2") - v(f"{q}_x1")) + (v(f"{p}_y1") - v(f"{p}_y2")) * (v(f"{q}_y2") - v(f"{q}_y1")) > 0)

    meet = segments_meet(*[c(f"{p}_{x}") for p in "ab" for x in ("x1", "y1", "x2", "y2")])
    bad = F.when(c("b_k") == c("a_k") + 1, folds("a", "b")).when((c("a_k") == 0) & (c("b_k") == c("a_n") - 1), folds("b", "a")).otherwise(meet)
    crossed = pairs.where(bad).select("face").distinct().withColumn("crossed", F.lit(True))
    faces = rows.groupBy("face").agg(F.max("n").alias("n"))
    return faces.join(crossed, "face", "left").select("face", ((c("n") >= 3) & c("crossed").isNull()).alias("simple"))


def in_area(points: DataFrame, faces: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Keys of the points whose last containing face runs counterclockwise."""
    last = in_faces(points, faces, key, x, y).groupBy(key).agg(F.max_by("orient", "face").alias("o"))
    return last.where("o > 0").select(key)


def draw_times(rows: DataFrame, histogram: DataFrame) -> DataFrame:
    """(id, s): a second for each row, its bin by u modulo the histogram's total, ``inside`` within the bin of 300 s.

    A bin covers a range of u; ranges and rows meet by parts of the total, an equi-join, with two or three parts a bin.
    """
    bins = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("bin")))  # a histogram has as many rows as bins
    total, count = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    wide = max(1, total // max(1, count))
    part = lambda u: F.floor(u / wide)
    spread = bins.withColumn("part", F.explode(F.sequence(part(c("upto") - c("n")), part(c("upto") - 1))))
    drawn = rows.withColumn("u", c("u") % F.lit(max(1, total))).withColumn("part", part(c("u")))
    found = drawn.join(spread, "part").where((c("u") >= c("upto") - c("n")) & (c("u") < c("upto")))
    return found.select("id", (c("bin") * 300 + c("inside")).alias("s"))
