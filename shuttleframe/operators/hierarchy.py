"""Distance index of a road network: a hierarchy of cells that are contracted side by side, and labels of distances to their hubs.

An order splits the vertices into nested cells. A vertex with an edge into another part of a cell is one of that cell's hubs, and
what is left after the hubs of all cells above a leaf is the leaf's own, which are its hubs, too. So two parts of a cell meet in
hubs of that cell or of cells above it alone. The order hangs on the network's shape and serves any weight.

For a weight, cells are contracted from the leaves up, all cells of a level side by side: the distances through a cell's hubs
and what lies below them become shortcuts between the hubs above, which the parent cell takes. A vertex's label holds its distance
to every hub of its own cell and of all cells above, by ways that stay below that hub's cell; a shortest path has its
topmost hubs in one of them. So a distance is a join of two labels and a minimum, without a search, and no task sees more of the
network than one cell's hubs and borders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, growing

c = F.col
#: Bisections between a cell and its parts, and the vertices that a leaf should have.
SPLITS, LEAF = 2, 128
#: Vertices by whose places cells are split, at most; each leaf has eight of them at least. They decide how even the cells are.
SAMPLE = 200_000
#: Labels of a side that meet in one task (four times as many where all of them do), labels that one task makes, and rows of them at a time, so that these stay in a cache.
TOGETHER, MADE, AT_ONCE = 4_000, 2_000, 128
INF = np.int64(1 << 61)
#: What stands for INF in labels whose distances take 32 bits.
NEAR = np.int64((1 << 31) - 1)
#: What stands for INF where sums of two distances take 32 bits, each being less than SHORT.
FAR32, SHORT = np.int32((1 << 30) - 1), 1 << 29
#: Levels of cells above the leaves whose vertices' labels one task makes, and levels of cells by which all sources and targets are dealt to fields.
ALONE, APART = 3, 2
#: Columns whose least sums are taken at a time, so that these stay in a cache.
COLUMNS = 1_024
#: Vertices up to which an index keeps the labels of all; beyond, labels of those that are asked for are made each time.
KEPT = 50_000


@dataclass(frozen=True)
class Order:
    """(vertex_id, cell): the cell whose hub each vertex is. The root is cell 1, the parts of cell x are 8 x to 8 x + 7."""

    vertices: DataFrame
    levels: int


@dataclass(frozen=True)
class Index:
    """(cell, level, own, wide, kids, at, out, into): a cell's hubs, and distances from and to them within it; the ``wide`` columns of the matrices are
    its hubs and then the border, the hubs above that what is below reaches. ``at`` has the places of each kid's border in them."""

    order: Order
    cells: DataFrame
    #: Labels of all vertices, if they are kept; else those that are asked for are made, once for each vertex.
    labels: DataFrame | None = None
    made: list[DataFrame] = field(default_factory=list, compare=False)


def _level(cell: Column) -> Column:
    return ((F.length(F.bin(cell)) - 1) / SPLITS).cast("int")


def _above(cell: Column, levels: Column | int) -> Column:
    """The cell that many levels above."""
    return F.shiftright(cell, SPLITS * levels) if isinstance(levels, int) else F.floor(cell / F.pow(F.lit(2.0), SPLITS * levels)).cast("long")


def bisections(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and bound of each node of a tree that halves the points along the wider side, nodes numbered from 1 on."""
    side, bound = np.zeros(1 << depth, np.int8), np.zeros(1 << depth)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        points = parts.pop(node)
        if len(points):
            side[node] = int(np.argmax(points.max(0) - points.min(0)))
            bound[node] = np.median(points[:, side[node]])
        right = points[:, side[node]] >= bound[node] if len(points) else np.zeros(0, bool)
        parts[2 * node], parts[2 * node + 1] = points[~right], points[right]
    return side, bound


def nested_order(edges: DataFrame, places: DataFrame | None = None) -> Order:
    """Order of a network (tail, head) by the vertices' places (vertex_id, x, y); without places, by their ids.

    Vertices without a place stand at 0, 0. Any places give right distances; near ones for near vertices give few hubs.
    """
    arcs = edges.select(c("tail").cast("long").alias("tail"), c("head").cast("long").alias("head")).where("tail is not null and head is not null")
    ids = arcs.select(c("tail").alias("vertex_id")).union(arcs.select("head")).distinct()
    if places is None:
        points = ids.select("vertex_id", c("vertex_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    else:
        one = places.groupBy("vertex_id").agg(F.max(F.struct(c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))).alias("m")).select("vertex_id", "m.*")
        points = ids.join(one, "vertex_id", "left").fillna(0.0, ["x", "y"])
    points = cut(points)
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    taken = points.where(F.pmod(F.xxhash64("vertex_id"), F.lit(1 << 30)) < share * (1 << 30)).select("x", "y").toPandas().to_numpy()
    wanted = round(math.log2(max(1, n / LEAF)) / SPLITS)
    levels = max(0, min(wanted, int(math.log2(max(1, len(taken) / 8)) / SPLITS) if share < 1 else wanted))
    side, bound = bisections(taken, SPLITS * levels)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xy, node = f[["x", "y"]].to_numpy(), np.ones(len(f), np.int64)
            for _ in range(SPLITS * levels):
                node = 2 * node + (xy[np.arange(len(f)), side[node]] >= bound[node])
            yield pd.DataFrame({"vertex_id": f["vertex_id"], "node": node})

    nodes = cut(points.mapInPandas(place, "vertex_id long, node long"))
    met = arcs.join(growing(nodes.withColumnsRenamed({"vertex_id": "tail", "node": "a"})), "tail").join(growing(nodes.withColumnsRenamed({"vertex_id": "head", "node": "b"})), "head").where("a <> b")
    # The bits above the first that differs name the cell that has both ends; the end in its lower part is a hub of it.
    shared = F.floor((SPLITS * levels - F.length(F.bin(c("a").bitwiseXOR(c("b"))))) / SPLITS).cast("int")
    hubs = met.select(F.when(c("a") < c("b"), c("tail")).otherwise(c("head")).alias("vertex_id"), shared.alias("shared")).groupBy("vertex_id").agg(F.min("shared").alias("home"))
    homes = nodes.join(growing(hubs), "vertex_id", "left").withColumn("up", levels - F.coalesce("home", F.lit(levels)))
    return Order(cut(homes.select("vertex_id", _above(c("node"), c("up")).alias("cell"))), levels)


def _stored(far: np.ndarray) -> bytes:
    """Distances in 32 bits each, or in 64 where one needs them."""
    none = far >= INF
    return np.where(none, NEAR, far).astype(np.int32).tobytes() if (none | (far < NEAR)).all() else far.tobytes()


def _distances(far: bytes, n: int) -> np.ndarray:
    """``n`` distances that were stored."""
    if len(far) == 8 * n:
        return np.frombuffer(far, np.int64)
    found = np.frombuffer(far, np.int32).astype(np.int64)
    found[found == NEAR] = INF
    return found


def _matrix(data: bytes, *shape: int) -> np.ndarray:
    return _distances(data, math.prod(shape)).reshape(shape)


def _contract(rows: pd.DataFrame) -> pd.DataFrame:
    """One cell: its edges and the borders of its kids, closed over its hubs."""
    arcs, kids = rows[rows["kid"].isna()], rows[rows["kid"].notna()]
    tail, head, w = (arcs[x].to_numpy(np.int64) for x in ("tail", "head", "w"))
    own = np.unique(tail[tail == head])
    borders = [np.asarray(b, np.int64) for b in kids["border"]]
    border = np.setdiff1d(np.concatenate((tail, head, *borders)), own)
    names = np.concatenate((own, border))
    order = np.argsort(names)
    place = lambda v: order[np.searchsorted(names, v, sorter=order)]
    n, k = len(names), len(own)
    m = np.full((n, n), INF)
    np.minimum.at(m, (place(tail), place(head)), w)
    at = [place(b) for b in borders]
    for p, data in zip(at, kids["closed"], strict=True):
        block = np.ix_(p, p)
        m[block] = np.minimum(m[block], _matrix(data, len(p), len(p)))
    m[np.arange(n), np.arange(n)] = 0
    for j in range(k):
        into, out = np.flatnonzero(m[:, j] < INF), np.flatnonzero(m[j] < INF)
        if len(into) * len(out) * 4 < n * n:
            block = np.ix_(into, out)
            m[block] = np.minimum(m[block], m[into, j][:, None] + m[j, out])
        else:
            np.minimum(m, m[:, j : j + 1] + m[j : j + 1], out=m)
    np.minimum(m, INF, out=m)
    return pd.DataFrame(
        {
            "cell": [rows["cell"].iloc[0]], "own": [own], "border": [border], "closed": [_stored(m[k:, k:])], "kids": [kids["kid"].to_numpy(np.int64)],
            "at": [[p.astype(np.int32) for p in at]], "out": [_stored(m[:k])], "into": [_stored(m[:, :k].T)],
        }
    )


CELL = "cell long, own array<long>, border array<long>, closed binary, kids array<long>, at array<array<int>>, out binary, into binary"


def contracted(order: Order, edges: DataFrame, weight: str = "travel_time") -> Index:
    """The index of a weight on an order; edges without a weight don't count, of parallel ones the least does."""
    arcs = edges.select(c("tail").cast("long").alias("tail"), c("head").cast("long").alias("head"), c(weight).cast("long").alias("w")).where("w is not null and tail <> head")
    arcs = arcs.groupBy("tail", "head").agg(F.min("w").alias("w"))
    home = order.vertices
    # An edge belongs to the deeper of its ends' cells, which has the other one above it; each vertex to its own.
    arcs = arcs.join(growing(home.withColumnsRenamed({"vertex_id": "tail", "cell": "a"})), "tail").join(growing(home.withColumnsRenamed({"vertex_id": "head", "cell": "b"})), "head")
    own = home.select("cell", c("vertex_id").alias("tail"), c("vertex_id").alias("head"), F.lit(0).cast("long").alias("w"))
    arcs = arcs.select(F.greatest("a", "b").alias("cell"), "tail", "head", "w").union(own)
    none = {"kid": "long", "border": "array<long>", "closed": "binary"}
    arcs = cut(arcs.withColumn("level", _level(c("cell"))))
    cells, below = None, None
    for level in range(order.levels, -1, -1):
        rows = arcs.where(c("level") == level).drop("level").select("*", *[F.lit(None).cast(t).alias(x) for x, t in none.items()])
        if below is not None:
            up = below.select(_above(c("cell"), 1).alias("cell"), *[F.lit(None).cast("long").alias(x) for x in ("tail", "head", "w")], c("cell").alias("kid"), "border", "closed")
            rows = rows.unionByName(up)
        below = cut(rows.groupBy("cell").applyInPandas(_contract, CELL))
        done = below.select("cell", F.lit(level).alias("level"), "own", (F.size("own") + F.size("border")).alias("wide"), "kids", "at", "out", "into")
        cells = done if cells is None else cells.union(done)
    return Index(order, cells)


def labels(index: Index, vertices: DataFrame) -> DataFrame:
    """(vertex_id, back, cells, sizes, far) of vertices (vertex_id, back): the cells from the root down to its own, how many hubs each
    has, and the distances to all these hubs, or from them with ``back``. A vertex that isn't in the network has no cells.

    Cell by cell upwards, the distances to a cell's border, which are the way to all hubs above, meet the parent's matrix. The vertices of
    a cell ALONE levels above the leaves are one task's, which gets all cells below that one and those above it, so that no label goes from task to task as it grows.
    """
    asked = cut(vertices.distinct().join(growing(index.order.vertices), "vertex_id", "left").withColumn("level", _level(c("cell"))))
    deep = max(0, index.order.levels - ALONE)
    # A hub of a cell above goes with any of the cells below it.
    lower = F.pow(F.lit(2.0), SPLITS * F.greatest(F.lit(deep) - c("level"), F.lit(0))).cast("long")
    part = _above(c("cell"), F.greatest(c("level") - deep, F.lit(0))) * lower + F.pmod(F.xxhash64("vertex_id"), lower)
    rows = asked.where("cell is not null").select("vertex_id", "back", "cell", part.alias("part"))
    homes = rows.select("part", "back", "cell").distinct()
    used = cut(homes.select("part", c("back").alias("into_it"), F.explode(F.transform(F.sequence(F.lit(0), _level(c("cell"))), lambda k: _above(c("cell"), k))).alias("cell")).distinct())
    cells = index.cells.join(used, "cell").select("part", "into_it", "cell", "own", "wide", "kids", "at", F.when(c("into_it"), c("into")).otherwise(c("out")).alias("matrix"))
    made = rows.groupBy("part", "back").cogroup(cells.groupBy("part", "into_it")).applyInPandas(_labelled, "vertex_id long, back boolean, cells array<long>, sizes array<int>, far binary")
    none = asked.where("cell is null").select("vertex_id", "back", F.array().cast("array<long>"), F.array().cast("array<int>"), F.lit(b""))
    return cut(made.union(none))


def _labelled(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """Labels of vertices (vertex_id, back, cell) by their cells and all above, deepest first."""
    states: dict[int, list[pd.DataFrame]] = {}
    for cell, some in rows.groupby("cell"):
        new = {"kid": -1, "x": b"", "cells": [[] for _ in range(len(some))], "sizes": [[] for _ in range(len(some))], "far": b""}
        states[int(cell)] = [some[["vertex_id", "back"]].assign(**new)]
    for cell in cells.sort_values("cell", ascending=False).itertuples():
        here = pd.concat(states.pop(cell.cell), ignore_index=True)
        states.setdefault(cell.cell >> SPLITS, []).extend(_raised(here.iloc[k : k + MADE], cell) for k in range(0, len(here), MADE))
    done = [*states.get(0, []), rows.assign(cells=None, sizes=None, far=None).iloc[:0]]
    return pd.concat(done, ignore_index=True)[["vertex_id", "back", "cells", "sizes", "far"]]


def _raised(rows: pd.DataFrame, cell) -> pd.DataFrame:
    """Labels that reach up to below a cell, with its hubs."""
    own, n = np.asarray(cell.own, np.int64), int(cell.wide)
    k = len(own)
    m = _matrix(cell.matrix, k, n)
    at = dict(zip(cell.kids.tolist(), cell.at, strict=True))
    x = np.full((len(rows), n), INF)
    below = rows["kid"].to_numpy(np.int64)
    home = np.flatnonzero(below < 0)
    x[home, np.searchsorted(own, rows["vertex_id"].to_numpy()[home])] = 0
    for kid in np.unique(below[below >= 0]).tolist():
        these = np.flatnonzero(below == kid)
        x[these[:, None], np.asarray(at[kid], np.int64)] = np.frombuffer(b"".join(rows["x"].iloc[these]), np.int64).reshape(len(these), -1)
    y = np.full((len(rows), n), INF)
    for first in range(0, len(rows), AT_ONCE):
        some, sums = y[first : first + AT_ONCE], x[first : first + AT_ONCE]
        for j in range(k):
            np.minimum(some, sums[:, j : j + 1] + m[j], out=some)
    border = np.minimum(x[:, k:], y[:, k:])
    return pd.DataFrame(
        {
            "vertex_id": rows["vertex_id"].to_numpy(), "back": rows["back"].to_numpy(), "kid": int(cell.cell), "x": [b.tobytes() for b in border],
            "cells": [[int(cell.cell), *old] for old in rows["cells"]], "sizes": [[k, *old] for old in rows["sizes"]],
            "far": [_stored(np.concatenate((a, _distances(old, sum(n))))) for a, old, n in zip(y[:, :k], rows["far"], rows["sizes"], strict=True)],
        }
    )


def held_labels(index: Index, ends: DataFrame) -> DataFrame:
    """``labels`` of all vertices (vertex_id, back) that are asked for, and maybe of others. An index that doesn't keep all makes those
    that it hasn't made before."""
    if index.labels is not None:
        return index.labels
    new = ends.select("vertex_id", "back").distinct()
    for known in index.made:
        new = new.join(growing(known.select("vertex_id", "back")), ["vertex_id", "back"], "left_anti")
    if not (new := cut(new)).isEmpty():
        index.made.append(labels(index, new))
    return reduce(DataFrame.union, index.made) if index.made else labels(index, new)


def hub_rows(index: Index, vertices: DataFrame) -> DataFrame:
    """(vertex_id, back, hub, dist): the hubs of vertices (vertex_id, back, most) within ``most``, a row for each; null doesn't bound.

    Two vertices' distance is the least sum over the hubs that one has forwards and the other one backwards.
    """
    asked = vertices.groupBy("vertex_id", "back").agg(F.when(F.max(c("most").isNull()), None).otherwise(F.max("most")).alias("most"))
    ends = asked.select("vertex_id", "back")
    held = ends.join(held_labels(index, ends), ["vertex_id", "back"])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for v, back, cells, sizes, far in zip(f["vertex_id"], f["back"], f["cells"], f["sizes"], f["far"], strict=True):
                parts = np.split(_distances(far, sum(sizes)), np.cumsum(sizes)[:-1]) if len(cells) else []
                out += [(v, back, int(cell), far.tolist()) for cell, far in zip(cells, parts, strict=True)]
            yield pd.DataFrame(out, columns=["vertex_id", "back", "cell", "far"])

    parts = held.mapInPandas(split, "vertex_id long, back boolean, cell long, far array<long>").join(index.cells.select("cell", "own"), "cell")
    rows = parts.select("vertex_id", "back", F.explode(F.arrays_zip(c("own").alias("hub"), c("far").alias("dist"))).alias("h")).select("vertex_id", "back", "h.hub", "h.dist")
    return rows.where(c("dist") < F.lit(int(INF))).join(asked, ["vertex_id", "back"]).where("most is null or dist <= most").drop("most")


def _counted(ends: DataFrame) -> dict[bool, int]:
    return {r["back"]: r["n"] for r in ends.groupBy("back").agg(F.count("*").alias("n")).collect()}


def _grid(sizes: dict[bool, int], parts: int, most: int) -> tuple[int, int]:
    """Rows and columns of a grid of fields: as many fields as partitions at least, on the side with more labels where the other one has few."""
    high, wide = (max(1, -(-sizes.get(x, 0) // most)) for x in (False, True))
    if sizes.get(False, 0) > sizes.get(True, 0):
        return max(high, -(-parts // wide)), wide
    return high, max(wide, -(-parts // high))


def _place(v: Column, seed: int, n: int) -> Column:
    return F.pmod(F.xxhash64(v, F.lit(seed)), F.lit(n)).cast("long")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pairs(index: Index, pairs: DataFrame) -> DataFrame:
    """(source, target, dist) of pairs. Sources and targets are dealt to the rows and the columns of a grid, and each of its fields is a task's, so
    that no source or target with very many pairs is one task's. Pairs with a number ``part`` are dealt by it instead, and a label goes
    only where one of its pairs does."""
    ends = cut(pairs.select(c("source").alias("vertex_id"), F.lit(False).alias("back")).union(pairs.select("target", F.lit(True))).distinct())
    held = held_labels(index, ends)
    sizes, parts = _counted(ends), _partitions(pairs)
    high, wide = _grid(sizes, parts, TOGETHER)
    where = _place(c("source"), 1, high) * wide + _place(c("target"), 2, wide)
    if "part" in pairs.columns:
        where = F.pmod(F.xxhash64("part"), F.lit(max(parts, -(-sum(sizes.values()) // TOGETHER)))).cast("long")
    asked = cut(pairs.select("source", "target", where.alias("field")))
    there = asked.select(c("source").alias("vertex_id"), F.lit(False).alias("back"), c("field").alias("at")).union(asked.select("target", F.lit(True), "field")).distinct()
    # A vertex that isn't in the network has no label, but a distance to itself.
    met = there.join(growing(held), ["vertex_id", "back"])
    return asked.groupBy("field").cogroup(met.groupBy("at")).applyInPandas(_pairs_met, "source long, target long, dist long")


def _all(indexes: list[Index], sources: DataFrame, targets: DataFrame, meet, fields: str) -> DataFrame:
    """What ``meet`` makes of all sources (source, ...) and targets (target, ...), by fields. The indexes have one order; ``far``,
    ``far1``, ... are the labels' distances by each of them. Other columns of sources and targets come along, null on the other side."""
    ends = cut(sources.select(c("source").alias("vertex_id"), F.lit(False).alias("back")).union(targets.select(c("target").alias("vertex_id"), F.lit(True).alias("back"))).distinct())
    known = ends
    for k, index in enumerate(indexes):
        held = held_labels(index, ends)
        none = {"cells": F.array().cast("array<long>"), "sizes": F.array().cast("array<int>"), "far": F.lit(b"")}
        one = ends.join(growing(held), ["vertex_id", "back"], "left").select("vertex_id", "back", *[F.coalesce(c(x), v).alias(x) for x, v in none.items()])
        known = known.join(one if k == 0 else one.select("vertex_id", "back", c("far").alias(f"far{k}")), ["vertex_id", "back"])
    for side, name, back in ((sources, "source", False), (targets, "target", True)):
        if len(side.columns) > 1:
            known = known.join(growing(side.withColumnRenamed(name, "vertex_id").withColumn("back", F.lit(back))), ["vertex_id", "back"], "left")
    known = cut(known)
    a, b = _fields(known, min(APART, indexes[0].order.levels), _counted(ends), _partitions(sources))
    return a.unionByName(b).groupBy("cell", "part", "i", "j").applyInPandas(meet, fields)


def _fields(known: DataFrame, levels: int, sizes: dict[bool, int], parts: int) -> tuple[DataFrame, DataFrame]:
    """Sources and targets of ``known``, a row for each field that they go to: (cell, part, i, j). Two vertices meet where their last common cell of the
    first ``levels`` below the root is, in the field of the target's next cell (part, 0 for none), and labels go there with the distances to
    the hubs of that cell and of those above alone. Large fields are dealt by rows (i) and columns (j)."""
    high, wide = [], []
    for k in range(levels + 1):
        most, below = (4 if k == levels else 16) * TOGETHER, 1 << (SPLITS * min(k + 1, levels))
        high.append(max(1, -(-sizes.get(False, 0) // (most << (SPLITS * k)))))
        wide.append(max(1, -(-sizes.get(True, 0) // (most * below)), -(-parts // below)))
    of = lambda counts, k: F.element_at(F.array(*[F.lit(n).cast("long") for n in counts]), k + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    place = lambda seed, n: F.pmod(F.xxhash64("vertex_id", F.lit(seed)), n)
    # What isn't in the network meets itself alone.
    chain = F.when(F.size("cells") > 0, F.slice("cells", 1, levels + 1)).otherwise(F.array(F.lit(0).cast("long")))
    rows = known.withColumn("chain", chain).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("chain") - 1)))
    rows = rows.withColumn("cell", F.element_at("chain", c("k") + 1)).withColumn("next", F.when(c("k") + 1 < F.size("chain"), F.try_element_at("chain", c("k") + 2)).otherwise(F.lit(0)))
    upto = F.when(c("k") < levels, c("k") + 1).otherwise(F.size("cells"))
    for far in [x for x in known.columns if x.startswith("far")]:
        total = lambda v: F.aggregate(v, F.lit(0), lambda x, y: x + y)
        each = F.when(F.length(far) > 0, F.length(far) / total("sizes")).otherwise(0)
        rows = rows.withColumn(far, F.substring(far, F.lit(1), (each * total(F.slice("sizes", F.lit(1), upto))).cast("int")))
    rows = rows.withColumns({"cells": F.slice("cells", F.lit(1), upto), "sizes": F.slice("sizes", F.lit(1), upto)}).drop("chain")
    kids = [F.shiftleft("cell", SPLITS) + x for x in range(1 << SPLITS)]
    others = F.filter(F.when((c("cell") > 0) & (c("k") < levels), F.array(F.lit(0).cast("long"), *kids)).otherwise(F.array(F.lit(0).cast("long"))), lambda x: (x == 0) | (x != c("next")))
    # Few targets have no next cell above the last level: the hubs.
    columns = F.when((c("part") == 0) & (c("k") < levels), F.lit(1).cast("long")).otherwise(of(wide, c("k")))
    a = rows.where("not back").withColumn("part", F.explode(others)).withColumn("i", place(1, of(high, c("k")))).withColumn("j", every(columns))
    b = rows.where("back").withColumn("part", c("next").cast("long")).withColumn("i", every(of(high, c("k")))).withColumn("j", place(2, columns))
    return tuple(x.drop("k", "next") for x in (a, b))


def _met_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, list[np.ndarray], np.ndarray]]:
    """All sources and targets of a field, some sources at a time, so that a task holds labels and few distances: those sources, all targets, a matrix
    for each weight, and which of its distances there are (by all weights)."""
    ends = pd.concat(list(batches), ignore_index=True)
    # Those below one cell are neighbours.
    ends = ends.iloc[sorted(range(len(ends)), key=[tuple(x) for x in ends["cells"]].__getitem__)]
    b, a = ends[ends["back"]], ends[~ends["back"]]
    sources, targets = a["vertex_id"].to_numpy(np.int64), b["vertex_id"].to_numpy(np.int64)
    weights = [x for x in ends.columns if x.startswith("far")]
    kinds = [(np.int32, FAR32) if all(map(_is_short, ends[far], ends["sizes"])) else (np.int64, INF) for far in weights]
    into = [{cell: (at, np.ascontiguousarray(y.T)) for cell, (at, y) in _by_cell(b, far, *kind).items()} for far, kind in zip(weights, kinds, strict=True)]
    for first in range(0, len(sources), AT_ONCE):
        some, found, there = a.iloc[first : first + AT_ONCE], [], True
        same = sources[first : first + AT_ONCE, None] == targets[None]
        for far, (kind, none), met in zip(weights, kinds, into, strict=True):
            best = np.where(same, kind(0), kind(none))
            for cell, (rows, x) in _by_cell(some, far, kind, none).items():
                if cell in met:
                    _lower(best[rows, met[cell][0]], x, met[cell][1])
            found.append(best)
            there = there & (best < none)
        yield some, b, found, there


def _lower(best: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Least sums of rows of x and columns of y."""
    for first in range(0, best.shape[1], COLUMNS):
        part, z = best[:, first : first + COLUMNS], y[:, first : first + COLUMNS]
        sums = np.empty(part.shape, part.dtype)
        for j in range(x.shape[1]):
            np.add(x[:, j : j + 1], z[j], out=sums)
            np.minimum(part, sums, out=part)


def _is_short(far: bytes, sizes: np.ndarray) -> bool:
    """Whether a label's distances take 32 bits, and sums of two do."""
    if len(far) != 4 * sum(sizes):
        return False
    found = np.frombuffer(far, np.int32)
    return not ((found >= SHORT) & (found < NEAR)).any()


def _by_cell(ends: pd.DataFrame, far: str, kind: type, none: np.integer) -> dict[int, tuple[slice, np.ndarray]]:
    """For each cell the rows that have it, and their distances to its hubs."""
    found: dict[int, list] = {}
    for i, (cells, sizes, all_) in enumerate(zip(ends["cells"], ends["sizes"], ends[far], strict=True)):
        all_, at = _distances(all_, sum(sizes)), 0
        all_ = np.where(all_ < INF, all_, none).astype(kind)
        for cell, n in zip(cells, sizes, strict=True):
            rows = found.setdefault(int(cell), [i, []])
            rows[1].append(all_[at : at + n])
            at += n
    return {cell: (slice(first, first + len(rows)), np.array(rows, kind).reshape(len(rows), -1)) for cell, (first, rows) in found.items()}


def _all_met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(source, target, dist, and further weights' distances) of a field, within a target's ``most`` if there is one."""
    for some, b, found, there in _met_rows(batches):
        if "most" in b.columns:
            there = there & (found[0] <= np.minimum(b["most"].fillna(INF - 1).to_numpy(np.int64), INF - 1))
        i, j = np.nonzero(there)
        rows = {"source": some["vertex_id"].to_numpy()[i], "target": b["vertex_id"].to_numpy()[j]}
        yield pd.DataFrame(rows | {f"dist{k or ''}": best[i, j].astype(np.int64) for k, best in enumerate(found)})


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(source, reached, farthest, total) of a field's targets."""
    for some, _, (best,), there in _met_rows(batches):
        far = np.where(there, best, 0).astype(np.int64)
        rows = {"source": some["vertex_id"], "reached": there.sum(1), "farthest": far.max(1, initial=0), "total": far.sum(1)}
        yield pd.DataFrame(rows)[there.any(1)]


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(source, target, vertex_id, dist) of what is settled before each source's target, which is ``upto`` away, and of that."""
    for some, b, (best,), there in _met_rows(batches):
        goal, upto, v = some["goal"].to_numpy(np.int64), some["upto"].to_numpy(np.int64), b["vertex_id"].to_numpy(np.int64)
        i, j = np.nonzero(there & ((best < upto[:, None]) | ((best == upto[:, None]) & (v[None] <= goal[:, None]))))
        yield pd.DataFrame({"source": some["vertex_id"].to_numpy()[i], "target": goal[i], "vertex_id": v[j], "dist": best[i, j].astype(np.int64)})


def _pairs_met(pairs: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    if pairs.empty:
        return pd.DataFrame({"source": [], "target": [], "dist": []}, dtype=np.int64)
    known: tuple[dict, dict] = ({}, {})
    for v, cells, sizes, far, back in zip(ends["vertex_id"], ends["cells"], ends["sizes"], ends["far"], ends["back"], strict=True):
        known[back][v] = (cells, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), _distances(far, sum(sizes)))
    found = []
    for s, t in zip(pairs["source"].tolist(), pairs["target"].tolist(), strict=True):
        if s == t:
            found.append((s, t, 0))
            continue
        if s not in known[0] or t not in known[1]:
            continue
        (a, upto, x), (b, _, y) = known[0][s], known[1][t]
        # Cells from the root down agree as far as both are below them.
        shared = min(len(a), len(b))
        while shared and a[shared - 1] != b[shared - 1]:
            shared -= 1
        if n := upto[shared]:
            if (d := int((x[:n] + y[:n]).min())) < INF:
                found.append((s, t, d))
    return pd.DataFrame(found, columns=["source", "target", "dist"], dtype=np.int64)


def distances_between(index: Index, pairs: DataFrame) -> DataFrame:
    """(source, target, dist) of distinct pairs (source, target) that are connected; a vertex is at distance 0 from itself.

    Pairs may have a number ``part``: those with one number meet in one task, so give one to pairs whose ends recur among them, and to a
    bounded number of pairs each.
    """
    pairs = cut(pairs.groupBy("source", "target").agg(F.min("part").alias("part")) if "part" in pairs.columns else pairs.select("source", "target").distinct())
    return _pairs(index, pairs)


def distances_among(index: Index, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, dist) of every source and target that are connected; a target's column ``most`` bounds its distances,
    null doesn't."""
    return distances_by([index], sources, targets)


def distances_by(indexes: list[Index], sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``distances_among`` by several weights on one order: (source, target, dist, dist1, ...) of those that are connected by all weights. All distances
    of two vertices come from one task, so the results are never joined. ``most`` bounds the first one."""
    one = targets.select("target").distinct()
    if "most" in targets.columns:
        one = targets.groupBy("target").agg(F.when(F.max(c("most").isNull()), None).otherwise(F.max("most")).alias("most"))
    fields = ", ".join(f"{x} long" for x in ("source", "target", "dist", *[f"dist{k}" for k in range(1, len(indexes))]))
    return _all(indexes, sources.select("source").distinct(), one, _all_met, fields)


def _with_sources(index: Index, sources: DataFrame) -> DataFrame:
    """The network's vertices as targets, and the sources, which reach themselves."""
    return index.order.vertices.select(c("vertex_id").alias("target")).union(sources.select("source")).distinct()


def totals_from(index: Index, sources: DataFrame) -> DataFrame:
    """(source, reached, farthest, total): how many vertices each source reaches, the greatest distance and the sum of all. Distances are
    summed up in the tasks that make them; what leaves these is a row for each source and field."""
    rows = _all([index], sources.select("source").distinct(), _with_sources(index, sources), _totals, "source long, reached long, farthest long, total long")
    return rows.groupBy("source").agg(F.sum("reached").alias("reached"), F.max("farthest").alias("farthest"), F.sum("total").alias("total"))


def settled_before(index: Index, pairs: DataFrame) -> DataFrame:
    """(source, target, vertex_id, dist): what a search from each source settles until it settles its target, ties by vertex; pairs have one target
    for each source. The pairs' distances come first, so that tasks give no other rows."""
    goals = cut(distances_between(index, pairs).select("source", c("target").alias("goal"), c("dist").alias("upto")))
    return _all([index], goals, _with_sources(index, goals), _settled, "source long, target long, vertex_id long, dist long")


_KNOWN: list[tuple[str, str, DataFrame, Index]] = []


def index_of(edges: DataFrame, weight: str = "travel_time") -> Index:
    """The index of a network, with all its labels up to KEPT vertices, built once for each weight and plan of the edges in an application. As
    with a cached table, files that change under the same plan need a new session."""
    app, shape = edges.sparkSession.sparkContext.applicationId, edges.select("tail", "head", *([weight] if weight not in ("tail", "head") else []))
    for known, of, plan, index in _KNOWN:
        if known == app and of == weight and plan.sameSemantics(shape):
            return index
    index = contracted(nested_order(edges), edges, weight)
    if index.order.vertices.count() <= KEPT:
        every = index.order.vertices.select("vertex_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
        index = replace(index, labels=labels(index, every))
    _KNOWN.append((app, weight, shape, index))
    del _KNOWN[:-8]
    return index
