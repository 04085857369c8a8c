"""SimHash near-duplicates by a segment-popcount embedding (operator 5).

A fingerprint of 64 bits is embedded as 32 counts, the number of set bits in each segment of two bits. One flipped bit
changes one count by one, so the Manhattan distance of two embeddings is a lower bound of the Hamming distance of the
fingerprints. Embeddings within Manhattan distance r differ in at most r of the groups that the 32 segments are cut into.
With r + 3 groups, at least three groups are equal, and each choice of three groups is one grid: the range join is an
equi-join on the grid cell, once per grid. Pairs in a cell pass the Manhattan bound first and the exact Hamming test
then.

Copies never meet: the join runs over distinct fingerprints. A cell that holds more than ``CELL`` fingerprints isn't
joined with itself; each of its members lists its ball of radius 1 (itself and the 64 fingerprints one flip away), and
members that share a point are linked through it. Two fingerprints share such a point exactly when they differ in at
most two bits, so this way is exact for r <= 2, and it makes 65 rows a member whatever the cell's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_place, chunks, documents, mix64, stored, texts, whole
from .components import components

#: Members of a grid cell that are compared with each other.
CELL = 32
EVEN = 0x5555555555555555


def shingles(text: str, n: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text with A-Z lower-cased, repeats included; none without words."""
    words = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - n]]]
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[n - 1 :], strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    bits, n = np.zeros(64, np.int64), len(hashes)
    h = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 60_000):
        bits += np.unpackbits(h[at : at + 60_000], axis=1).sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of one text."""
    return majority(shingles(text, shingle))


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fp`` (long, the 64 bits) of every row; a null text counts as an empty one."""
    kept = docs.select(*keep, whole().alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts(b)], dtype=np.uint64).view(np.int64)
            arrays = [b.column(i) for i in range(len(keep))] + [pa.array(fps)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "fp"])

    types = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", fp bigint")


def embedding(fp: str):
    """32 counts of two bits each, packed in a long."""
    x = F.col(fp)
    low, high = x.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def grids(radius: int) -> list[int]:
    """A mask over the packed counts for each choice of three of the radius + 3 groups of segments."""
    groups = np.array_split(np.arange(32), radius + 3)
    masks = [sum(3 << (2 * int(s)) for s in g) for g in groups]
    return [_as_long(sum(masks[i] for i in c)) for c in combinations(range(radius + 3), 3)]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints whose transitive closure is that of Hamming distance <= radius.

    ``fps``: one column fp, distinct. In cells of up to CELL members the pairs are all those within the radius.
    """
    if radius != 2:
        raise ValueError("the exact way for cells beyond CELL is for radius 2")
    cells = fps.select("fp", embedding("fp").alias("v")).select(
        "fp", "v", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in grids(radius)])).alias("grid", "cell")
    )
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    crowded = stored(cells.join(stored(sizes, "sizes"), ["grid", "cell"]), "cells")
    small = crowded.where(F.col("n") <= CELL)
    left = small.select("grid", "cell", F.col("fp").alias("a"), F.col("v").alias("va"))
    right = small.select("grid", "cell", F.col("fp").alias("b"), F.col("v").alias("vb"))
    # Manhattan distance of packed counts: in each two-bit field |x - y| is 0, 1 or 2, from the bits that x ^ y sets.
    diff = F.col("va").bitwiseXOR(F.col("vb"))
    odd = diff.bitwiseAND(F.lit(EVEN))
    two = F.shiftrightunsigned(diff, 1).bitwiseAND(F.lit(EVEN)).bitwiseAND(F.bitwise_not(odd))
    near = (
        left.join(right, ["grid", "cell"])
        .where("a < b")
        .where(F.bit_count(odd) + 2 * F.bit_count(two) <= radius)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .select("a", "b")
    )
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_as_long(1 << i))) for i in range(64)])
    points = crowded.where(F.col("n") > CELL).select("fp").distinct().select("fp", F.explode(ball).alias("point"))
    least = stored(points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z"), "points")
    through = points.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b"))
    return near.union(through).distinct()


def near_duplicates(docs: DataFrame, keep: list[str], shingle: int = 3, radius: int = 2) -> DataFrame:
    """``keep`` columns, fp and ``root`` of every row: rows of one group of near-duplicates have the same root.

    Null and empty texts have fingerprint 0 and link like any other; copies and repeated rows share a fingerprint and so
    a group; an empty table gives an empty result.
    """
    rows = stored(with_fingerprints(docs, keep, shingle), "fingerprints")
    found = components(links(rows.select("fp").distinct(), radius))
    return rows.join(found, rows["fp"] == found["node"], "left").select(
        *[rows[c] for c in keep], rows["fp"], F.coalesce(found["root"], rows["fp"]).alias("root")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(near_duplicates(documents(spark, sf_dir), ["doc_id"]), "groups")
    # Written first: both sides of the join are plain exchanges, so that Spark can split a group with very many rows.
    first = stored(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rows.join(first, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Samples of a text, shingles in each, and smallest hashes that a sketch keeps.
SAMPLES, PICKED, SKETCH = 10, 3, 128
#: Four standard deviations of a similarity of 0.8 as a sketch estimates it.
UNSURE = 0.15
#: Texts (and shingles of each) that tell which shingles are common, at most. They only order shingles; no link depends on them.
COMMON_TEXTS, COMMON_SHINGLES, COMMON = 10_000, 5_000, 4
#: Keys up to which texts are looked up by a broadcast (8 MB); beyond, they are dealt by hash.
SENT_KEYS = 1_000_000
#: Share of a text's shingles that are kept as rare ones beyond those that a first common one needs.
MORE = 0.05
#: Shingles of the texts of a block when candidate pairs are verified, pairs of a cell, and texts of a block, about.
BLOCK, PAIRS, MEMBERS = 100_000, 4_000, 1_000
#: Times that groups are joined by one pair before all pairs are compared. The result doesn't depend on it.
ROUNDS = 3
#: Texts that a task remembers, so that copies are sketched once; a text seen again after so many others is sketched again.
SEEN = 500_000


def common_shingles(keyed: DataFrame, texts_in_all: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) that COMMON or more texts of a sample by hash have, and how many have them."""
    every = max(1, texts_in_all // COMMON_TEXTS)
    some = keyed.where(F.pmod(F.xxhash64("kt"), F.lit(every)) == 0).dropDuplicates(["kt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 50):
            hashes = [np.unique(shingles(t, shingle))[:COMMON_SHINGLES].view(np.int64) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes))], names=["h"])

    found = some.select("text").mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).toPandas()
    hashes = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy(np.int64)[order]


def ahead(n, least: float):
    """How many of n shingles are kept as the rare ones: so many that two sets of similarity ``least`` or more have over MORE of
    the smaller one's among them in common."""
    return n - np.ceil(least * n - 1e-6) + 1 + np.floor(MORE * n)


def rarest(one: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a text, rare ones first, by an order that all texts share."""
    hashes, counts = common
    rank = np.zeros(len(one), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, one), len(hashes) - 1)
        rank = np.where(hashes[at] == one, counts[at], 0)
    return one[np.lexsort((one, rank))][: int(ahead(len(one), least))]


def shared_by(x, y, least: float):
    """Rare shingles that sets of x and y shingles have in common, at least, if their similarity is ``least`` or more.

    They share least / (1 + least) * (x + y) of all. What isn't rare in both lies behind all rare ones of one of them.
    """
    return np.ceil(least / (1 + least) * (x + y) - 1e-6) - np.maximum(x - ahead(x, least), y - ahead(y, least))


def shared_by_any(n: int, least: float) -> int:
    """``shared_by`` of n shingles and as many as suit an alike set the least: the fewest or the most that one can have."""
    few, many = math.ceil(least * n - 1e-6), math.floor(n / least + 1e-6)
    return max(1, min(int(shared_by(n, y, least)) for y in {few, min(few + 1, n), max(n, many - 1), many}) - 1)


def sketched(keyed: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, least: float) -> DataFrame:
    """kt, fp, samples, sketch, n, rare: the SimHash of a text, those of its samples, the upper halves of its smallest hashes,
    the number of its shingles, its rarest ones. A task gives a text once, so that copies never meet later on.

    Sample k is the PICKED shingles that come first in the k-th random order of all shingles, so texts that share most
    shingles share most samples, and a shared sample has the same SimHash whatever else the texts hold.
    """
    seeds = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64))
    sent = keyed.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in chunks(batches, 200):
            kts, fps, samples, sketches, sizes, rare = [], [], [], [], [], []
            for kt, text in zip(b.column("kt").to_pylist(), b.column("text"), strict=True):
                if kt in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(kt)
                h = shingles(text.as_py() or "", shingle)
                kts.append(kt)
                fps.append(majority(h))
                one = np.unique(h)
                keys = []
                for s in seeds:
                    mixed = mix64(one ^ s)
                    if len(mixed) > PICKED:
                        mixed = np.partition(mixed, PICKED)[:PICKED]
                    mixed = np.sort(mixed)
                    x, y, z = (mixed[min(i, len(mixed) - 1)] if len(mixed) else np.uint64(0) for i in range(3))
                    keys.append((x & y) | (x & z) | (y & z))
                samples.append(np.array(keys, np.uint64).view(np.int64))
                sketches.append((one[:SKETCH] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                sizes.append(len(one))
                rare.append(rarest(one, sent.value, least).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kts, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(samples, longs), pa.array(sketches, pa.list_(pa.int32())), pa.array(sizes, pa.int32()), pa.array(rare, longs)],
                names=["kt", "fp", "samples", "sketch", "n", "rare"],
            )

    return keyed.mapInArrow(run, "kt bigint, fp bigint, samples array<bigint>, sketch array<int>, n int, rare array<bigint>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """kt, hashes (all different shingles) of rows (kt, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 50):
            sets = [np.unique(shingles(t, shingle)).view(np.int64) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("kt"), pa.array(sets, pa.list_(pa.int64()))], names=["kt", "hashes"])

    return rows.select("kt", "text").mapInArrow(run, "kt bigint, hashes array<bigint>")


def sets_of(keyed: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """kt, hashes, n of the texts whose kt is among ``asked`` (kt, distinct), as a table."""
    asked = stored(asked, "asked")
    few = asked.count() <= SENT_KEYS
    found = keyed.join(F.broadcast(asked) if few else asked, "kt", "left_semi")
    return stored(shingle_sets(found.dropDuplicates(["kt"]), shingle).withColumn("n", F.size("hashes")), "sets")


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("kt")).union(pairs.select("b")).distinct()


def same_by_sets(pairs: DataFrame, keyed: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b, ra, rb) whose whole shingle sets have a similarity of ``least`` or more."""
    sets = sets_of(keyed, nodes_of(pairs), shingle)
    return judged(pairs, sets, lambda common, x, y: common / np.maximum(x + y - common, 1) >= least)


def similar(rows: DataFrame, keyed: DataFrame, shingle: int, least: float) -> DataFrame:
    """Pairs (a, b) of kt whose shingle sets have a similarity of ``least`` or more, through shared samples: a first pass.

    A group that shares a sample is never paired up: its members are tied to its first and last one, which links the copies
    of one text and most near copies. ``missed`` finds the links between the groups that this leaves. A similarity is
    estimated from the SKETCH smallest hashes of the union; an estimate within UNSURE of ``least``, or a bit above it where
    sketches are whole sets, gives way to the whole sets, made again from the texts.
    """
    keys = rows.where("n > 0").select("kt", F.posexplode("samples").alias("k", "sample")).distinct()
    # Tables on both sides of a join are plain exchanges, whose large partitions Spark can split.
    ends = keys.groupBy("k", "sample").agg(F.min("kt").alias("lo"), F.max("kt").alias("hi")).where("lo < hi")
    tied = keys.join(stored(ends, "ends"), ["k", "sample"])
    pairs = _tied(tied, F.array("lo", "hi"))
    own = stored(rows.select("kt", "sketch", "n").join(nodes_of(pairs), "kt", "left_semi").dropDuplicates(["kt"]), "sketches")
    named = lambda end, sketch, n: own.select(F.col("kt").alias(end), F.col("sketch").alias(sketch), F.col("n").alias(n))
    both = pairs.join(named("a", "x", "nx"), "a").join(named("b", "y", "ny"), "b")
    # Hashes are compared as unsigned numbers: flipping the top bit keeps their order.
    flip = F.lit(-(1 << 31))
    union = F.array_sort(F.transform(F.array_union("x", "y"), lambda h: h.bitwiseXOR(flip)))
    full = (F.col("nx") <= SKETCH) & (F.col("ny") <= SKETCH)
    least_of = F.when(full, union).otherwise(F.slice(union, 1, SKETCH))
    shared = F.transform(F.array_intersect("x", "y"), lambda h: h.bitwiseXOR(flip))
    share = F.size(F.array_intersect(least_of, shared)) / F.size(least_of)
    guessed = both.select("a", "b", F.when(full, 0.02).otherwise(UNSURE).alias("margin"), share.alias("share"))
    guessed = stored(guessed.where(F.col("share") >= least - F.col("margin")), "guessed")
    sure = F.col("share") >= least + F.col("margin")
    unsure = guessed.where(~sure).select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"))
    return stored(guessed.where(sure).select("a", "b").union(same_by_sets(unsure, keyed, shingle, least).select("a", "b")), "first-links")


def missed(rows: DataFrame, found: DataFrame, keyed: DataFrame, shingle: int, least: float) -> DataFrame:
    """Pairs (a, b) of roots of ``found`` (node, root) that some two texts of similarity ``least`` or more tie together. All such.

    Two passes of a prefix filter. First, alike texts have so many rare shingles in common (``shared_by``). Those that only one
    group has don't count; a text that is left with fewer than it must share with any partner has none, and of others, as many
    as it must share less one may be left out, the most frequent ones. Texts that still meet another group are suspects.
    Second, suspects' whole sets are ordered by how many suspects have a shingle, and the same argument holds for them: sets of
    x and y <= x shingles share least / (1 + least) * (x + y), so the smaller one has a common shingle so near its front that as
    many for two sets of its size are left, the larger one so near that as many for its smallest partner are, and both so near
    that as many for this pair are. Pairs that meet so are compared as whole sets: first one of every two groups, which joins
    most of what can be joined, then all that stand between groups that are left. Texts that share a template of less
    than the similarity don't meet, however many there are, as the template is the most frequent part of them.
    """
    places = rows.select("kt", "n", F.explode("rare").alias("h"))
    # Counted with a combine before the shuffle and written, so that Spark can split a hot shingle in the join.
    often = stored(places.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "often")
    places = stored(places.join(often, "h", "left_semi"), "places")
    group = found.select(F.col("node").alias("kt"), "root")
    places = places.join(group, "kt", "left").withColumn("root", F.coalesce("root", "kt"))
    met = places.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    places = stored(places.join(stored(met.select("h", "m"), "met"), "h").distinct(), "split-places")
    must = F.udf(lambda n: shared_by_any(n, least), "int")
    sizes = stored(places.select("n").distinct().withColumn("must", must("n")), "sizes-of-sets")
    own = Window.partitionBy("kt")
    # The least ones by (m, h), an order that all texts share.
    ranked = places.withColumns({"all": F.count("*").over(own), "at": F.row_number().over(own.orderBy("m", "h"))})
    chosen = stored(ranked.join(sizes, "n").where("at <= all - must + 1").select("h", "root", "kt"), "chosen-places")
    again = stored(chosen.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h"), "met-again")
    suspects = stored(chosen.join(again, "h", "left_semi").select("kt", "root").distinct(), "suspects")

    sets = sets_of(keyed, suspects.select("kt"), shingle)
    every = sets.join(suspects, "kt").select("kt", "root", "n", F.explode("hashes").alias("h"))
    known = every.groupBy("h").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    places = every.join(stored(known.select("h", "m"), "met-in-sets"), "h")
    places = places.withColumns({"all": F.count("*").over(own), "at": F.row_number().over(own.orderBy("m", "h"))})
    size, left = F.col("n"), F.col("all") - F.col("at") + 1
    places = places.select("h", "kt", "root", "n", left.alias("left"), (left >= _wanted(size, size, least)).alias("front"))
    places = stored(places.where(F.col("left") >= _wanted(size, F.ceil(least * size - 1e-6), least)), "fronts")
    same = lambda pairs: judged(pairs, sets, lambda common, x, y: common / np.maximum(x + y - common, 1) >= least)
    every = None
    for _ in range(ROUNDS):
        # One pair of every two groups that meet: their members with the most shared shingles.
        links = stored(same(_turned(_across(places, least).select(F.col("best_a").alias("x"), F.col("best_b").alias("y"), "ra", "rb"))).select("ra", "rb"), "best-links")
        every = links if every is None else every.union(links)
        if links.isEmpty():
            break
        merged = components(links.toDF("a", "b")).toDF("root", "new")
        places = places.join(merged, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
        met = stored(places.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h"), "met-still")
        places = stored(places.join(met, "h", "left_semi"), "fronts-still")
    across = _across(places, least).select("h", "ra", "rb", "few_b", "left_b")
    small = places.where("front").select("h", F.col("root").alias("ra"), F.col("kt").alias("x"), F.col("n").alias("nx"), F.col("left").alias("lx"))
    large = places.select("h", F.col("root").alias("rb"), F.col("kt").alias("y"), F.col("n").alias("ny"), F.col("left").alias("ly"))
    may = F.least("lx", "left_b") >= _wanted(F.col("nx"), F.greatest("nx", "few_b"), least)
    fits = (F.col("nx") <= F.col("ny")) & (F.col("nx") >= least * F.col("ny") - 1e-6) & (F.least("lx", "ly") >= _wanted(F.col("nx"), F.col("ny"), least))
    near = across.join(small, ["h", "ra"]).where(may).join(large, ["h", "rb"]).where(fits)
    links = same(_turned(near.select("x", "y", "ra", "rb"))).select("ra", "rb")
    return every.union(links).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def _wanted(x, y, least: float):
    """Shingles that sets of x and y shingles have in common, at least, if their similarity is ``least`` or more."""
    return F.ceil(least / (1 + least) * (x + y) - 1e-6)


def _across(places: DataFrame, least: float) -> DataFrame:
    """(h, ra, rb, best_a, best_b, few_b, left_b): groups that meet in a shingle, a with a smaller or equal set at its front, as far as
    the sizes and what is left of their members may suit, and the member of either with the most left.

    Groups are paired before their members, so that the members of a large one never meet each other.
    """
    best = F.max(F.struct("left", "kt"))
    groups = places.groupBy("h", "root").agg(
        F.min("n").alias("few"), F.max("n").alias("many"), best.alias("best"), F.max(F.when(F.col("front"), F.col("n"))).alias("many_f"),
        F.min(F.when(F.col("front"), F.col("n"))).alias("few_f"), F.max(F.when(F.col("front"), F.struct("left", "kt"))).alias("best_f"),
    )
    groups = stored(groups, "groups")
    a = groups.where("few_f is not null").select("h", F.col("root").alias("ra"), F.col("few_f").alias("few_a"), F.col("many_f").alias("many_a"), F.col("best_f.left").alias("left_a"), F.col("best_f.kt").alias("best_a"))
    b = groups.select("h", F.col("root").alias("rb"), F.col("few").alias("few_b"), F.col("many").alias("many_b"), F.col("best.left").alias("left_b"), F.col("best.kt").alias("best_b"))
    sizes = (F.col("few_a") <= F.col("many_b")) & (F.col("many_a") >= least * F.col("few_b") - 1e-6)
    return a.join(b, "h").where("ra <> rb").where(sizes & (F.least("left_a", "left_b") >= _wanted(F.col("few_a"), F.greatest("few_a", "few_b"), least)))


def _turned(near: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, ra, rb) with a < b of pairs (x, y, ra, rb)."""
    one = F.struct(F.col("x").alias("a"), F.col("y").alias("b"), "ra", "rb")
    other = F.struct(F.col("y").alias("a"), F.col("x").alias("b"), F.col("rb").alias("ra"), F.col("ra").alias("rb"))
    turned = near.select(F.when(F.col("x") < F.col("y"), one).otherwise(other).alias("p"))
    return stored(turned.select("p.*").distinct(), "candidates")


def judged(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The pairs (a, b, ra, rb), a < b, that pass ``test`` (hashes in common, n of a and b), with ``sets`` (kt, n, hashes).

    Texts that have pairs with the same smallest text share a label, and so a block, as far as they are MEMBERS, their hashes fit in
    BLOCK and their pairs in PAIRS. Pairs go to cells of two blocks, and a text once to each cell where it has a pair.
    """
    ends = pairs.select(F.col("a").alias("kt"), F.col("a").alias("low")).union(pairs.select("b", "a"))
    sized = ends.groupBy("kt").agg(F.min("low").alias("label"), F.count("*").alias("pairs")).join(sets.select("kt", F.size("hashes").alias("size")), "kt")
    sized = stored(sized, "labels")
    hashes, met, nodes = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-hashes // BLOCK), -(-met // (2 * PAIRS)), -(-nodes // MEMBERS))
    cuts = F.greatest(F.ceil(F.sum("size") / BLOCK), F.ceil(F.sqrt(F.sum("pairs") / (2 * PAIRS))), F.ceil(F.count("*") / MEMBERS))
    parts = stored(sized.groupBy("label").agg(cuts.alias("parts")), "parts-of-labels")
    salt = F.pmod(F.xxhash64("kt"), F.col("parts"))
    block = stored(sized.join(parts, "label").select("kt", F.pmod(F.xxhash64("label", salt), F.lit(blocks)).alias("block")), "blocks")
    celled = pairs.join(block.toDF("a", "ba"), "a").join(block.toDF("b", "bb"), "b")
    celled = celled.select("a", "b", "ra", "rb", (F.least("ba", "bb") * blocks + F.greatest("ba", "bb")).alias("cell"))
    celled = stored(celled, "cells-of-pairs")
    wanted = celled.select("cell", "a").union(celled.select("cell", "b")).distinct().toDF("at", "kt")

    def judge(of_cell: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        keys = members["kt"].to_numpy(np.int64)
        by_key = np.argsort(keys)
        place = lambda x: by_key[np.searchsorted(keys, x.to_numpy(np.int64), sorter=by_key)]
        hashes = members["hashes"].tolist()
        sizes, n = np.array([len(h) for h in hashes], np.int64), members["n"].to_numpy(np.int64)
        ends = np.cumsum(sizes)
        ids = np.unique(np.concatenate(hashes), return_inverse=True)[1].reshape(-1)
        one = [ids[e - s : e] for e, s in zip(ends, sizes, strict=True)]
        a, b = place(of_cell["a"]), place(of_cell["b"])
        mark, good = np.zeros(len(ids) + 1, bool), np.zeros(len(a), bool)
        order = np.argsort(a, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            x = a[run[0]]
            mark[one[x]] = True
            common = np.array([np.count_nonzero(mark[one[y]]) for y in b[run]])
            good[run] = test(common, n[x], n[b[run]])
            mark[one[x]] = False
        return of_cell.loc[good, ["a", "b", "ra", "rb"]]

    dealt = wanted.join(sets, "kt").groupBy("at")
    return celled.groupBy("cell").cogroup(dealt).applyInPandas(judge, "a bigint, b bigint, ra bigint, rb bigint")


def _tied(members: DataFrame, ends) -> DataFrame:
    """Different pairs (a, b) of each kt and its ends."""
    ties = members.select("kt", F.explode(ends).alias("end")).where("kt <> end")
    return stored(ties.select(F.least("kt", "end").alias("a"), F.greatest("kt", "end").alias("b")).distinct(), "pairs")


def with_text_keys(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``plain`` (doc_id, text and others) with ``kd`` (doc_id, null: the smallest long) and ``kt``, a hash that differs for
    different texts; and (kt, kd, m): the smallest kd of each text, and its rows.

    Two hashes of 64 bits tell where two texts share the first one; there, the second one takes its place. Few texts do: some
    hundreds among 10^11.
    """
    kd, second = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(whole(), F.lit(1))
    keyed = plain.withColumns({"kd": kd, "kt": F.xxhash64(whole())})

    def firsts(rows: DataFrame) -> DataFrame:
        of_text = rows.select("kt", "kd", second.alias("h2")).groupBy("kt")
        return stored(of_text.agg(F.min("kd").alias("kd"), F.count("*").alias("m"), (F.min("h2") < F.max("h2")).alias("clash")), "firsts")

    first = firsts(keyed)
    if clashes := [r["kt"] for r in first.where("clash").select("kt").collect()]:
        keyed = keyed.withColumn("kt", F.when(F.col("kt").isin(clashes), second).otherwise(F.col("kt")))
        first = firsts(keyed)
    return keyed, first.drop("clash")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 2, least: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest doc_id (of equal ones any one of them).

    Texts are linked if their SimHash fingerprints differ in at most ``radius`` bits, or if their shingle sets have a
    similarity of ``least`` or more: fingerprints of texts that are 0.8 alike differ in some ten bits, beyond what a grid of
    popcounts can join. Most of these links come from shared samples of shingles, and ``missed`` adds every one that joins
    two groups. A null text counts as an empty one, a null doc_id comes first; texts without words are one group; columns
    may have any names; an empty table gives an empty one.
    """
    plain, back = by_place(docs, "doc_id", "text")
    keyed, firsts = with_text_keys(plain)
    of_texts = keyed.select("kt", whole().alias("text"))
    common = common_shingles(of_texts, firsts.count(), shingle)
    rows = stored(sketched(of_texts, common, shingle, least), "sketched")
    of_fp = stored(rows.groupBy("fp").agg(F.min("kt").alias("top")), "fps")
    near = links(of_fp.select("fp"), radius)
    by_fp = near.join(of_fp.select(F.col("fp").alias("a"), F.col("top").alias("ka")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("top").alias("kb")), "b").select("ka", "kb")
    same = rows.select("fp", "kt").distinct().join(of_fp, "fp").where("kt <> top").select("top", "kt")
    every = by_fp.union(same).union(similar(rows, of_texts, shingle, least)).toDF("a", "b")
    found = components(every)
    joined = components(missed(rows, found, of_texts, shingle, least)).toDF("old", "new")
    rooted = firsts.join(found, F.col("kt") == F.col("node"), "left").select("kd", "kt", F.coalesce("root", "kt").alias("old"))
    rooted = rooted.join(joined, "old", "left").select("kd", "kt", F.coalesce("new", "old").alias("root"))
    kept = stored(rooted.groupBy("root").agg(F.min(F.struct("kd", "kt")).alias("m")).select("m.kd", "m.kt"), "kept")
    return back(keyed.dropDuplicates(["kd", "kt"]).join(kept, ["kd", "kt"], "left_semi"))
