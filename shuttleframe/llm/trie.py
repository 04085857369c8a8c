"""Prefix trie of conversations; sums over its subtrees by heavy paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stored
from .scans import scan

c = F.col
#: Every fifth conversation lends its first turns to those that follow it, up to LENT - 1 of them.
FAMILY, LENT = 5, 9
#: Ids of conversations that are joined into one string before a node's digest is taken.
JOINED = 4096
NODE = ["depth", "s1", "s2"]


def turns(conversations: DataFrame) -> DataFrame:
    """A light row for each turn: the text's two hashes and its bytes instead of the text. Null roles and texts are empty; rows
    without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(role, text, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), text, role).alias("k2"), F.octet_length(text).cast("long").alias("size"),
    )


def _lent(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % LENT


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and the turns (conv_id, depth, k1, k2, size) of the rebuilt ones, depth from 1.

    A conversation's first turns are at most eight rows of another one, which nine others take at most, so no join multiplies.
    """
    placed = stored(scan(turns(conversations), "conv_id", ["turn", "role", "k1", "k2"]).drop("turn", "role"), "turns")
    sizes = placed.groupBy("conv_id").agg(F.max("place").alias("n"))
    convs = stored(sizes.withColumn("base", c("conv_id") - c("conv_id") % FAMILY).withColumn("h", _lent(c("conv_id"))), "conversations")
    had = convs.select(c("conv_id").alias("base"), c("n").alias("n_base"))
    lacking = convs.join(had, "base", "left").select("conv_id", (c("h") - F.least("h", F.coalesce("n_base", F.lit(0)))).alias("lack")).where("lack > 0")
    own = placed.where(c("place") > _lent(c("conv_id"))).join(stored(lacking, "lacking"), "conv_id", "left")
    own = own.select("conv_id", (c("place") - F.coalesce("lack", F.lit(0))).alias("depth"), "k1", "k2", "size")
    first = placed.where(c("place") < LENT).withColumnRenamed("conv_id", "base")
    taken = first.join(convs.select("conv_id", "base", "h"), "base").where("place <= h").select("conv_id", c("place").alias("depth"), "k1", "k2", "size")
    return convs.select("conv_id"), own.union(taken)


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations that end at each node, numerically ascending. Sorted ranges join up to JOINED ids
    into a string side by side, so that what one node's digest takes in is few rows even if most conversations end there."""
    order = [*NODE, "conv_id"]
    ranged = ends.repartitionByRange(partitions(ends.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, seq = None, [], 0
        out: list[list] = [[], [], [], [], [], []]

        def put(part: int) -> None:
            for column, x in zip(out, (*node, part, seq, ",".join(map(str, ids))), strict=True):
                column.append(x)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=[*NODE, "part", "seq", "ids"])

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        part = 0
        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            d, s1, s2, conv = (b.column(n).to_pylist() for n in order)
            for at, conv_id in zip(zip(d, s1, s2, strict=True), conv, strict=True):
                if ids and (at != node or len(ids) == JOINED):
                    put(part)
                    ids, seq = [], seq + 1
                node = at
                ids.append(conv_id)
            if out[0]:
                yield batch()
                out = [[] for _ in out]
        if ids:
            put(part)
            yield batch()

    strings = ranged.mapInArrow(joined, "depth long, s1 long, s2 long, part int, seq long, ids string")
    strings = strings.repartition(*NODE).sortWithinPartitions(*NODE, "part", "seq")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            done = []
            for *at, ids in zip(*[b.column(n).to_pylist() for n in (*NODE, "ids")], strict=True):
                if at != node:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = at, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if done:
                yield _nodes(done)
        if node is not None:
            yield _nodes([(*node, sha.hexdigest())])

    return strings.mapInArrow(digested, "depth long, s1 long, s2 long, ends_sha256 string")


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NODE, "ends_sha256"])


def _at(df: DataFrame, depth: Column, s1: str, s2: str, *rest: Column) -> DataFrame:
    return df.select(depth.alias("depth"), c(s1).alias("s1"), c(s2).alias("s2"), *rest)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations, as the contract of op12 has it.

    A node's key is its depth and two sums modulo 2^64 of hashes of its turns and their places, 128 bits in all; sums of a
    prefix are running sums, so that even one very long conversation is keyed in ranges. Subtrees are summed along heavy paths: each
    node's largest child (by members, then by the smallest member) continues its path. A path ends at a childless node and is named
    by that node's smallest member, on whose own turns the path lies; so the paths, their heads and the number of light edges above
    them come from one grouping. From the paths with the most light edges above them on, suffix sums run along each path, and
    each head's sums are added to its parent, which lies on a path with one light edge less. A light child has at most half of
    its parent's members, so there are at most as many rounds as the number of conversations has binary digits.

    Rows of one turn come in the order of their roles, then of a hash of their texts. Rows whose conv_id is null make no
    conversation. With no conversation there is no node. ``conv_id - conv_id % 5`` truncates towards zero.
    """
    spark = conversations.sparkSession
    convs, steps = rebuilt(conversations)
    hashed = steps.withColumn("u1", F.xxhash64("depth", "k1", "k2")).withColumn("u2", F.xxhash64("k2", "depth", "k1")).drop("k1", "k2")
    walks = scan(hashed, "conv_id", ["depth"], ("u1", "u2")).select(
        "conv_id", "depth", "size", c("u1_to").alias("s1"), c("u2_to").alias("s2"), c("u1_before").alias("p1"), c("u2_before").alias("p2")
    )
    walks = stored(walks, "walks")
    every = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    members = walks.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    members = stored(members, "nodes")
    largest = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("inverse"), "s1", "s2")).alias("heavy")
    kids = stored(_at(members.groupBy("depth", "p1", "p2").agg(F.count("*").alias("n_children"), largest), c("depth") - 1, "p1", "p2", c("n_children"), c("heavy")), "children")
    parents = kids.join(_at(members, c("depth"), "s1", "s2", c("conv_id").alias("parent_conv_id")), NODE, "left")
    parents = stored(parents.withColumn("parent_conv_id", F.when(c("depth") == 0, F.lit(every["least"]).cast("long")).otherwise(c("parent_conv_id"))), "parents")
    up = parents.select((c("depth") + 1).alias("depth"), c("s1").alias("p1"), c("s2").alias("p2"), "parent_conv_id", c("heavy.s1").alias("h1"), c("heavy.s2").alias("h2"))
    linked = members.join(up, ["depth", "p1", "p2"]).withColumn("light", ~((c("s1") == c("h1")) & (c("s2") == c("h2")))).drop("h1", "h2")
    linked = linked.join(_at(kids, c("depth"), "s1", "s2", c("n_children")), NODE, "left").fillna(0, "n_children")
    linked = stored(linked.withColumn("leaves", (c("n_children") == 0).cast("long")).withColumn("saved", (c("n_convs") - 1) * c("size")), "linked")

    ends = walks.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("e")).select("conv_id", "e.*")
    ends = convs.join(ends, "conv_id", "left").fillna(0, NODE)
    root = spark.range(0, 1 if every["n"] else 0, 1, 1).select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"), F.lit(every["least"]).cast("long").alias("conv_id"),
        F.lit(every["n"]).cast("long").alias("n_convs"), F.lit(None).cast("long").alias("parent_conv_id"),
    ).join(_at(kids, c("depth"), "s1", "s2", c("n_children")), NODE, "left").fillna(0, "n_children")
    shown = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children"]
    nodes = linked.select(*shown).union(root.select(*shown))
    out = nodes.join(_subtree_sums(walks, linked), NODE, "left").join(stored(_digests(ends), "ends"), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _subtree_sums(walks: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) of all nodes and the root; nothing where there is only the root."""
    bottoms = linked.where("n_children = 0").select("conv_id")
    own = linked.select(*NODE, "light", "leaves", "saved", "p1", "p2")
    onto = stored(walks.join(bottoms, "conv_id", "left_semi").select(c("conv_id").alias("path"), *NODE).join(own, NODE), "descents")
    heads = onto.groupBy("path").agg(F.sum(c("light").cast("long")).alias("above"), F.coalesce(F.max(F.when(c("light"), c("depth"))), F.lit(0)).alias("head"))
    heads = stored(heads, "heads")
    held = ["path", "above", "head", *NODE, "leaves", "saved", "p1", "p2"]
    zero = F.lit(0).cast("long")
    top = heads.where("head = 0").select("path", "above", "head", *[zero.alias(n) for n in held[3:]])
    paths = stored(onto.join(heads, "path").where("depth >= head").select(*held).union(top), "paths")
    attached, sums = None, None
    for above in range(paths.agg(F.coalesce(F.max("above"), F.lit(-1))).first()[0], -1, -1):
        now = paths.where(c("above") == above)
        if attached is not None:
            now = now.join(attached, NODE, "left")
            now = now.withColumn("leaves", c("leaves") + F.coalesce("more_leaves", zero)).withColumn("saved", c("saved") + F.coalesce("more_saved", zero)).drop("more_leaves", "more_saved")
        now = stored(scan(now.withColumn("up", -c("depth")), "path", ["up"], ("leaves", "saved")).select(*held, c("leaves_to").alias("n_leaves"), c("saved_to").alias("saved_tokens")), "sums")
        attached = now.where("depth = head and depth > 0").groupBy("depth", "p1", "p2").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        attached = stored(_at(attached, c("depth") - 1, "p1", "p2", c("more_leaves"), c("more_saved")), "attached")
        done = now.select(*NODE, "n_leaves", "saved_tokens")
        sums = done if sums is None else sums.union(done)
    return paths.select(*NODE, zero.alias("n_leaves"), zero.alias("saved_tokens")) if sums is None else sums


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
