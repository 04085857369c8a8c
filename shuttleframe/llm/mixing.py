"""Mixing sources to target weights by pivotal dependent rounding (operator 8).

Every source gets a target in words. Its documents start with the same fractional number of copies, target / size of the
source. Whole copies are settled at once; the fractions are rounded dependently: two documents with fractions meet, and
mass moves from one to the other, in proportion to their sizes so that the words taken stay what they are, until one of
them is 0 or 1. Which way it moves is drawn so that each fraction keeps its expectation. A chunk of documents leaves one
unsettled document, and these residuals meet in the next level of a tree, up to one document a source, which takes a part
of its words.

Chunks are cut by a hash of the row within its source, so that a source with a third of all rows is many chunks, and a
level's number of chunks falls by FANOUT.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, by_place, documents, stored, whole

# Weights of the sources in their order, repeating; share of all words; most copies of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Documents in a chunk of the first level, about; residuals that meet in a later one.
CHUNK = 2_000
FANOUT = 100


def words(col: str = "text") -> Column:
    return F.regexp_count(whole(col), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size) rows.

    Water filling: each target is weight x level, at most ``most`` x its source's size, and the level is where they sum up
    to ``share`` of all words. Each round settles the sources that are above and shares the rest again by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # Order by code point, null last: UTF-8 byte order, which is how Spark compares strings.
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    per = stored(per.withColumn("weight", weight), "sources")
    whole_size = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    want, level, before = share * whole_size, 0.0, -1
    while True:
        capped = F.col("weight") * level > most * F.col("source_size")
        row = per.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if row["n"] == before or not row["open"]:
            break
        before, level = row["n"], (want - most * row["full"]) / row["open"]
    target = F.least(F.col("weight") * F.lit(level), most * F.col("source_size"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``nth``, their place among equal rows. Equal rows are counted, with a combine before the shuffle, and made
    again from the count in blocks of CHUNK, so that no task holds all of a row that a third of the table repeats."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    last = F.col("times") - 1
    block = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor(last / CHUNK).cast("long"))))
    many = block.where(F.col("times") > CHUNK).repartition("block", *rows.columns)
    every = block.where(F.col("times") <= CHUNK).unionByName(many)
    first = F.col("block") * CHUNK
    return every.withColumn("nth", F.explode(F.sequence(first, F.least(first + CHUNK - 1, last)))).select(*rows.columns, "nth")


def _draw(row: int, level: int) -> float:
    digest = hashlib.blake2b(f"{row}:{level}".encode(), digest_size=8).digest()
    return (int.from_bytes(digest, "big") >> 11) / (1 << 53)


def pivot(rows: pd.DataFrame, level: int) -> pd.DataFrame:
    """Rounds the fractions of a chunk; at most one row stays unsettled (``open``)."""
    rows = rows.sort_values(["h", "row"], kind="stable").reset_index(drop=True)
    part, size, ids = rows["part"].to_numpy(float).copy(), rows["size"].to_numpy(float), rows["row"].to_numpy()
    held = -1
    for i in range(len(part)):
        if part[i] <= 0.0 or part[i] >= 1.0:
            continue
        if size[i] <= 0:
            part[i] = 0.0
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        # Words that can move from a to b, and from b to a, until one of them is 0 or 1.
        give = min(part[a] * size[a], (1 - part[b]) * size[b])
        take = min((1 - part[a]) * size[a], part[b] * size[b])
        if _draw(int(ids[b]), level) * (give + take) < take:  # a gives with probability take / (give + take)
            move = give
        else:
            move = -take
        pa_, pb = part[a] - move / size[a], part[b] + move / size[b]
        snap = lambda x: 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        part[a], part[b] = snap(pa_), snap(pb)
        held = a if 0.0 < part[a] < 1.0 else b if 0.0 < part[b] < 1.0 else -1
    rows["part"] = part
    rows["open"] = (part > 0.0) & (part < 1.0)
    return rows


def _pivot_at(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: pivot(rows, level)


def mix(sized: DataFrame, share: float = SHARE) -> DataFrame:
    """(the columns of ``sized``, source_size, target, copies, part) for rows with ``source`` and ``size``.

    copies: whole copies taken; part: the fraction that the last document of a source takes besides, else 0. Documents
    without words and null texts have size 0 and no copies; repeated rows are rows of their own; null is a source, the
    last one. Equal inputs give equal results: the draws hash the row's content and place among equal rows.
    """
    names = sized.columns
    goal = targets(sized.select("source", "size"), share)
    rows = (
        numbered(sized)
        .join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("h", F.xxhash64(*names, "nth"))
        .withColumn("copies", F.floor(F.col("e") + 1e-9).cast("long"))
        .withColumn("part", F.greatest(F.col("e") - F.col("copies"), F.lit(0.0)))
        .withColumn("part", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))
        .withColumn("row", F.col("h"))
        .withColumn("open", F.lit(True))
    )
    rows = rows.withColumn("chunks", F.ceil(F.col("n_docs") / CHUNK)).drop("n_docs")
    chunks = -(-(goal.agg(F.coalesce(F.max("n_docs"), F.lit(1))).first()[0]) // CHUNK)
    level, done = 0, None
    while True:
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(level)), F.col("chunks")))
        rounded = rows.groupBy("source", "chunk").applyInPandas(_pivot_at(level), rows.schema)
        rows = stored(rounded, f"pivot{level}")
        settled = rows if chunks <= 1 else rows.where(~F.col("open"))
        done = settled if done is None else done.unionByName(settled)
        if chunks <= 1:
            break
        chunks, level = -(-chunks // FANOUT), level + 1
        rows = rows.where("open").withColumn("chunks", F.ceil(F.col("chunks") / FANOUT))
    copies = F.col("copies") + F.when(F.col("part") >= 1.0, 1).otherwise(0)
    part = F.when(F.col("part") >= 1.0, 0.0).otherwise(F.col("part"))
    return done.select(*names, "source_size", "target", copies.cast("long").alias("copies"), part.alias("part"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", words().alias("size")))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size") + F.round(F.col("part") * F.col("size"))).cast("long").alias("taken"),
        "copies",
    )


def mix_documents(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents, each as often as the mix takes it; the partial one of a source counts when half of it is taken.

    Rows that are equal as a whole are one row with the sum of their copies; null texts have no words and aren't taken; a null
    doc_id is a value like any other; columns may have any names; an empty table gives an empty one.
    """
    plain, back = by_place(docs, "text", "source")
    # Rows that differ in any column have different keys; maps can't be hashed and are compared by their texts.
    parts = [F.to_json(F.col(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in plain.schema]
    keyed = plain.withColumns({"k1": F.xxhash64(*parts), "k2": F.xxhash64(F.lit(1), *[F.isnull(c) for c in plain.columns], *parts)})
    sized = stored(keyed.select("k1", "k2", "source", words().alias("size")), "sizes")
    taken = mix(sized, share).groupBy("k1", "k2").agg(F.sum(F.col("copies") + F.when(F.col("part") >= 0.5, 1).otherwise(0)).alias("times"))
    taken = stored(taken.where("times > 0"), "times")
    every = keyed.dropDuplicates(["k1", "k2"]).join(taken, ["k1", "k2"])
    return back(every.withColumn("k1", F.explode(F.sequence(F.lit(1), F.col("times")))))
