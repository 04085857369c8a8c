"""Best-fit packing by minimum bin slack (operator 3).

Documents are tokenised and cut into pieces of at most CAPACITY tokens. Which pieces share a sequence depends on lengths
alone, so the plan is made over the histogram of lengths, which has at most CAPACITY entries whatever the corpus holds: the
longest open length starts a bin, a bitset subset-sum over the available lengths finds the fullest combination that
fits beside it, and the combination is removed as often as its lengths last (equal histograms have equal fullest
combinations, so this is the same as removing it bin by bin). Every combination uses a length up or nearly so, which
bounds the plan by the histogram, too.

Pieces find their places by rank among the pieces of their length. Ranks are counted in salted parts of a length and
shifted by the parts before, so that a length that a third of all pieces have is no single task's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, documents, partitions, stored, texts, whole
from .tokens import word_bpe

CAPACITY = 4096
#: The id that ends each document.
END = 1
#: Words that a worker remembers the ids of, at most.
REMEMBERED = 400_000


def pieces(docs: DataFrame, tokenizer: str, keep: list[str], capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``keep`` columns, piece, start, length, ids_crc32 of every piece; null and empty texts are one piece, the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(tokenizer, REMEMBERED)
        for b in chunks(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts(b)):
                ids = encode(text) + end.to_bytes(4, "little")
                n = len(ids) // 4
                for k in range(0, n, capacity):
                    part = ids[4 * k : 4 * (k + capacity)]
                    at.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            rows = pa.array(at, pa.int64())
            arrays = [b.column(i).take(rows) for i in range(len(keep))]
            arrays += [pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "piece", "start", "length", "ids_crc32"])

    kept = docs.select(*keep, whole().alias("text"))
    types = dict(kept.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return kept.mapInArrow(run, fields + ", piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: list[int], lengths: list[int], room: int) -> list[int]:
    """Lengths (with repeats, each at most as often as counts says) with the largest sum up to ``room``.

    ``lengths``: those with a count, descending. Bit s of a set says that some of the lengths so far sum to s.
    """
    sets, items, reach, mask = [], [], 1, (1 << (room + 1)) - 1
    goal = 1 << room
    for length in lengths:
        if length > room:
            continue
        left, step = min(counts[length], room // length), 1
        while left > 0:
            step = min(step, left)
            sets.append(reach)
            items.append((length, step))
            reach |= (reach << (length * step)) & mask
            left, step = left - step, 2 * step
            if reach & goal:
                left = 0
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, []
    for before, (length, n) in zip(reversed(sets), reversed(items), strict=True):
        if not before >> total & 1:
            chosen += [length] * n
            total -= length * n
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Segments (length, rank, n, per_bin, bin, offset): pieces of a length with ranks from ``rank`` on, n of them, go to
    bins from ``bin`` on, per_bin in each, one after another from ``offset``."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] += n
    used, first_bin, out = [0] * (capacity + 1), 0, []
    lengths = [x for x in range(capacity, 0, -1) if counts[x]]
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        bin_of = [longest, *fullest(counts, [x for x in lengths if counts[x]], capacity - longest)]
        counts[longest] += 1
        need: dict[int, int] = {}
        for x in bin_of:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        offset = 0
        for x, n in need.items():
            out.append((x, used[x], times * n, n, first_bin, offset))
            offset += x * n
            used[x] += times * n
            counts[x] -= times * n
        first_bin += times
        lengths = [x for x in lengths if counts[x]]
    return pd.DataFrame(out, columns=["length", "rank", "n", "per_bin", "bin", "offset"])


def pack(cut: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``cut`` (with ``length``, 1 to capacity) with sequence_id and offset.

    ``order``: columns that tell rows apart; rows that are equal in them get different places all the same. An empty table
    gives an empty one.
    """
    spark = cut.sparkSession
    salts = max(1, partitions(spark))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    parts = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "parts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = plan(histogram, capacity).sort_values(["length", "rank"])
    key = segments["length"].to_numpy(np.int64), segments["rank"].to_numpy(np.int64)
    per_bin, first_bin, offset = (segments[c].to_numpy(np.int64) for c in ("per_bin", "bin", "offset"))
    sent = spark.sparkContext.broadcast((*key, per_bin, first_bin, offset))
    ranked = salted.join(shifts, ["length", "salt"]).withColumn(
        "rank", F.col("shift") + F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1
    )
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_at, rank_at, per, bins, offsets = sent.value
        low = np.searchsorted(length_at, np.arange(capacity + 2))
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            by = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[by], prepend=-1))
            for e, stop in zip(edges, [*edges[1:], len(by)], strict=True):
                x, rows = length[by[e]], by[e:stop]
                at[rows] = low[x] + np.searchsorted(rank_at[low[x] : low[x + 1]], rank[rows], "right") - 1
            index = rank - rank_at[at]
            seq, place_in = bins[at] + index // per[at], offsets[at] + index % per[at] * length
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(seq), pa.array(place_in)], names=[*names, "sequence_id", "offset"]
            )

    types = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return ranked.select(*names, "rank").mapInArrow(place, types + ", sequence_id bigint, offset bigint")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    cut = stored(pieces(docs, tokenizer, ["doc_id"], capacity), "pieces")
    return pack(cut, ["doc_id", "piece", "ids_crc32"], capacity)
