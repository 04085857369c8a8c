"""Repeated windows: what substring and suffix deduplication share.

A text is a sequence of 64-bit units (hashes of words, or of byte grams). Each window of ``window`` units has one anchor, the
smallest hash of ``gram`` units in it (see ``anchor_runs``), and the run of starts that share an anchor is a segment:
the starts lo..hi and the units from lo to hi + window. Segments partition the window starts, and equal windows lie in
segments of equal anchors at equal offsets from them. So

1. anchors that occur once in the corpus are dropped: their windows are unique;
2. of equal segments one represents all; further copies are repeats as a whole;
3. different segments of one anchor are compared, window by window, in a block of their own.

Only hashes and places are shuffled up to there. The units of a segment are shipped for step 3 alone, one copy of each
distinct segment whose anchor has several.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, whole

#: Segments of one anchor beyond which they are dealt by their content, too.
CROWD = 2_000
#: Starts in a part of a dealt segment.
STRIDE = 8

Segments = Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def keyed(docs: DataFrame) -> DataFrame:
    """kd, kt, text: a row's doc_id (null: the smallest long) and a hash of its text, and the text (null: empty).

    Rows that repeat both are one document.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("kd"), F.xxhash64(whole()).alias("kt"), whole().alias("text")
    )


def packed(rows: DataFrame) -> DataFrame:
    """kd, kt, z: the texts as compressed UTF-8, for a shuffle of a third of their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in chunks(batches):
            z = [squeeze(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("kd"), b.column("kt"), pa.array(z, pa.binary())], names=["kd", "kt", "z"])

    return rows.mapInArrow(run, "kd bigint, kt bigint, z binary")


def segments(rows: DataFrame, cut: Segments) -> DataFrame:
    """kd, kt, pos (of the anchor), lo, hi (first and last start, against the anchor), anchor, seg (hash of the units)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            kd, kt = b.column("kd").to_numpy(), b.column("kt").to_numpy()
            parts = [cut(t.encode()) for t in b.column("text").to_pylist()]
            n = np.array([len(p[0]) for p in parts])
            pos, lo, hi, anchor, seg = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(kd, n)),
                    pa.array(np.repeat(kt, n)),
                    *[pa.array(x.astype(np.int32)) for x in (pos, lo - pos, hi - pos)],
                    pa.array(anchor.view(np.int64)),
                    pa.array(seg.view(np.int64)),
                ],
                names=["kd", "kt", "pos", "lo", "hi", "anchor", "seg"],
            )

    return rows.mapInArrow(run, "kd bigint, kt bigint, pos int, lo int, hi int, anchor bigint, seg bigint")


def shared(found: DataFrame) -> DataFrame:
    """The segments whose anchor occurs more than once. Counts are combined before the shuffle, so that a hot anchor is
    one row a task; they are written first, so that both sides of the join back are exchanges, which Spark can split."""
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    return found.join(often, "anchor", "left_semi")


def distinct(some: DataFrame) -> DataFrame:
    """anchor, seg, lo, hi, n, kd, kt, pos (of the first occurrence), variants (different segments of the anchor)."""
    one = some.groupBy("anchor", "seg", "lo", "hi").agg(F.count("*").alias("n"), F.min(F.struct("kd", "pos", "kt")).alias("first"))
    one = one.select("anchor", "seg", "lo", "hi", "n", "first.kd", "first.kt", "first.pos")
    one = stored(one, "segments")
    variants = stored(one.groupBy("anchor").agg(F.count("*").alias("variants")), "variants")
    return one.join(variants, "anchor")


Units = Callable[[bytes], np.ndarray]


def shipped(different: DataFrame, texts: DataFrame, units: Units, window: int) -> DataFrame:
    """bucket, anchor, seg, lo, hi, kd, pos, units: the segments to compare, with their units, dealt into buckets.

    A bucket is an anchor. Segments of an anchor with more than CROWD of them are cut into parts of STRIDE starts, dealt by
    the hash of the units that all windows of the part share: equal windows have equal cores, so they meet all the same.
    """
    by_text = different.groupBy("kd", "kt").agg(
        F.collect_list(F.struct("anchor", "seg", "lo", "hi", "pos", (F.col("variants") > CROWD).alias("crowded"))).alias("wanted")
    )
    joined = by_text.join(texts, ["kd", "kt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        open_up = zstandard.ZstdDecompressor().decompress
        for b in chunks(batches, 100):
            rows = []
            for kd, wanted, z in zip(b.column("kd").to_pylist(), b.column("wanted").to_pylist(), b.column("z").to_pylist(), strict=True):
                line = units(open_up(z))
                for w in wanted:
                    lo, hi, pos = w["lo"], w["hi"], w["pos"]
                    if not w["crowded"]:
                        rows.append((w["anchor"], w["anchor"], w["seg"], lo, hi, kd, pos, line[pos + lo : pos + hi + window].tobytes()))
                        continue
                    for start in range(lo - lo % STRIDE, hi + 1, STRIDE):
                        a, e = max(lo, start), min(hi, start + STRIDE - 1)
                        core = line[pos + start + STRIDE - 1 : pos + start + window].tobytes()
                        bucket = xxhash.xxh64_intdigest(core, (w["anchor"] ^ start) & 0xFFFFFFFFFFFFFFFF)
                        bucket -= (bucket >> 63) << 64
                        rows.append((bucket, w["anchor"], w["seg"], a, e, kd, pos, line[pos + a : pos + e + window].tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "anchor", "seg", "lo", "hi", "kd", "pos", "units"]
            )

    return joined.mapInArrow(run, "bucket bigint, anchor bigint, seg bigint, lo int, hi int, kd bigint, pos int, units binary")


Block = Callable[[dict[str, list]], list[tuple[int, int, int]]]


def compared(sent: DataFrame, block: Block, limit: int = 1_500_000) -> DataFrame:
    """anchor, seg, a, b: runs of starts (against the anchor) that ``block`` reports for a segment.

    Buckets come in order, and whole buckets are gathered into blocks of about ``limit`` bytes.
    """
    names = ["bucket", "anchor", "seg", "lo", "hi", "kd", "pos", "units"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {c: [] for c in names}
        size, seen = 0, set()

        def done() -> Iterator[pa.RecordBatch]:
            hits = block(rows)
            at = np.array([h[0] for h in hits], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(rows["anchor"], np.int64)[at]),
                    pa.array(np.array(rows["seg"], np.int64)[at]),
                    pa.array([h[1] for h in hits], pa.int32()),
                    pa.array([h[2] for h in hits], pa.int32()),
                ],
                names=["anchor", "seg", "a", "b"],
            )

        for b in chunks(batches, 1000):
            columns = [b.column(c).to_pylist() for c in names]
            for row in zip(*columns, strict=True):
                if rows["bucket"] and row[0] != rows["bucket"][-1]:
                    seen.clear()
                    if size >= limit:
                        yield from done()
                        rows, size = {c: [] for c in names}, 0
                if row[2:7] in seen:  # a repeated row of the table
                    continue
                seen.add(row[2:7])
                for c, v in zip(names, row, strict=True):
                    rows[c].append(v)
                size += len(row[-1])
        if rows["bucket"]:
            yield from done()

    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "anchor bigint, seg bigint, a int, b int")


def repeated(docs: DataFrame, cut: Segments, units: Units, window: int, block: Block, all_but_first: bool) -> tuple[DataFrame, DataFrame]:
    """(texts, runs): the packed texts by kd, kt, and kd, kt, runs (array of (first, last) repeated window starts).

    all_but_first: a window's first occurrence isn't reported (and ``block`` doesn't report it); else all of them are.
    """
    rows = keyed(docs)
    texts = packed(rows)
    some = stored(shared(segments(rows, cut)), "shared")
    one = stored(distinct(some), "distinct")
    partial = stored(compared(shipped(one.where("variants > 1"), texts, units, window), block), "partial")
    spans = partial.groupBy("anchor", "seg").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    first = one.select("anchor", "seg", "lo", "hi", "n", F.struct("kd", "pos", "kt").alias("first")).join(spans, ["anchor", "seg"], "left")
    # Few rows have anything to say: copies, and segments with reported runs.
    telling = first.where("n > 1 or spans is not null")
    here = some.join(telling, ["anchor", "seg", "lo", "hi"])
    full = F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")))
    if all_but_first:
        is_first = F.col("first") == F.struct("kd", "pos", "kt")
        runs = F.when(is_first, F.col("spans")).otherwise(full)
    else:
        runs = F.when(F.col("n") > 1, full).otherwise(F.col("spans"))
    placed = here.select("kd", "kt", F.explode(runs).alias("r"), "pos").select(
        "kd", "kt", F.struct((F.col("pos") + F.col("r.a")).alias("a"), (F.col("pos") + F.col("r.b")).alias("b")).alias("run")
    )
    return texts, placed.groupBy("kd", "kt").agg(F.collect_set("run").alias("runs"))


def in_pieces(n_starts: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of window starts that are cut one by one, so that a very long text needs no more memory than a long one.

    Windows have their anchors from their own content, so the border of a range only cuts a segment in two.
    """
    for at in range(0, n_starts, size):
        yield at, min(n_starts, at + size)


def merged(runs: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal covered stretches [from, to) of the windows that start in ``runs``."""
    out: list[tuple[int, int]] = []
    for r in sorted((r["a"], r["b"]) for r in runs or ()):
        a, b = r[0], r[1] + window
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
