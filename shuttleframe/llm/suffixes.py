"""Suffix-array deduplication of byte strings, built blockwise with a difference cover (operator 4).

Removed are all bytes that a string of LENGTH bytes covers which also starts elsewhere. Suffixes that can't have such a
twin never reach the suffix array: those in segments whose anchor is unique in the corpus (see ``windows``). The others
are sorted one block of suffix buckets at a time, a bucket being an anchor and the offset of a suffix from it, so memory is
bounded by the block.

Within a block, suffixes at positions of a difference cover modulo V are ranked first, by prefix doubling. Any suffix is
then ordered by its first V bytes and, as long ties, by the rank of the cover sample at most V bytes further on: suffixes
of a bucket are laid out at equal residues, so that the same step leads each of them to its sample. Neighbours in the
order that agree in LENGTH bytes are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anchor_runs, chunks, documents, mix64
from .windows import in_pieces, merged, repeated

LENGTH = 200
#: Bytes of an anchor's gram: a power of two.
GRAM = 32
#: Modulus of the difference cover.
V = 32
PIECE = 1 << 20


def difference_cover(v: int) -> list[int]:
    """Residues whose differences are all residues modulo v, chosen greedily."""
    cover, missing = [0, 1], set(range(v)) - {0, 1, v - 1}
    while missing:
        gain = lambda c: len(missing & {x for d in cover for x in ((c - d) % v, (d - c) % v)})
        best = max(range(v), key=lambda c: (gain(c), -c))
        missing -= {x for d in cover for x in ((best - d) % v, (d - best) % v)}
        cover.append(best)
    return sorted(cover)


COVER = np.array(difference_cover(V))
IN_COVER = np.isin(np.arange(V), COVER)
#: By residue: the step to the next residue of the cover.
TO_COVER = np.array([next(k for k in range(V) if IN_COVER[(r + k) % V]) for r in range(V)])


def grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    return mix64(h)


def cut(text: bytes) -> tuple[np.ndarray, ...]:
    """Anchors, first and last starts, gram hashes and segment hashes of a text's windows."""
    out: list[tuple[np.ndarray, ...]] = []
    line = np.frombuffer(text, np.uint8)
    for a, b in in_pieces(len(text) - LENGTH + 1, PIECE):
        h = grams(line[a : b + LENGTH - 1])
        pos, lo, hi = anchor_runs(h, LENGTH - GRAM + 1)
        digest = xxhash.xxh3_64_intdigest
        seg = np.array([digest(text[a + x : a + y + LENGTH]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
        out.append((pos + a, lo + a, hi + a, h[pos], seg))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def suffix_order(text: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``at``, by bucket and then by content, to a depth of V + 8 V bytes at least.

    Suffixes of a bucket have positions of one residue modulo V. ``text`` ends in V x 9 zero bytes or more.
    """
    word = np.ndarray(len(text) - 7, ">u8", text, strides=(1,))
    n = len(text) - 8 * V
    samples = np.flatnonzero(IN_COVER[np.arange(n) % V])
    place = np.full(len(text) + 8 * V, -1, np.int64)
    place[samples] = np.arange(len(samples))

    def ranks(keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    rank = ranks([word[samples + k] for k in range(0, V, 8)])
    depth = V
    while depth < 8 * V:
        after = place[samples + depth]
        rank = ranks([rank, np.where(after >= 0, rank[after], -1)])
        depth *= 2
    step = TO_COVER[at % V]
    return np.lexsort((rank[place[at + step]], *[word[at + k] for k in range(V - 8, -1, -8)], bucket))


def block(rows: dict[str, list]) -> list[tuple[int, int, int]]:
    """(row, first, last) of the runs of starts whose LENGTH bytes another row has, too."""
    lo, hi = np.array(rows["lo"], np.int64), np.array(rows["hi"], np.int64)
    size = np.array([len(u) for u in rows["units"]], np.int64)
    base, at = np.empty(len(lo), np.int64), 0
    for i, (first, n) in enumerate(zip(lo.tolist(), size.tolist(), strict=True)):
        at += (first - at) % V  # a start's place has the residue of its offset from the anchor
        base[i] = at
        at += n
    text = np.zeros(at + 10 * V, np.uint8)
    for b, u in zip(base.tolist(), rows["units"], strict=True):
        text[b : b + len(u)] = np.frombuffer(u, np.uint8)
    n = hi - lo + 1
    row = np.repeat(np.arange(len(lo)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    places = base[row] + offset
    _, of = np.unique(np.array(rows["bucket"], np.int64), return_inverse=True)
    bucket = of[row] * 4 * LENGTH + (lo[row] + offset) + 2 * LENGTH
    order = suffix_order(text, places, bucket)
    a, b = order[:-1], order[1:]
    k = np.flatnonzero(bucket[a] == bucket[b])
    word = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    for d in range(0, LENGTH, 8):
        k = k[word[places[a[k]] + d] == word[places[b[k]] + d]]
    twin = np.zeros(len(row), bool)
    twin[a[k]] = twin[b[k]] = True
    return runs(twin, row, lo[row] + offset)


def runs(mark: np.ndarray, row: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, last) of the marked stretches; starts of a row are consecutive."""
    i = np.flatnonzero(mark)
    if not len(i):
        return []
    new = np.concatenate(([True], (np.diff(i) != 1) | (row[i[1:]] != row[i[:-1]])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    return list(zip(row[i[first]].tolist(), start[i[first]].tolist(), start[i[last]].tolist(), strict=True))


def without_repeats(docs: DataFrame, texts_too: bool = False) -> DataFrame:
    """kd, kt, n_bytes, n_removed, n_spans, kept_sha256, spans (removed, [from, to) in bytes) of every row.

    With ``kept`` (the remaining bytes) if asked for. Texts under LENGTH bytes, null and empty ones lose nothing; a
    repeated row is a copy like any other, so it is removed as a whole, and listed as often as it stands there.
    """
    texts, found = repeated(docs, cut, lambda raw: np.frombuffer(raw, np.uint8), LENGTH, block, all_but_first=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        for b in chunks(batches, 200):
            rows = []
            for z, r in zip(b.column("z").to_pylist(), b.column("runs").to_pylist(), strict=True):
                raw = open_up(z)
                spans = merged(r, LENGTH)
                edges = [0, *[x for s in spans for x in s], len(raw)]
                kept = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                spans_ = [{"a": x, "b": y} for x, y in spans]
                row = [len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans_]
                rows.append(row + [kept] * texts_too)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))] + [pa.binary()] * texts_too
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * texts_too]
            yield pa.RecordBatch.from_arrays([b.column("kd"), b.column("kt"), *arrays], names=["kd", "kt", *names])

    fields = "kd bigint, kt bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<a:int,b:int>>"
    return texts.join(found, ["kd", "kt"], "left").mapInArrow(run, fields + ", kept binary" * texts_too)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_ids(without_repeats(documents(spark, sf_dir)).drop("kt", "spans"))


def doc_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.when(F.col("kd") > F.lit(-(1 << 63)), F.col("kd"))).select(
        "doc_id", *[c for c in rows.columns if c != "kd"]
    )


