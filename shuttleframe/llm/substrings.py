"""Substring deduplication by seed and extend (operator 9).

Seeds are winnowed anchors of GRAM words that several segments of the corpus share (see ``windows``). Their occurrences
are joined on the anchor and extended both ways, word by word: after each word the occurrences that still agree form a
class, so that all matches of a seed are extended together and no pair is listed. A class whose left and right extensions
make a window of LENGTH words is a repeat; consecutive windows are one maximal repeat. All but the first occurrence,
by doc_id and place, are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import anchor_runs, chunks, documents, mix64
from .suffixes import doc_ids
from .windows import in_pieces, merged, repeated

LENGTH = 20
GRAM = 4
PIECE = 1 << 18


def units(text: bytes) -> np.ndarray:
    """XXH64 of each word."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.split()], np.uint64)


def cut(text: bytes) -> tuple[np.ndarray, ...]:
    """Anchors, first and last starts, gram hashes and segment hashes of a text's windows of words."""
    line, out = units(text), []
    for a, b in in_pieces(len(line) - LENGTH + 1, PIECE):
        part = line[a : b + LENGTH - 1]
        h = part
        for width in (1, 2):
            h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]
            h = h ^ (h >> np.uint64(31))
        h = mix64(h)
        pos, lo, hi = anchor_runs(h, LENGTH - GRAM + 1)
        raw, digest = part.tobytes(), xxhash.xxh3_64_intdigest
        seg = np.array([digest(raw[8 * x : 8 * (y + LENGTH)]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
        out.append((pos + a, lo + a, hi + a, h[pos], seg))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def classes(*keys: np.ndarray) -> np.ndarray:
    """A number for each different combination of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def block(rows: dict[str, list]) -> list[tuple[int, int, int]]:
    """(row, first, last) of the runs of starts whose window another row has at an earlier place."""
    n = len(rows["lo"])
    lo, hi = np.array(rows["lo"], np.int64), np.array(rows["hi"], np.int64)
    kd, pos = np.array(rows["kd"], np.int64), np.array(rows["pos"], np.int64)
    # Words around the anchor: column LENGTH - GRAM + i holds the word i places after the anchor's first.
    most = LENGTH - GRAM
    words, there = np.zeros((n, most + LENGTH), np.uint64), np.zeros((n, most + LENGTH), bool)
    for i, raw in enumerate(rows["units"]):
        line = np.frombuffer(raw, np.uint64)
        at = most + rows["lo"][i]
        words[i, at : at + len(line)] = line
        there[i, at : at + len(line)] = True
    # The crowded parts of a segment may end before the anchor does; what is missing is no class of its own, as windows
    # of such a part never reach there.
    seed = np.array(rows["bucket"], np.int64)
    for i in range(GRAM):
        seed = classes(seed, words[:, most + i], there[:, most + i])
    left, right = [seed], [seed]
    for i in range(1, most + 1):
        left.append(classes(left[-1], words[:, most - i], there[:, most - i]))
        right.append(classes(right[-1], words[:, most + GRAM - 1 + i], there[:, most + GRAM - 1 + i]))
    hits: list[tuple[int, int]] = []
    for back in range(most + 1):
        has = np.flatnonzero((lo <= -back) & (hi >= -back))
        if len(has) < 2:
            continue
        same = classes(left[back][has], right[most - back][has])
        order = np.lexsort((pos[has], kd[has], same))
        first = np.ones(len(order), bool)
        first[1:] = same[order][1:] != same[order][:-1]
        hits += [(int(r), -back) for r in has[order[~first]]]
    hits.sort()
    out: list[tuple[int, int, int]] = []
    for r, d in hits:
        if out and out[-1][0] == r and out[-1][2] == d - 1:
            out[-1] = (r, out[-1][1], d)
        else:
            out.append((r, d, d))
    return out


def without_repeats(docs: DataFrame, texts_too: bool = False) -> DataFrame:
    """kd, kt, n_words, n_removed, kept_sha256, spans (removed, [from, to) in words) of every row.

    With ``kept`` (the remaining words, joined by a space) if asked for. Texts under LENGTH words, null and empty ones lose
    nothing. A null doc_id counts as the smallest; rows that repeat a doc_id and its text are one document,
    listed as often as it stands there.
    """
    texts, found = repeated(docs, cut, units, LENGTH, block, all_but_first=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        for b in chunks(batches, 200):
            rows = []
            for z, r in zip(b.column("z").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = open_up(z).split()
                spans = merged(r, LENGTH)
                edges = [0, *[x for s in spans for x in s], len(words)]
                kept = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
                line = b" ".join(kept)
                row = [len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), [{"a": x, "b": y} for x, y in spans]]
                rows.append(row + [line] * texts_too)
            kinds = [pa.int64()] * 2 + [pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))] + [pa.binary()] * texts_too
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            names = ["n_words", "n_removed", "kept_sha256", "spans", *["kept"] * texts_too]
            yield pa.RecordBatch.from_arrays([b.column("kd"), b.column("kt"), *arrays], names=["kd", "kt", *names])

    fields = "kd bigint, kt bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<a:int,b:int>>"
    return texts.join(found, ["kd", "kt"], "left").mapInArrow(run, fields + ", kept binary" * texts_too)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_ids(without_repeats(documents(spark, sf_dir)).drop("kt", "spans"))
