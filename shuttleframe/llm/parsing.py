"""Document fingerprints by locally consistent parsing (operator 2).

Each level turns a sequence of symbols into a shorter sequence of phrase names. Runs of one symbol collapse first, so that
neighbours differ. Deterministic coin tossing then labels each symbol by the lowest bit in which it differs from its left
neighbour, which shrinks the alphabet to six labels in a few rounds; these are reduced to three, and symbols whose label is
a local maximum begin phrases. Whether a symbol begins one depends on a few neighbours only, so equal substrings are cut
alike inside, wherever they stand, and a phrase's name is a hash of its symbols.

A fingerprint holds, for each level, the smallest hashes of the distinct phrase names and their number. Documents are
parsed together, many in one array; fixed guard symbols between them keep every document's result its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, mix64, partitions, texts, whole

LEVELS = 4
#: Smallest hashes that a level keeps.
SKETCH = 32
#: Fewest phrases that a level must have for it to be compared by.
ENOUGH = 12
#: Characters that are parsed together, about; a longer text is parsed alone.
TOGETHER = 200_000

U = np.uint64
# Guards: constants beyond all code points, each different from its neighbours.
BEFORE = mix64(np.arange(1, 9, dtype=U))
AFTER = mix64(np.arange(11, 15, dtype=U))


def _low_bit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 x (lowest bit in which a and b differ) + that bit of a."""
    x = a ^ b
    low = x & (~x + U(1))
    at = np.bitwise_count(low - U(1)).astype(U) & U(63)
    return U(2) * at + ((a >> at) & U(1))


def _starts(sym: np.ndarray) -> np.ndarray:
    """Which of the (guarded) symbols begin a phrase; no symbol equals its left neighbour."""
    label = sym
    for _ in range(4):  # 64 bits: labels below 128, 14, 8, 6
        label = np.concatenate((label[:1] & U(1), _low_bit(label[1:], label[:-1])))
    label = label.astype(np.int8)
    for c in (5, 4, 3):
        at = np.flatnonzero(label[1:-1] == c) + 1
        a, b = label[at - 1], label[at + 1]
        label[at] = np.where((a != 0) & (b != 0), 0, np.where((a != 1) & (b != 1), 1, 2))
    out = np.zeros(len(sym), bool)
    out[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    return out


def parse(lengths: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level for many documents: (lengths, names) of their phrases."""
    lengths = np.asarray(lengths, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    n = len(symbols)
    if not n:
        return lengths, symbols
    # Runs of one symbol become one symbol that also tells the run's length.
    head = np.ones(n, bool)
    head[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    run = np.diff(np.append(at, n)).astype(U)
    sym, doc = symbols[at], doc[at]
    sym = np.where(run > 1, mix64(sym + mix64(run)), sym)
    # Guards between the documents; the rest of the level doesn't see its neighbours' symbols.
    guard = len(BEFORE) + len(AFTER)
    where = np.arange(len(sym)) + doc * guard + len(BEFORE)
    count = np.bincount(doc, minlength=len(lengths))
    base = np.concatenate(([0], np.cumsum(count + guard)))[:-1]
    line = np.empty(len(sym) + guard * len(lengths), U)
    line[where] = sym
    line[(base[:, None] + np.arange(len(BEFORE)))] = BEFORE
    line[(base + len(BEFORE) + count)[:, None] + np.arange(len(AFTER))] = AFTER
    start = _starts(line)[where]
    start[np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))] = True
    first = np.flatnonzero(start)
    place = np.arange(len(sym)) - np.repeat(first, np.diff(np.append(first, len(sym))))
    names = mix64(np.add.reduceat(mix64(sym + place.astype(U) * U(0x9E3779B97F4A7C15)), first)) if len(first) else sym[:0]
    return np.bincount(doc[first], minlength=len(lengths)), names


def sketches(some: list[str]) -> list[list[np.ndarray]]:
    """For each text, each level's sorted smallest hashes (32 bits, at most SKETCH) of distinct names."""
    lengths = np.array([len(t) for t in some], np.int64)
    symbols = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    symbols = mix64(symbols + U(1))
    out: list[list[np.ndarray]] = [[] for _ in some]
    for level in range(LEVELS):
        lengths, symbols = parse(lengths, symbols)
        small = (mix64(symbols + U(level + 1)) >> U(32)).astype(np.uint32)
        ends = np.cumsum(lengths)
        for i, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
            part = small[a:b]
            if len(part) > 8 * SKETCH:
                # The smallest, with room for repeats; if repeats fill it, all are looked at.
                few = np.unique(np.partition(part, 4 * SKETCH)[: 4 * SKETCH])
                part = few if len(few) >= SKETCH else np.unique(part)
            else:
                part = np.unique(part)
            out[i].append(part[:SKETCH])
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Estimated share of common phrases, at the highest level where both have ENOUGH; 1 for equal fingerprints.

    The top level has a phrase for some hundred characters and more, so an edit in the middle of a text changes most of what
    it has; comparisons begin one level below.
    """
    for level in range(LEVELS - 2, -1, -1):
        x, y = a[level], b[level]
        if min(len(x), len(y)) >= ENOUGH or level == 0:
            break
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.union1d(x, y)
    if len(x) >= SKETCH or len(y) >= SKETCH:
        both = both[:SKETCH]
    return float(np.isin(both, np.intersect1d(x, y)).mean())


def text_of(sketch: list[np.ndarray]) -> str:
    """The fingerprint as text: each level's hashes in hexadecimal, levels joined by a dot."""
    return ".".join(level.astype(">u4").tobytes().hex() for level in sketch)


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by as many first ones (or all) of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text of the next document in descending doc_id (after the last one, the first).

    One shuffle of the texts: rows go to ranges of doc_id, and the first rows of each range also go to the range before as
    look-ahead, so that a window within a range sees every successor. Range bounds are quantiles, heads one row a range.
    Rows with one doc_id are ordered by text; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole().alias("text"))
    ranges = 4 * partitions(spark)
    cuts = sorted(set(rows.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    # 0 has the largest ids, the last range the nulls.
    n = len(cuts)
    slot = F.when(F.col("doc_id").isNull(), n + 1).otherwise(n - F.size(F.filter(bounds, lambda b: F.col("doc_id") >= b)))
    if n > 64:
        slot = _slot_by_search(cuts, slot)
    heads = (
        rows.select("doc_id", slot.alias("slot")).groupBy("slot").agg(F.max("doc_id").alias("head")).orderBy("slot").collect()
    )
    # At most ranges + 1 rows.
    if not heads:
        return rows.withColumn("next_text", F.lit(""))
    previous = {h["slot"]: heads[i - 1]["slot"] for i, h in enumerate(heads)}
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("slot")]
    slotted = rows.withColumn("slot", slot)
    head_of = {h["slot"]: h["head"] for h in heads if h["head"] is not None}
    is_head = F.col("doc_id").eqNullSafe(of(head_of)) if head_of else F.col("doc_id").isNull()
    ahead = F.struct(of(previous).alias("slot"), F.lit(1).alias("ahead"))
    own = F.struct(F.col("slot").alias("slot"), F.lit(0).alias("ahead"))
    sent = slotted.withColumn("to", F.explode(F.when(is_head, F.array(own, ahead)).otherwise(F.array(own)))).select("doc_id", "text", "to.slot", "to.ahead")
    order = Window.partitionBy("slot").orderBy("ahead", F.col("doc_id").desc_nulls_last(), "text")
    return sent.withColumn("next_text", F.lead("text").over(order)).where("ahead = 0").drop("slot", "ahead")


def _slot_by_search(cuts: list[float], plain):
    """The slot by a two-step search: a few comparisons instead of one for every bound."""
    n, step = len(cuts), 32
    coarse = F.array(*[F.lit(c) for c in cuts[::step]])
    blocks = F.array(*[F.array(*[F.lit(c) for c in cuts[i : i + step]]) for i in range(0, n, step)])
    k = F.size(F.filter(coarse, lambda b: F.col("doc_id") >= b))
    inside = F.size(F.filter(F.element_at(blocks, F.greatest(k, F.lit(1))), lambda b: F.col("doc_id") >= b))
    return F.when(F.col("doc_id").isNull(), n + 1).when(k == 0, n).otherwise(n - ((k - 1) * step + inside))


def fingerprints(pairs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of (doc_id, text, next_text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[np.ndarray]] = {}
        for b in batches:
            ids, here, after = b.column("doc_id"), texts(b), texts(b, "next_text")
            at = 0
            while at < len(here):
                stop, size = at, 0
                while stop < len(here) and (size < TOGETHER or stop == at):
                    size += 2 * len(here[stop])
                    stop += 1
                changed = [edited(t, n) for t, n in zip(here[at:stop], after[at:stop], strict=True)]
                want = dict.fromkeys([*here[at:stop], *changed, *after[at:stop]])
                new = [t for t in want if t not in memory]
                known = memory | dict(zip(new, sketches(new), strict=True)) if new else memory
                rows = [(known[t], known[c], known[n]) for t, c, n in zip(here[at:stop], changed, after[at:stop], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, stop - at),
                        pa.array([len(t) for t in here[at:stop]], pa.int64()),
                        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
                        pa.array([text_of(x) for x, _, _ in rows]),
                        pa.array([text_of(y) for _, y, _ in rows]),
                        pa.array([likeness(x, y) for x, y, _ in rows], pa.float64()),
                        pa.array([likeness(x, z) for x, _, z in rows], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                memory = {after[stop - 1]: known[after[stop - 1]]}  # the next row's text, as rows come in order
                at = stop

    return pairs.mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op2_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(with_next(documents(spark, sf_dir)))
