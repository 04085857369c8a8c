"""Places and running sums within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import partitions, stored


def scan(rows: DataFrame, group: str, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``place`` (from 1) among the rows of their group (a long, never null) in the given order, and for each long
    column x of ``sums`` the sums ``x_before`` and ``x_to`` without and with the row itself, modulo 2^64.

    Ranges of the sorted rows are summed side by side and written; a group that goes over several ranges is shifted in each by
    what its earlier ranges hold. The driver sees two groups and one set of totals a range, so a group may be any share of the
    table.
    """
    names = ["place", *[f"{s}_{w}" for s in sums for w in ("before", "to")]]
    added = [StructField(n, LongType()) for n in names]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    ranged = ranged.withColumn("__part", F.spark_partition_id())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [np.uint64(0)] * (1 + len(sums))
        for b in batches:
            if not (n := b.num_rows):
                continue
            g = b.column(group).to_numpy()
            new = np.concatenate(([last is None or g[0] != last], g[1:] != g[:-1]))
            starts, which = np.flatnonzero(new), np.cumsum(new) - 1
            out, last = [], g[-1]
            for k, s in enumerate(("", *sums)):
                own = b.column(s).to_numpy().astype(np.int64).view(np.uint64) if s else np.ones(n, np.uint64)
                total = np.cumsum(own, dtype=np.uint64)
                off = np.full(n, np.uint64(0) - carry[k] if carry[k] else np.uint64(0))
                if len(starts):
                    off[starts[0] :] = (total - own)[starts[which[starts[0] :]]]
                to = total - off
                carry[k] = to[-1]
                out += [(to - own).view(np.int64), to.view(np.int64)] if s else [to.view(np.int64)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x) for x in out]], names=[*b.schema.names, *names])

    local = stored(ranged.mapInArrow(summed, StructType([*ranged.schema.fields, *added])), "scan")
    totals = ["place", *[f"{s}_to" for s in sums]]
    ends = local.groupBy("__part").agg(
        F.min(group).alias("first"), F.max(group).alias("last"), F.max_by(F.array(*totals), F.struct(group, "place")).alias("totals")
    )
    shifts: dict[int, tuple[int, list[int]]] = {}
    held: tuple[int | None, list[int]] = (None, [])
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        if r["first"] == held[0]:
            shifts[r["__part"]] = held
        sofar = held[1] if r["last"] == held[0] else [0] * len(totals)
        held = (r["last"], [(a + b) % (1 << 64) for a, b in zip(sofar, r["totals"], strict=True)])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, g = b.column("__part").to_numpy(), b.column(group).to_numpy()
            columns = {n: b.column(n) for n in b.schema.names}
            for p in np.unique(part):
                if int(p) in shifts:
                    of, by = shifts[int(p)]
                    mine = (part == p) & (g == of)
                    for s, add in zip(("", *sums), by, strict=True):
                        for n in (f"{s}_before", f"{s}_to") if s else ("place",):
                            x = columns[n].to_numpy().view(np.uint64).copy()
                            x[mine] += np.uint64(add)
                            columns[n] = pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([columns[f] for f in kept], names=kept)

    kept = [*rows.columns, *names]
    return local.mapInArrow(shifted, StructType([f for f in local.schema.fields if f.name in kept]))
