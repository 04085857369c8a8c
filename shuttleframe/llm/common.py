"""Helpers that the training-data operators share.

Word class of every contract: maximal runs of characters other than space and U+0009..U+000D, which is what
``bytes.split()`` gives on UTF-8.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is configured (tests)."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shuttleframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: On paths of a local or mounted file system: no checksum file beside each file. Hadoop starts a process for every permission
#: that it sets there, four a file with checksums and one without. Stores with a scheme of their own aren't concerned. Nobody asks
#: for the file that marks a table as complete: it is read only once its writer has returned.
PLAIN_LOCAL_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **PLAIN_LOCAL_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def by_place(docs: DataFrame, *named: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns renamed __0, __1, ..., and the ``named`` ones under their names besides; and the way back, which
    takes the names in ``named`` as the values of their columns. So columns may have any names."""
    names = docs.columns
    plain = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"__{i}") for i, c in enumerate(names) if c not in named], *[F.col(c) for c in named])
    return plain, lambda df: df.select(*[F.col(c if c in named else f"__{i}").alias(c) for i, c in enumerate(names)])


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i, in a fixed number of passes whatever w is (block-wise prefix and suffix minima)."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


POS_BITS = np.uint64(28)
POS_MASK = np.uint64((1 << 28) - 1)


def anchor_runs(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: the position of the smallest hash in each window of ``w`` hashes, the last one of equals.

    Returns the anchors, and for each the first and last window start that it wins. Each window has one anchor, at a
    place that only the window's own content decides, so equal windows have equal anchors at equal offsets.
    """
    n = len(h)
    if n >= 1 << 28:
        raise ValueError("a text of 2^28 units or more must be cut before winnowing")
    key = (h & ~POS_MASK) | (POS_MASK - np.arange(n, dtype=np.uint64))
    at = (POS_MASK - (sliding_min(key, w) & POS_MASK)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.concatenate((first[1:], [len(at)])) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def record_batches(schema: pa.Schema, columns: dict[str, list | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller pieces of the batches, so that one piece's working arrays stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
