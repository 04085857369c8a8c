"""Tables that cut the lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group.
GROUP = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local master may do with one of its own."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.gettempdir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts the lineage: a Parquet table in the shared folder, read back. A reader's batch is a row group at most, so rows with large
    values need small groups: some megabytes, looked at after every few rows."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.block.size", GROUP).option("parquet.page.size.row.check.min", 16).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """A table that grows with the input, where it is joined with another one that does. Spark takes it for as small as its file, some six to ten bytes
    a row, and would send a million rows by way of the driver; marked so, both are shuffled."""
    return df.hint("merge")
