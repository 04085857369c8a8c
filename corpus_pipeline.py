"""Corpus pipeline: documents to packed training sequences.

Stages, in order: toxic documents go (CRF scores), one document of each group of SimHash near-duplicates stays, live-looking
secrets are overwritten, sources are mixed to their target weights, and documents are packed into sequences. Each stage's
result is a Parquet table, which the next one reads. Stages but the last keep the columns of documents, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shuttleframe.llm.common import stored
from shuttleframe.llm.mixing import mix_documents
from shuttleframe.llm.packing import pack_documents, tokenizer_path
from shuttleframe.llm.secrets import redact
from shuttleframe.llm.simhash import drop_near_duplicates
from shuttleframe.llm.toxicity import drop_toxic

#: None: model scores, hashes and rounding draws aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
