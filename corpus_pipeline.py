"""The training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents; the last returns the
packed pieces. None of the stages can be expressed in SQL, so ORACLE_SQL is None and tests hold them against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilstream.llm.common import cut, table
from veilstream.llm.mixing import mixed
from veilstream.llm.near_dedup import deduplicated
from veilstream.llm.packing import pack
from veilstream.llm.quality_net import accepted
from veilstream.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in the order of training."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("near dedup", near_dedup), ("secret scans", secrets), ("mixing", mixing), ("best-fit packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
