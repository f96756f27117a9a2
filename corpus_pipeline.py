"""A training corpus from raw documents: filter, dedup, mask, mix, pack."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from larder.llm.mixing import ordered
from larder.llm.packing import packed
from larder.llm.quality import selected
from larder.llm.secrets import redacted
from larder.llm.simhash import deduplicated
from larder.session import fresh_dir, noted, remove

#: What the last stage of a thread's run stored on its way; the stage's result has been written when the next begins.
_LEFT: dict[tuple[int, str, str], list[str]] = {}


def _stage(build: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the stage before it stored."""

    @wraps(build)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = threading.get_ident(), spark.sparkContext.applicationId, sf_dir
        remove(spark, _LEFT.pop(key, []))
        with noted() as written:
            result = build(spark, docs, sf_dir)
        _LEFT[key] = written
        return result

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents whose expected grade is too low."""
    return selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles.

    Candidates come from fingerprints that differ in few bits and from equal
    minima of the shingles' hashes; each link is counted exactly.
    """
    return deduplicated(docs)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in the texts."""
    return redacted(docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order in which sources meet their target weights, kept as mix_order."""
    return ordered(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut into tokens and pack into sequences, numbered in the order of the mixture."""
    return packed(docs, order="mix_order")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: Hash shuffles, SimHash and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
