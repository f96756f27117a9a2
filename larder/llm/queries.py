"""The operators bound to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.bitslices import top_inner_products
from larder.llm.common import table
from larder.llm.conversations import repair_report
from larder.llm.covertree import embedding_groups
from larder.llm.forest import forest_neighbours
from larder.llm.licenses import license_scan
from larder.llm.mixing import scheduled
from larder.llm.onebit import hard_negatives
from larder.llm.packing import packed
from larder.llm.quality import quality_scores
from larder.llm.secrets import secret_scan
from larder.llm.sharding import interleaved_shards
from larder.llm.simhash import simhash_groups
from larder.llm.toxicity import toxicity_scores

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _on_embeddings(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "embeddings"))


def _with_labels(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _mixing(docs: DataFrame) -> DataFrame:
    return scheduled(docs.select("doc_id", "source"))


def _mined(vectors: DataFrame) -> DataFrame:
    """Hard negatives, where every seventh id has a label moved on by one."""
    moved = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")))


QUERIES: dict[str, Query] = {
    "op1_license_scan": _on_documents(license_scan),
    "op2_secret_scan": _on_documents(secret_scan),
    "op3_quality_classifier": _with_labels(quality_scores),
    "op4_interleaved_shards": _on_documents(interleaved_shards),
    "op5_forest_neighbours": _on_embeddings(forest_neighbours),
    "op6_best_fit_packing": _on_documents(packed),
    "op7_simhash_dedup": _on_documents(simhash_groups),
    "op8_pfair_mixing": _on_documents(_mixing),
    "op9_cover_tree_dedup": _on_embeddings(embedding_groups),
    "op10_compression_toxicity": _with_labels(toxicity_scores),
    "op11_hard_negatives": _on_embeddings(_mined),
    "op12_conversation_repair": lambda spark, sf_dir: repair_report(table(spark, sf_dir, "conversations")),
    "op13_bit_sliced_search": _on_embeddings(top_inner_products),
}
