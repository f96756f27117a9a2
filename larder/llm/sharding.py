"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import RANK_BUCKETS, ranked, text_or_empty
from larder.session import stored

SHARDS = 24
SEED = 20_240


def interleaved_shards(docs: DataFrame, source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Each row's shard and slot, every shard with the mixture of the whole.

    The rows of a source are shuffled by a seeded hash and ranked; a row's
    fraction is its rank over its source's size, so sorting all rows by it
    spreads each source evenly, and cutting that order into equal runs gives
    each shard every source's share to within a row or two.  Shard sizes differ
    by one row at most.

    Ranks are taken in hash ranges of a source, then in ranges of the fraction,
    so a source with a third of all rows is no task of its own.  Null sources
    are one source of their own, null texts empty; repeated rows are dealt out
    one by one; an empty table gives no rows.
    """
    text = text_or_empty()
    shuffled = F.xxhash64(F.lit(seed), "doc_id", F.crc32(text.cast("binary")))
    sized = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_source"),
            shuffled.alias("_hash"),
        ).withColumn("_range", F.shiftrightunsigned("_hash", 54)),
        "sized",
    )
    total = sized.count()
    of_source = sized.groupBy("_source").agg(F.count(F.lit(1)).alias("_of"))
    inside = ranked(sized, ["_source"], "_range", ["_hash", "doc_id", "text_crc32", "size"], "_rank")
    fraction = ((F.col("_rank") + 0.5) / F.col("_of")).alias("_fraction")
    spread = stored(
        inside.join(of_source, "_source")
        .select("doc_id", "size", "text_crc32", "_source", "_hash", fraction)
        .withColumn("_run", F.floor(F.col("_fraction") * RANK_BUCKETS)),
        "spread",
    )
    placed = ranked(spread, [], "_run", ["_fraction", "_hash", "_source", "doc_id", "text_crc32", "size"], "_at")
    shard = F.expr(f"int((_at * {shards}L) div {max(total, 1)}L)")
    begins = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_at") - begins).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
