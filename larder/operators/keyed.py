"""Appends, replacements and updates by primary key, and new surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.verdict import MISSING_KEY, REASON, Verdict, reject_taken_keys
from larder.session import stored
from larder.sources.keytable import KeyTable

# monotonically_increasing_id() keeps the partition number above this bit and
# the row number inside the partition below it.
_ROW_BITS = 33


def append_keyed(existing: DataFrame, new: DataFrame, pk: str, seq: str = "seq") -> Verdict:
    """Rows of ``new`` whose key is neither stored nor used earlier in the batch."""
    return Verdict(reject_taken_keys(new, existing, pk, seq))


def last_per_key(rows: DataFrame, pk: str, seq: str) -> DataFrame:
    """The newest row of each key; ``seq`` is unique for a key.

    The largest sequence comes from a hash aggregation, combined before the
    shuffle.  Rows find it by joining on (key, sequence), so a key that fills
    much of the batch never meets in one task and its rows are not sorted.
    """
    newest = rows.where(F.col(pk).isNotNull()).groupBy(pk).agg(F.max(seq).alias(seq))
    columns = [c for c in rows.columns if c not in (pk, seq)]
    return rows.join(newest, [pk, seq], "left_semi").select(pk, *columns)


def missing_keys(rows: DataFrame, pk: str) -> DataFrame:
    """The rows that no keyed write takes, as they have no key, with the reason."""
    return rows.where(F.col(pk).isNull()).withColumn(REASON, F.lit(MISSING_KEY))


def upsert(existing: DataFrame, new: DataFrame, pk: str, seq: str = "seq") -> DataFrame:
    """Replace the rows with the same key and add the others; the last one wins.

    Rows of ``new`` without a key are refused: `missing_keys` gives them.
    """
    new = new.where(F.col(pk).isNotNull())
    newest = last_per_key(new, pk, seq).select(existing.columns)
    kept = existing.join(new.select(pk).distinct(), pk, "left_anti")
    return kept.select(existing.columns).unionByName(newest)


def update_by_key(
    existing: DataFrame, changes: DataFrame, pk: str, cols: Sequence[str], seq: str = "seq"
) -> DataFrame:
    """Set ``cols`` on the rows whose key occurs in ``changes``; the last change wins.

    A matched flag, not ``coalesce``, decides: a change may set NULL.
    """
    newest = last_per_key(changes.select(pk, seq, *cols), pk, seq)
    newest = newest.select(pk, F.struct(*cols).alias("_change"))
    joined = existing.join(newest, pk, "left")
    changed = F.col("_change").isNotNull()
    return joined.select(
        [
            F.when(changed, F.col("_change")[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in existing.columns
        ]
    )


def append_to_key_table(keys: KeyTable, new: DataFrame, seq: str = "seq") -> Verdict:
    """`append_keyed` where the stored keys are in buckets: they are neither shuffled nor, for a small batch, all read.

    ``keys.add`` takes the accepted rows once they are stored.
    """
    return Verdict(reject_taken_keys(new, keys.keys_for(new), keys.key, seq))


def next_id(existing: DataFrame, column: str) -> DataFrame:
    """One row: the largest key plus one, or 1 for an empty table."""
    return existing.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("bigint").alias("NextID"))


def assign_ids(
    existing: DataFrame | None,
    new: DataFrame,
    column: str,
    order: Sequence[str],
) -> DataFrame:
    """Give the new rows consecutive keys after the largest stored one.

    ``order`` must identify a row.  The rows are range partitioned and sorted,
    and each gets its place inside its partition; the result is stored, so that
    a lost executor cannot renumber it.  What the driver sees is one
    row count per partition.
    """
    spark = new.sparkSession
    order = list(order)
    placed = stored(
        new.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftrightunsigned("_place", _ROW_BITS)
    sizes = sorted(placed.groupBy(part.alias("_part")).count().collect())
    # One aggregate row; with no table given the ids start at 1.
    start = 0 if existing is None else existing.agg(F.max(column)).first()[0] or 0
    offsets = []
    for number, size in sizes:
        offsets.append((number, start + 1))
        start += size
    starts = spark.createDataFrame(offsets, "_part bigint, _start bigint")
    inside = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per partition: its size is that of the partition list, not the data.
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    kept = [c for c in new.columns if c != column]
    return numbered.select((F.col("_start") + inside).cast("bigint").alias(column), *kept)
