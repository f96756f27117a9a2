"""What several operators share: table reading, ranks without a hot task, valid vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANK_BUCKETS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """CRC-32 of an id's decimal text."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def ranked(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the 0-based place ``name`` of each row in its group, by (bucket, order).

    ``bucket`` cuts a group into ranges of its order, so that no task holds a
    whole group: rows are numbered in their bucket, and buckets are offset by
    the counts of those before.  ``df`` is read twice: give a stored one.
    ``group`` and ``bucket`` hold no nulls.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, keys)
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_start", "_place")
    )


def valid_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that can be compared.

    Left out: null ids; vectors that are null, empty or zero, or hold null or
    non-finite components; vectors of another length than most have (ties: the
    longest).
    """
    number = F.col(vector).cast("array<double>")
    good = (
        df.select(F.col(id_column).cast("long").alias("vec_id"), number.alias("vector"))
        .where("vec_id IS NOT NULL AND vector IS NOT NULL")
        .where("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
        .where("exists(vector, x -> x <> 0)")
    )
    lengths = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n"))
    most = lengths.limit(1).collect()
    return good.where(F.size("vector") == (most[0].n if most else 0))
