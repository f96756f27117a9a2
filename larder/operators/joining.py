"""Joins of rows with one-row-per-key facts, safe against a hot key in the rows.

Adaptive execution splits a hot key among tasks only where a join sits right
above the shuffles of both its sides.  Facts that come out of an aggregation
are partitioned by the key already, so Spark would join them without a shuffle
of their own and could then not split the rows.  Null-safe equality, for which
that partitioning does not count, brings the shuffle back; it moves one row
per key.  Facts that are small enough are broadcast by Catalyst in any case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, facts: DataFrame, key: str, fact_key: str | None = None) -> DataFrame:
    """Left join ``facts``, which have one row per key and no NULL key."""
    other = facts.withColumnRenamed(fact_key or key, "_fact_key")
    return rows.join(other, F.col(key).eqNullSafe(F.col("_fact_key")), "left").drop("_fact_key")


def within(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` occurs in ``facts``."""
    other = facts.select(F.col(key).alias("_fact_key")).where(F.col("_fact_key").isNotNull())
    return rows.join(other, F.col(key).eqNullSafe(F.col("_fact_key")), "left_semi")


def without(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` does not occur in ``facts``, those without a key included."""
    other = facts.select(F.col(key).alias("_fact_key")).where(F.col("_fact_key").isNotNull())
    return rows.join(other, F.col(key).eqNullSafe(F.col("_fact_key")), "left_anti")


def flag(rows: DataFrame, column: str, parents: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``, true where ``column`` is found among the parents' primary key."""
    known = parents.where(F.col(key).isNotNull()).select(F.col(key), F.lit(True).alias(name))
    flagged = attach(rows, known, column, key)
    return flagged.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
