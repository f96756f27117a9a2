"""The outcome of validating a batch of rows: each is accepted or has a reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASON = "reason"

DUPLICATE_KEY = "duplicate key"
MISSING_KEY = "missing key"


@dataclass(frozen=True)
class Verdict:
    """All rows with a ``reason``, which is NULL for the accepted ones.

    ``accepted`` and ``rejected`` are two filters over one plan.  Who writes
    both should persist or store ``decided`` first, so that it is computed once.
    """

    decided: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.decided.where(F.col(REASON).isNull()).drop(REASON)

    @property
    def rejected(self) -> DataFrame:
        return self.decided.where(F.col(REASON).isNotNull())


def judge(rows: DataFrame, *tests: tuple[Column, str]) -> DataFrame:
    """Add ``reason``: that of the first test to hold.

    Rows that carry a reason already keep it.  A test that is NULL does not hold.
    """
    reasons = [F.when(test, F.lit(reason)) for test, reason in tests]
    if REASON in rows.columns:
        reasons.insert(0, F.col(REASON))
    return rows.withColumn(REASON, F.coalesce(*reasons, F.lit(None).cast("string")))


def reject_taken_keys(
    rows: DataFrame, existing: DataFrame | Sequence[DataFrame], pk: str, seq: str, dear: bool = False
) -> DataFrame:
    """Give a reason to rows whose key is NULL, stored already or used earlier.

    Only rows that are valid so far compete for a key, and the first in ``seq``
    wins it; ``seq`` is unique in the batch.  The winner comes from a minimum
    per key, which combines before the shuffle, and rows find it by joining on
    (key, seq), so a key that fills much of the batch never meets in one task.

    ``dear`` rows, which come out of joins, are worked out once: they are dealt
    out by (key, seq), as the join needs them anyhow, and the minimum reads the
    same exchange.
    """
    stored = [existing] if isinstance(existing, DataFrame) else existing
    if dear:
        rows = rows.repartition(pk, seq)
        # True for every row, but names all columns: an exchange with fewer would be another one.
        whole = F.xxhash64(*rows.columns).bitwiseAND(F.lit(0).cast("bigint")) == 0
        first = F.min(F.when(F.col(REASON).isNull() & F.col(pk).isNotNull() & whole, F.col(seq)))
        winners = rows.groupBy(pk).agg(first.alias(seq)).where(F.col(seq).isNotNull())
    else:
        valid = rows.where(F.col(REASON).isNull()) if REASON in rows.columns else rows
        winners = valid.where(F.col(pk).isNotNull()).groupBy(pk).agg(F.min(seq).alias(seq))
    for keys in stored:
        winners = winners.join(keys.select(F.col(pk)), pk, "left_anti")
    winners = winners.withColumn("_wins", F.lit(True))
    judged = judge(
        rows.join(winners, [pk, seq], "left"),
        (F.col(pk).isNull(), MISSING_KEY),
        (F.col("_wins").isNull(), DUPLICATE_KEY),
    )
    return judged.drop("_wins")
