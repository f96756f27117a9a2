"""Rules that a new row meets before or as it is stored."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import as_stamp, is_missing
from larder.operators.joining import attach, without
from larder.operators.turns import opened, settle
from larder.operators.verdict import DUPLICATE_KEY, MISSING_KEY, Verdict, judge

RIDER_BUSY = "rider busy"
SALARY_NOT_POSITIVE = "salary not positive"


def busy_riders(deliveries: DataFrame) -> DataFrame:
    """Riders with an open delivery."""
    is_open = F.col("Rider_ID").isNotNull() & (F.col("Delivery_Status") == 0)
    return deliveries.where(is_open).select("Rider_ID").distinct()


def validate_rider(deliveries: DataFrame, new: DataFrame, seq: str = "seq") -> Verdict:
    """Refuse a delivery whose rider has an open one, stored or earlier in the batch.

    An earlier open row blocks its successors even when it was refused itself,
    since it was refused because the rider was busy.  The first open row per
    rider therefore decides, and no rider's rows need to be sorted together.
    """
    first_open = (
        new.where(F.col("Delivery_Status") == 0)
        .where(F.col("Rider_ID").isNotNull())
        .groupBy("Rider_ID")
        .agg(F.min(seq).alias("_from"))
    )
    blocked = first_open.join(
        busy_riders(deliveries).withColumn("_busy", F.lit(True)), "Rider_ID", "full"
    )
    refused = F.col("_busy") | (F.col(seq) > F.col("_from"))
    judged = judge(attach(new, blocked, "Rider_ID"), (refused, RIDER_BUSY))
    return Verdict(judged.drop("_from", "_busy"))


def judge_deliveries(deliveries: DataFrame, new: DataFrame, seq: str = "seq") -> Verdict:
    """The rider rule and the key together: only accepted rows take either."""
    opens = F.coalesce(F.col("Delivery_Status") == 0, F.lit(False))
    busy = busy_riders(deliveries)
    bids = new.where(F.col("Delivery_ID").isNotNull()).select(
        seq, "Rider_ID", "Delivery_ID", opens.alias("opens")
    )
    bids = without(without(bids, busy, "Rider_ID"), deliveries, "Delivery_ID")
    won = settle(bids, seq)
    facts = busy.withColumn("_busy", F.lit(True)).join(opened(won, seq), "Rider_ID", "full")
    wins = won.select("Delivery_ID", seq, F.lit(True).alias("_wins"))
    judged = judge(
        attach(new, facts, "Rider_ID").join(wins, ["Delivery_ID", seq], "left"),
        (F.col("_busy") | (F.col(seq) > F.col("_from")), RIDER_BUSY),
        (F.col("Delivery_ID").isNull(), MISSING_KEY),
        (F.col("_wins").isNull(), DUPLICATE_KEY),
    )
    return Verdict(judged.drop("_busy", "_from", "_wins"))


def stamp_dispatch_time(new: DataFrame, now: Column | dt.datetime | str | None = None) -> DataFrame:
    """Fill a missing dispatch time with ``now``."""
    given = F.col("Dispatch_Time")
    return new.withColumn("Dispatch_Time", F.when(is_missing(given), as_stamp(now)).otherwise(given))


def validate_salary(new: DataFrame) -> Verdict:
    """Refuse a salary of zero or less; NULL passes."""
    return Verdict(judge(new, (F.col("Salary") <= 0, SALARY_NOT_POSITIVE)))
