"""Who gets a rider and a delivery key when commands ask for them in turn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.joining import attach, without
from larder.session import stored


def settle(bids: DataFrame, seq: str) -> DataFrame:
    """The bids that win, where each takes its key, and if it opens its rider, from later ones.

    ``bids`` has ``seq``, ``Delivery_ID``, ``Rider_ID`` and ``opens``.  A bid
    with no earlier opening bid for its rider and no earlier bid for its key
    wins whatever else happens, and later bids for either are lost.  Where
    keys are unique that settles all.

    What is left are bids that wait for one that waits itself; only those are
    stored.  A bid that waits for a single one wins if that one loses, so
    chains of such bids are contracted by pointer jumping, in as many joins as
    the longest has bits.  Then the winners' later rivals are lost, and what
    waited for several is looked at again.
    """
    ranked = _waiting(bids, seq)
    first = ranked.where("_waits = 0").select(bids.columns)
    won = [first]
    left = stored(_undecided(ranked.where("_waits > 0").select(bids.columns), first, seq), "contested")
    while not left.isEmpty():
        firsts = stored(_chained(left, seq), "settled")
        won.append(firsts)
        # The first of all that are left waits for none, so there are fewer each time.
        left = stored(_undecided(left, firsts, seq), "contested")
    return reduce(DataFrame.unionByName, won)


def _opening(bids: DataFrame) -> DataFrame:
    return bids.where(F.col("opens") & F.col("Rider_ID").isNotNull())


def _waiting(bids: DataFrame, seq: str) -> DataFrame:
    """``bids`` with the first rival for the key and for the rider, and for how many rivals' sides each waits."""
    by_rider = _opening(bids).groupBy("Rider_ID").agg(F.min(seq).alias("_rider_first"))
    by_key = bids.groupBy("Delivery_ID").agg(F.min(seq).alias("_key_first"))
    met = attach(attach(bids, by_rider, "Rider_ID"), by_key, "Delivery_ID")
    waits = _later("_rider_first", seq).cast("int") + _later("_key_first", seq).cast("int")
    return met.withColumn("_waits", waits)


def _later(first: str, seq: str) -> Column:
    return F.coalesce(F.col(first) < F.col(seq), F.lit(False))


def _undecided(bids: DataFrame, won: DataFrame, seq: str) -> DataFrame:
    """Those of ``bids`` that no earlier winner has beaten to the key or to the rider."""
    free = without(bids, won.select("Delivery_ID"), "Delivery_ID")
    met = attach(free, opened(won, seq), "Rider_ID")
    return met.where(F.col("_from").isNull() | (F.col(seq) < F.col("_from"))).select(bids.columns)


def _chained(left: DataFrame, seq: str) -> DataFrame:
    """The winners among bids that wait for none or, link by link, for a single one."""
    ranked = _waiting(left, seq)
    # The second of a key or rider waits for the first alone; the others for several.
    others = ranked.where(_later("_rider_first", seq))
    rider_second = _opening(others).groupBy("Rider_ID").agg(F.min(seq).alias("_rider_second"))
    key_second = ranked.where(_later("_key_first", seq)).groupBy("Delivery_ID").agg(F.min(seq).alias("_key_second"))
    ranked = attach(attach(ranked, rider_second, "Rider_ID"), key_second, "Delivery_ID")
    many = F.coalesce(F.col("_rider_second") < F.col(seq), F.lit(False)) | F.coalesce(F.col("_key_second") < F.col(seq), F.lit(False))
    one = F.when(_later("_rider_first", seq), F.col("_rider_first")).otherwise(F.col("_key_first"))
    single = (F.col("_waits") == 1) | ((F.col("_waits") == 2) & (F.col("_rider_first") == F.col("_key_first")))
    link = (F.col("_waits") > 0) & single & ~many
    steps = stored(
        ranked.select(
            F.col(seq).alias("_at"),
            F.when(link, one).otherwise(F.col(seq)).alias("_to"),
            link.alias("_odd"),
            (F.col("_waits") == 0).alias("_root"),
        ),
        "links",
    )
    while True:
        onward = steps.select(F.col("_at").alias("_to"), F.col("_to").alias("_next"), F.col("_odd").alias("_flip"), F.col("_root").alias("_sure"))
        steps = stored(
            steps.join(onward, "_to").select(
                "_at",
                F.col("_next").alias("_to"),
                (F.col("_odd") != F.col("_flip")).alias("_odd"),
                F.col("_sure").alias("_root"),
                (F.col("_next") != F.col("_to")).alias("_moved"),
            ),
            "links",
        )
        if steps.where("_moved").isEmpty():
            wins = steps.where("_root AND NOT _odd").select(F.col("_at").alias(seq))
            return left.join(wins, seq, "left_semi")
        steps = steps.drop("_moved")


def opened(won: DataFrame, seq: str) -> DataFrame:
    """From when on the winning bids keep their rider busy; one row per rider."""
    return _opening(won).select("Rider_ID", F.col(seq).alias("_from"))
