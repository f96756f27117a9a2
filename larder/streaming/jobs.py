"""Streaming jobs.

Each job writes what a micro-batch changes to a :class:`BatchLog`, under the id
of the micro-batch; a replay overwrites it.  The functions ending in ``now`` or
starting with ``current`` derive the table from its log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larder.operators.keyed import last_per_key, missing_keys, upsert
from larder.operators.ledger import apply_movements, exact, usage_movements
from larder.operators.rules import validate_salary
from larder.operators.verdict import MISSING_KEY, Verdict, judge, reject_taken_keys
from larder.sources.batchlog import BATCH, BatchLog
from larder.streaming.dispatch import DISPATCH, STATE, decide, open_deliveries

AVAILABLE_NOW = {"availableNow": True}


def _start(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict,
    mode: str = "append",
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(each)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_stock_ledger(
    receipts: DataFrame,
    lines: DataFrame,
    recipes_now: Callable[[], DataFrame],
    log: BatchLog,
    checkpoint: str,
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Stock movements from a stream of receipts and one of order lines.

    ``recipes_now`` is asked again for each micro-batch, because an order uses
    the recipe as it is when the order comes in.
    """
    tagged = receipts.select(
        F.lit("in").alias("kind"),
        F.col("IngredientID").alias("id"),
        exact(receipts, "Quantity_Received").alias("quantity"),
    ).unionByName(
        lines.select(
            F.lit("out").alias("kind"),
            F.col("ProductID").alias("id"),
            exact(lines, "Quantity").alias("quantity"),
        )
    )

    def each(rows: DataFrame, batch_id: int) -> None:
        # The one pass over the micro-batch; what is kept is one row per id, in no more partitions than run at once.
        sums = (
            rows.where(F.col("id").isNotNull())
            .groupBy("kind", "id")
            .agg(
                F.sum("quantity").alias("total"),
                F.bool_or(F.col("quantity").isNull()).alias("unknown"),
            )
            .coalesce(rows.sparkSession.sparkContext.defaultParallelism)
            .persist()
        )
        received = sums.where(F.col("kind") == "in").select(
            F.col("id").alias("IngredientID"), F.col("total").alias("delta"), "unknown"
        )
        sold = sums.where(F.col("kind") == "out").select(
            F.col("id").alias("ProductID"),
            F.col("total").alias("sold"),
            F.col("unknown").alias("sold_unknown"),
        )
        # Of the recipes, only what the micro-batch sold is put together.
        recipes = recipes_now().join(sold.select("ProductID"), "ProductID", "left_semi")
        used = usage_movements(recipes, sold)
        log.write(received.unionByName(used), batch_id)
        sums.unpersist()

    return _start(tagged, each, checkpoint, trigger)


def stock_now(ingredients: DataFrame, log: BatchLog) -> DataFrame:
    """The opening stock after all logged movements."""
    return apply_movements(ingredients, log.read().drop(BATCH))


def stream_order_totals(
    lines: DataFrame, log: BatchLog, checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Each micro-batch logs what its lines add to their orders; no state is kept."""

    def each(rows: DataFrame, batch_id: int) -> None:
        log.write(order_sums(rows), batch_id)

    return _start(lines, each, checkpoint, trigger)


def order_sums(lines: DataFrame) -> DataFrame:
    """The total of the given lines of each order."""
    known = lines.where(F.col("Order_ID").isNotNull())
    return known.groupBy("Order_ID").agg(F.sum("Line_Total").alias("Total_Amount"))


def total_sums(logged: DataFrame) -> DataFrame:
    """What several micro-batches add to each order, as one: how a log of totals is folded."""
    return logged.groupBy("Order_ID").agg(F.sum("Total_Amount").alias("Total_Amount"))


def current_totals(log: BatchLog, opening: DataFrame | None = None) -> DataFrame:
    """The total of each order: all that was logged, and the lines stored before."""
    logged = log.read().select("Order_ID", "Total_Amount")
    if opening is not None:
        logged = logged.unionByName(order_sums(opening))
    kind = log.schema["Total_Amount"].dataType
    return logged.groupBy("Order_ID").agg(F.sum("Total_Amount").cast(kind).alias("Total_Amount"))


def stream_dispatch(
    events: DataFrame,
    decisions: BatchLog,
    riders: BatchLog,
    checkpoint: str,
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Accept or refuse dispatches while completions free the riders again.

    ``events`` has ``seq``, ``kind`` (``dispatch`` or ``completion``),
    ``Delivery_ID`` and ``Rider_ID``.  ``decisions`` logs each dispatch with its
    ``reason``; ``riders`` logs the open delivery of the riders a micro-batch
    touched and, every so often, of all riders, so that no more than the
    batches since then need to be read.
    """

    def each(rows: DataFrame, batch_id: int) -> None:
        rows = rows.select("seq", "kind", "Delivery_ID", "Rider_ID").persist()
        known = rows.where(F.col("Rider_ID").isNotNull())
        since = max(batch_id - 1, 0) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
        # What was folded before this run has a negative id and is always read.
        logged = riders.read(before=batch_id).where((F.col(BATCH) >= since) | (F.col(BATCH) < 0))
        before = last_per_key(logged, "Rider_ID", BATCH)
        touched = known.select("Rider_ID").distinct()
        carried = before.join(touched, "Rider_ID", "left_semi").select(
            F.lit(None).cast("bigint").alias("seq"),
            F.lit(STATE).alias("kind"),
            F.col("open_delivery").alias("Delivery_ID"),
            "Rider_ID",
        )
        decided = decide(known.unionByName(carried))
        now_open = open_deliveries(decided)
        unbound = rows.where(F.col("Rider_ID").isNull() & (F.col("kind") == DISPATCH))
        unbound = judge(unbound, (F.col("Delivery_ID").isNull(), MISSING_KEY))
        ruled = decided.where(F.col("kind") == DISPATCH).drop("part")
        decisions.write(ruled.unionByName(unbound), batch_id)
        if batch_id % SNAPSHOT_EVERY == 0:
            rest = before.join(touched, "Rider_ID", "left_anti")
            now_open = now_open.unionByName(rest)
        riders.write(now_open, batch_id)
        rows.unpersist()

    return _start(events, each, checkpoint, trigger)


# How many micro-batches of rider states are read at most to know the current one.
SNAPSHOT_EVERY = 50

DECISION = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("Delivery_ID", T.LongType()),
        T.StructField("Rider_ID", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)
RIDER_STATE = T.StructType(
    [T.StructField("Rider_ID", T.LongType()), T.StructField("open_delivery", T.LongType())]
)


def stream_validated_append(
    rows: DataFrame,
    stored_now: Callable[[], DataFrame],
    accepted: BatchLog,
    rejected: BatchLog,
    checkpoint: str,
    pk: str = "Employee_ID",
    seq: str = "seq",
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Split new employees into accepted and rejected; taken keys are refused.

    ``stored_now`` is asked again for each micro-batch, so keys that others add
    later are refused too.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        taken = [stored_now(), accepted.read(before=batch_id)]
        checked = validate_salary(batch).decided
        verdict = Verdict(reject_taken_keys(checked, taken, pk, seq).persist())
        accepted.write(verdict.accepted, batch_id)
        rejected.write(verdict.rejected, batch_id)
        verdict.decided.unpersist()

    return _start(rows, each, checkpoint, trigger)


def stream_upsert(
    rows: DataFrame,
    log: BatchLog,
    checkpoint: str,
    pk: str,
    seq: str = "seq",
    trigger: dict = AVAILABLE_NOW,
    rejected: BatchLog | None = None,
) -> StreamingQuery:
    """Log the newest row per key of each micro-batch.

    Rows without a key go to ``rejected``; without that log they are an error.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        refused = missing_keys(batch, pk)
        if rejected is not None:
            rejected.write(refused, batch_id)
        elif not refused.isEmpty():
            raise ValueError(f"rows without {pk}: give a log for rejected rows")
        log.write(last_per_key(batch.where(F.col(pk).isNotNull()), pk, seq), batch_id)

    return _start(rows, each, checkpoint, trigger)


def current_rows(base: DataFrame, log: BatchLog, pk: str) -> DataFrame:
    """The table after the logged replacements; the newest batch wins."""
    return upsert(base, log.read(), pk, BATCH)

