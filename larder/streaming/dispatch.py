"""The dispatch rule over events in order: a rider has one open delivery or none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.rules import RIDER_BUSY
from larder.operators.verdict import MISSING_KEY
from larder.session import stored

DISPATCH, COMPLETION, STATE = "dispatch", "completion", "state"
#: A row that says how a part of a rider's events ends if it starts with a certain delivery open.
PASSAGE = "passage"

_OUT = "seq bigint, kind string, Delivery_ID bigint, Rider_ID bigint, part bigint, reason string, ends bigint"
#: What is walked: rows with the part of the rider's events, and whether that part's passages are asked for.
EVENTS = pa.schema(
    [("seq", pa.int64()), ("kind", pa.string()), ("Delivery_ID", pa.int64()), ("Rider_ID", pa.int64()), ("part", pa.int64()), ("several", pa.bool_())]
)
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
_PART = ["Rider_ID", "part"]
#: Rows that are decided at once; a part is never cut.
SLAB = 500_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide rows sorted by rider, part and sequence, in slabs of whole parts."""
    held: list[pa.RecordBatch] = []
    limit = SLAB
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < limit:
            continue
        table = pa.Table.from_batches(held)
        same = pc.and_(*[pc.equal(table[c], table[c][-1]) for c in _PART])
        cut = pc.index(same, True).as_py()
        if cut:
            yield decided_rows(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        limit = max(SLAB, 2 * (table.num_rows - cut))
    if held:
        yield decided_rows(pa.Table.from_batches(held))


def decided_rows(table: pa.Table) -> pa.RecordBatch:
    """Dispatches with their reason, the delivery open after each part, and passages of the parts that ask for them.

    A dispatch that is accepted leads to the first dispatch after its
    delivery's next completion, so the accepted ones are a chain from the
    part's first; doubling the steps finds it without walking.
    """
    n = table.num_rows
    rider, part, seq = (table[c].combine_chunks().fill_null(0).to_numpy() for c in ("Rider_ID", "part", "seq"))
    delivery = table["Delivery_ID"].combine_chunks().fill_null(0).to_numpy()
    known = pc.is_valid(table["Delivery_ID"]).to_numpy()
    dispatch, completion, state = (pc.equal(table["kind"], kind).to_numpy() for kind in (DISPATCH, COMPLETION, STATE))
    at = np.arange(n)
    first = np.ones(n, dtype=bool)
    first[1:] = (rider[1:] != rider[:-1]) | (part[1:] != part[:-1])
    group = np.cumsum(first) - 1
    heads = at[first]
    groups = np.append(group, -1)
    # The dispatch that follows a place, if it is in the same part; n for none.
    ahead = np.append(np.minimum.accumulate(np.where(dispatch & known, at, n)[::-1])[::-1], [n, n])

    def following(place: np.ndarray, own: np.ndarray) -> np.ndarray:
        found = ahead[place]
        return np.where(groups[found] == own, found, n)

    # What an event leads to if it is the one that is open.
    order = np.lexsort((at, delivery, group))
    order = order[known[order]]
    keys = np.zeros(len(order), dtype=np.int64)
    keys[1:] = np.cumsum((group[order][1:] != group[order][:-1]) | (delivery[order][1:] != delivery[order][:-1]))
    done = np.where(completion[order], np.arange(len(order)), len(order))
    coming = np.append(np.minimum.accumulate(done[::-1])[::-1], len(order)).astype(np.int64)[: len(order)]
    matches = np.append(keys, -1)[coming] == keys
    closed = np.full(n + 1, n)
    closed[order] = np.where(matches, np.append(order, n)[coming], n)
    leads = np.full(n + 1, n)
    opening = at[(dispatch | state) & known]
    leads[opening] = following(closed[opening] + 1, group[opening])
    leads[opening[closed[opening] == n]] = n

    start = np.where(state[heads] & known[heads], heads, following(heads + state[heads], group[heads]))
    accepted = np.zeros(n + 1, dtype=bool)
    accepted[start] = True
    jump, last = leads.copy(), np.where(leads == n, np.arange(n + 1), leads)
    while (jump < n).any():
        accepted[jump[accepted]] = True
        jump, last = jump[jump], last[last]
    accepted = accepted[:n]

    def row(kind: str, of: np.ndarray, values: np.ndarray, valid: np.ndarray, reasons=None, ends=None) -> list[pa.Array]:
        none = pa.nulls(len(of), pa.int64())
        return [
            pa.array(seq[of]) if kind == DISPATCH else none,
            pa.array(np.full(len(of), kind, dtype=object), pa.string()),
            pa.array(values, pa.int64(), mask=~valid),
            pa.array(rider[of]),
            pa.array(part[of]),
            pa.nulls(len(of), pa.string()) if reasons is None else reasons,
            none if ends is None else ends,
        ]

    asked = at[dispatch]
    reason = np.where(~known[asked], MISSING_KEY, RIDER_BUSY).astype(object)
    reason[known[asked] & accepted[asked]] = None
    stays = opening[accepted[opening] & (closed[opening] == n)]
    final, is_open = np.zeros(len(heads), dtype=np.int64), np.zeros(len(heads), dtype=bool)
    final[group[stays]], is_open[group[stays]] = delivery[stays], True
    # The first completion of each delivery in a part that asks: from there on the rider is free.
    firsts = order[completion[order]]
    key = keys[completion[order]]
    firsts = firsts[np.append(True, key[1:] != key[:-1])[: len(firsts)]]
    firsts = firsts[table["several"].to_numpy()[firsts]]
    then = last[following(firsts + 1, group[firsts])]
    left = (then < n) & (closed[then] == n)
    ends = pa.array(np.append(delivery, 0)[then], pa.int64(), mask=~left)
    columns = [
        row(DISPATCH, asked, delivery[asked], known[asked], pa.array(reason, pa.string())),
        row(STATE, heads, final, is_open),
        row(PASSAGE, firsts, delivery[firsts], np.ones(len(firsts), dtype=bool), ends=ends),
    ]
    arrays = [pa.concat_arrays([a.cast(t) for a in same]) for same, t in zip(zip(*columns, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _OUT.split(", ")])


def _walked(rows: DataFrame) -> DataFrame:
    # A state row has no sequence and so comes first in its part.
    placed = rows.repartition("Rider_ID", "part")
    return stored(placed.sortWithinPartitions("Rider_ID", "part", "seq").mapInArrow(_walk, _OUT), "walked")


def decide(rows: DataFrame) -> DataFrame:
    """Dispatches with their reason, and state rows with the open delivery after each part.

    Range partitioning by rider and sequence cuts a rider with very many
    events into several parts, which are walked at the same time, each as if
    the rider were free at its start.  A part is a function from what is open
    at its start to what is open at its end, and `starts` composes the parts of
    each rider; those that start with a delivery open are walked once more
    from it.  Whatever the events are, there are two walks at most.
    """
    board = stored(
        rows.select("seq", "kind", "Delivery_ID", "Rider_ID")
        .repartitionByRange("Rider_ID", "seq")
        .withColumn("part", F.spark_partition_id().cast("bigint")),
        "board",
    )
    # A partition shares at most its first and its last rider with others: two rows of each.
    ends = board.groupBy("part").agg(F.min("Rider_ID").alias("low"), F.max("Rider_ID").alias("high"))
    shared = ends.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("Rider_ID"))
    shared = shared.groupBy("Rider_ID").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    shared = stored(shared, "shared")
    asking = F.broadcast(shared.select("Rider_ID", F.lit(True).alias("several")))
    flagged = board.join(asking, "Rider_ID", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    once = _walked(flagged)
    most = shared.agg(F.max("parts")).first()[0]
    if most is None:
        return once.drop("ends")
    again = starts(once.join(F.broadcast(shared), "Rider_ID", "left_semi"), most).where("Delivery_ID IS NOT NULL")
    again = stored(again, "again")
    if again.isEmpty():
        return once.where(F.col("kind") != PASSAGE).drop("ends")
    # At most one row for each partition of the board and one of its ends.
    redo = F.broadcast(again.select(_PART))
    opening = again.select(F.lit(None).cast("bigint").alias("seq"), F.lit(STATE).alias("kind"), "Delivery_ID", *_PART)
    second = _walked(board.join(redo, _PART, "left_semi").unionByName(opening).withColumn("several", F.lit(False)))
    kept = once.where(F.col("kind") != PASSAGE).join(redo, _PART, "left_anti")
    return kept.unionByName(second).drop("ends")


def starts(walked: DataFrame, most: int) -> DataFrame:
    """(Rider_ID, part, Delivery_ID): what is open when each part starts, of riders with up to ``most`` parts.

    A part leaves a delivery open unless it completes it; from the first
    completion on it goes as it would from free, which is one of the part's
    passages.  So what is open after a part leads to the next part that
    completes it or, if nothing is, to the next part.  The way from the first
    part is found by doubling the steps, in as many joins as ``most`` has bits.
    """
    def name(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    free = F.col("kind") == STATE
    passages = walked.where(free | (F.col("kind") == PASSAGE)).select(
        *_PART,
        F.when(free, "").otherwise(name(F.col("Delivery_ID"))).alias("opens"),
        F.when(free, name(F.col("Delivery_ID"))).otherwise(name(F.col("ends"))).alias("ends"),
    )
    # Only what some part leaves open can be open at the start of another.
    left = passages.select("Rider_ID", F.col("ends").alias("opens")).distinct()
    met = passages.where("opens <> ''").join(left, ["Rider_ID", "opens"], "left_semi").select(passages.columns)
    passages = stored(passages.where("opens = ''").unionByName(met), "passages")
    # As many parts as the board has partitions, at most.
    where = passages.groupBy("Rider_ID", F.col("opens").alias("ends")).agg(F.collect_set("part").alias("parts"))
    after = F.array_min(F.filter("parts", lambda p: p > F.col("part")))
    steps = passages.join(where, ["Rider_ID", "ends"]).select(*_PART, "opens", after.alias("to_part"), F.col("ends").alias("to_opens"))
    steps = stored(steps.where("to_part IS NOT NULL"), "steps")
    way = passages.groupBy("Rider_ID").agg(F.min("part").alias("part")).withColumn("opens", F.lit(""))
    there = ["Rider_ID", "to_part", "to_opens"]
    for _ in range((most - 1).bit_length()):
        jumped = way.join(steps, ["Rider_ID", "part", "opens"]).select("Rider_ID", F.col("to_part").alias("part"), F.col("to_opens").alias("opens"))
        way = stored(way.unionByName(jumped), "way")
        onward = steps.select("Rider_ID", F.col("part").alias("to_part"), F.col("opens").alias("to_opens"), F.col("to_part").alias("_p"), F.col("to_opens").alias("_o"))
        steps = stored(steps.join(onward, there).select(*_PART, "opens", F.col("_p").alias("to_part"), F.col("_o").alias("to_opens")), "steps")
    stops = way.join(passages, ["Rider_ID", "part", "opens"]).groupBy("Rider_ID").agg(F.array_sort(F.collect_list(F.struct("part", "opens", "ends"))).alias("stops"))
    found = passages.where("opens = ''").select(_PART).join(stops, "Rider_ID")
    ahead = F.expr("get(filter(stops, s -> s.part >= part), 0).opens")
    opened = F.when(F.expr("element_at(stops, -1).part < part"), F.expr("element_at(stops, -1).ends")).otherwise(ahead)
    return found.select(*_PART, F.nullif(opened, F.lit("")).cast("bigint").alias("Delivery_ID"))


def open_deliveries(decided: DataFrame) -> DataFrame:
    """The delivery that is open, or NULL, for each rider that had an event."""
    states = decided.where(F.col("kind") == STATE)
    return states.groupBy("Rider_ID").agg(F.max_by("Delivery_ID", "part").alias("open_delivery"))
