"""Streams that keep one value of state per key, in RocksDB: riders' open deliveries, and keys that are taken."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from larder.operators.rules import validate_salary
from larder.operators.verdict import DUPLICATE_KEY, MISSING_KEY, REASON, Verdict, judge
from larder.sources.batchlog import BatchLog
from larder.streaming.dispatch import DISPATCH, EVENTS, STATE, decided_rows
from larder.streaming.jobs import AVAILABLE_NOW, _start

_DECISION = "seq bigint, Delivery_ID bigint, Rider_ID bigint, reason string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that riders are dealt out to by hash; a stream's state belongs to them, so they stay the same while its checkpoint lives.
GROUPS = 1024


class RiderState(StatefulProcessor):
    """The open delivery of each rider of a group; no value if there is none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getMapState("open", "Rider_ID bigint", "Delivery_ID bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Decide the events of a group's riders in a micro-batch at once, each rider's in order of sequence, from the delivery that is open."""
        events = pd.concat(rows)
        rider, seq = events["Rider_ID"].to_numpy(dtype="int64"), events["seq"].astype("int64").to_numpy()
        riders = np.unique(rider)
        found = [self._open.getValue((r,)) for r in riders.tolist()]
        before = [None if held is None else held[0] for held in found]
        n, m = len(riders), len(events)
        delivery = pa.array(events["Delivery_ID"].to_numpy(dtype="int64"), pa.int64(), mask=~events["known"].to_numpy(dtype=bool))
        held = pa.table(
            {
                "seq": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(seq)]),
                "kind": pa.concat_arrays([pa.array([STATE] * n, pa.string()), pa.array(events["kind"], pa.string())]),
                "Delivery_ID": pa.concat_arrays([pa.array(before, pa.int64()), delivery]),
                "Rider_ID": pa.array(np.concatenate([riders, rider])),
                "part": pa.array(np.zeros(n + m, dtype=np.int64)),
                "several": pa.array(np.zeros(n + m, dtype=bool)),
            },
            schema=EVENTS,
        )
        # What is open comes before the rider's events.
        order = np.lexsort((np.concatenate([np.zeros(n, dtype=np.int64), seq]), np.arange(n + m) >= n, np.concatenate([riders, rider])))
        decided = decided_rows(held.take(pa.array(order)))
        after = decided.filter(pc.equal(decided["kind"], STATE))["Delivery_ID"].to_pylist()
        for r, b, a in zip(riders.tolist(), before, after, strict=True):
            if a is None and b is not None:
                self._open.removeKey((r,))
            elif a != b:
                self._open.updateValue((r,), (a,))
        ruled = decided.filter(pc.equal(decided["kind"], DISPATCH))
        yield ruled.select(["seq", "Delivery_ID", "Rider_ID", "reason"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB; a running query keeps the settings it started with.

    The state has no more partitions than run at once when the checkpoint is
    made: for each of them a micro-batch starts a worker and commits a store,
    however few rows it has.
    """
    partitions = "spark.sql.shuffle.partitions"
    fewer = min(int(spark.conf.get(partitions)), spark.sparkContext.defaultParallelism)
    before = {name: spark.conf.get(name, None) for name in (_PROVIDER, partitions)}
    try:
        spark.conf.set(_PROVIDER, _ROCKSDB)
        spark.conf.set(partitions, fewer)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_dispatch_keyed(
    events: DataFrame, decisions: BatchLog, checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Accept or refuse dispatches, with the riders' open deliveries in keyed state.

    ``events`` is as for `stream_dispatch`, and so are the decisions.  The
    state is one value per rider who has a delivery open, in RocksDB under the
    checkpoint, and a micro-batch reads and writes those of its own riders only:
    it costs the same however many riders there are.  A replayed micro-batch
    starts from the state before it and overwrites what it logged.

    Riders are dealt out to `GROUPS` groups, and the events of a group in one
    micro-batch meet in one task and are decided at once.  Where one rider may
    hold a large part of them, `stream_dispatch` cuts them into parts.
    """
    known = events.where(F.col("Rider_ID").isNotNull())
    # Beside a null, pandas would make doubles of whole numbers.
    plain = known.select(
        F.pmod(F.xxhash64(F.col("Rider_ID").cast("bigint")), F.lit(GROUPS)).alias("riders"),
        F.col("Rider_ID").cast("bigint"),
        F.col("seq").cast("bigint"),
        "kind",
        F.coalesce(F.col("Delivery_ID").cast("bigint"), F.lit(0)).alias("Delivery_ID"),
        F.col("Delivery_ID").isNotNull().alias("known"),
    )
    ruled = plain.groupBy("riders").transformWithStateInPandas(RiderState(), _DECISION, "append", "none")
    unbound = events.where(F.col("Rider_ID").isNull() & (F.col("kind") == DISPATCH))
    unbound = judge(unbound, (F.col("Delivery_ID").isNull(), MISSING_KEY)).select("seq", "Delivery_ID", "Rider_ID", "reason")
    with rocksdb(events.sparkSession):
        return _start(ruled.unionByName(unbound), decisions.write, checkpoint, trigger)


class TakenKey(StatefulProcessor):
    """Whether a key is taken; the first row of a key that is not takes it."""

    def __init__(self, seq: str, columns: list[str]) -> None:
        self._seq, self._columns = seq, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._taken = handle.getValueState("taken", "taken boolean")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._taken.update((True,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self._taken.exists():
            for held in rows:
                yield held[self._columns].assign(**{REASON: DUPLICATE_KEY})
            return
        held = pd.concat(rows).reset_index(drop=True)
        self._taken.update((True,))
        first = held[self._seq].astype("int64").idxmin()
        yield held[self._columns].assign(**{REASON: [None if i == first else DUPLICATE_KEY for i in held.index]})

    def close(self) -> None:
        pass


def stream_validated_append_keyed(
    rows: DataFrame,
    stored: DataFrame,
    accepted: BatchLog,
    rejected: BatchLog,
    checkpoint: str,
    pk: str = "Employee_ID",
    seq: str = "seq",
    rule: Callable[[DataFrame], Verdict] = validate_salary,
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Split new rows into accepted and rejected; taken keys are refused, as known from keyed state.

    The state is one flag per taken key: those of ``stored`` when the stream
    first starts, and then those it accepts.  A micro-batch looks up and sets
    the keys of its own rows, so it reads nothing of what was accepted before:
    its cost does not grow with the stream's history.  Keys that others store
    later are not seen; `stream_validated_append` asks for them each time.

    Columns are flat.  Only rows that ``rule`` lets pass compete for a key.
    """
    judged = rule(rows).decided
    judged = judge(judged, (F.col(pk).isNull(), MISSING_KEY))
    types = {f.name: f.dataType for f in rows.schema}
    # All as text: beside a null, pandas would make doubles of whole numbers.
    plain = judged.where(F.col(REASON).isNull()).select(F.col(pk).cast("string").alias("_key"), *[F.col(c).cast("string").alias(c) for c in types])
    known = stored.where(F.col(pk).isNotNull()).select(F.col(pk).cast("string").alias("_key")).distinct().groupBy("_key")
    shape = ", ".join(f"`{c}` string" for c in [*types, REASON])
    decided = plain.groupBy("_key").transformWithStateInPandas(TakenKey(seq, list(types)), shape, "append", "none", known)
    decided = decided.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], REASON)
    refused = judged.where(F.col(REASON).isNotNull()).select(*types, REASON)

    def each(batch: DataFrame, batch_id: int) -> None:
        verdict = Verdict(batch.persist())
        accepted.write(verdict.accepted, batch_id)
        rejected.write(verdict.rejected, batch_id)
        batch.unpersist()

    with rocksdb(rows.sparkSession):
        return _start(decided.unionByName(refused), each, checkpoint, trigger)
