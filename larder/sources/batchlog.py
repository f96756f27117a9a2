"""Stream output kept as one folder per micro-batch.

A micro-batch that is replayed after a failure overwrites its own folder, so
its effect is applied once.  A batch writes only the rows it touches; what a
table holds now is derived from its folders when it is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"


class BatchLog:
    """A Parquet table partitioned by the id of the micro-batch that wrote it."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark = spark
        self.path = path
        self.schema = schema

    def create(self) -> BatchLog:
        """Lay down an empty first folder so that reading always works."""
        self.write(self.spark.createDataFrame([], self.schema), -1)
        return self

    def newest(self) -> int:
        """The id of the last batch in the log."""
        return self.read().agg(F.max(BATCH)).first()[0]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write a micro-batch over what an earlier try at it left.

        A stream that starts anew while the log holds later batches would
        destroy them one after the other, so that is an error.
        """
        if batch_id == 0 and (self.newest() or 0) > 0:
            raise ValueError(f"{self.path} holds batches of another run; take a new log or its checkpoint")
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(columns).write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those older than ``before``, with ``batch``."""
        schema = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        rows = self.spark.read.schema(schema).parquet(self.path)
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def folded(self, path: str, fold: Callable[[DataFrame], DataFrame]) -> BatchLog:
        """A log at ``path`` that starts with all batches of this one folded into one.

        A stopped stream goes on with it from the same checkpoint: its next
        micro-batches have higher ids.  This log is left as it is.
        """
        after = BatchLog(self.spark, path, self.schema)
        after.write(fold(self.read()), -1)
        return after
