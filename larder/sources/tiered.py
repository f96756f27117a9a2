"""A log of micro-batches that is folded while the stream runs."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.sources.batchlog import BATCH, BatchLog

_SPAN = re.compile(r"from=(-?\d+),to=(-?\d+)$")


class TieredLog(BatchLog):
    """A `BatchLog` whose batches are folded two by two, as a binary counter carries.

    After batch ``n`` the folders hold runs of 2^k batches, one for each one
    in the binary digits of ``n + 1``, so a reader combines as many folders as
    that number has digits at most, and a row is rewritten as often.  ``fold``
    makes one run of rows from the rows of several, which have ``batch``, the
    last batch of the run they come from; the result has the log's columns.

    A batch that is replayed overwrites its own folder and the runs that end
    with it.  Runs that a longer one covers are removed only once that one is
    older than the batch being written, so what a replay reads is still there.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame]):
        super().__init__(spark, path, schema)
        self.fold = fold

    def create(self) -> TieredLog:
        """Batches have folders of their own, so there is nothing to lay down."""
        return self

    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def spans(self) -> list[tuple[int, int]]:
        """First and last batch of each folder that is written to its end."""
        files, folder = self._files()
        if not files.exists(folder):
            return []
        found = []
        for status in files.listStatus(folder):
            own = status.getPath()
            match = _SPAN.search(own.getName())
            if match and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(own, "_SUCCESS")):
                found.append((int(match[1]), int(match[2])))
        return sorted(found)

    def cover(self, before: int | None = None) -> list[tuple[int, int]]:
        """The longest runs that hold each batch once, of those older than ``before``."""
        out: list[tuple[int, int]] = []
        for first, last in sorted(self.spans(), key=lambda s: (s[0], -s[1])):
            if (before is None or last < before) and (not out or first > out[-1][1]):
                out.append((first, last))
        return out

    def newest(self) -> int:
        return max((last for _, last in self.spans()), default=-1)

    def _folder(self, span: tuple[int, int]) -> str:
        return f"{self.path}/from={span[0]},to={span[1]}"

    def _put(self, rows: DataFrame, span: tuple[int, int]) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(columns).write.mode("overwrite").parquet(self._folder(span))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write a micro-batch over what an earlier try at it left, and fold the runs that it completes."""
        if batch_id == 0 and self.newest() > 0:
            raise ValueError(f"{self.path} holds batches of another run; take a new log or its checkpoint")
        older = [s for s in self.cover(before=batch_id)]
        files, _ = self._files()
        for span in self.spans():
            covered = any(a <= span[0] and span[1] <= b and (a, b) != span for a, b in older)
            # A run that ends with this batch is from an earlier try at it.
            if covered or span[1] >= batch_id:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(span)), True)
        self._put(rows, (batch_id, batch_id))
        length = (batch_id + 1) & -(batch_id + 1)
        if batch_id >= 0 and length > 1:
            held = [s for s in self.cover(before=batch_id) if s[0] > batch_id - length] + [(batch_id, batch_id)]
            self._put(self.fold(self._runs(held)), (batch_id + 1 - length, batch_id))

    def _runs(self, spans: list[tuple[int, int]]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        parts = [
            self.spark.read.schema(self.schema).parquet(self._folder(s)).withColumn(BATCH, F.lit(s[1]).cast("long")) for s in spans
        ]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all runs, or of those older than ``before``, with ``batch``, the last batch of the run."""
        return self._runs(self.cover(before))
