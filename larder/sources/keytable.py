"""The keys of a stored table, in buckets by their hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many keys of a batch are named to the scan, so that it opens their buckets only.
NAMED_KEYS = 10_000


class KeyTable:
    """A bucketed Parquet table of one key column.

    A batch that is joined with it is dealt out to the table's buckets, so the
    stored keys are read where they are and not shuffled.  A batch of few keys
    reads the buckets of those alone.  The folder holds all that is needed:
    each session declares the table over it anew.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 200):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.name = "larder_keys_" + hashlib.md5(f"{path}|{key}|{buckets}".encode()).hexdigest()

    def _declare(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (`{self.key}` BIGINT) USING parquet"
            f" CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def add(self, rows: DataFrame) -> KeyTable:
        """Add the keys of ``rows``; a key that is added twice is one key."""
        self._declare()
        keys = rows.select(F.col(self.key).cast("bigint")).where(F.col(self.key).isNotNull()).distinct()
        # Each task writes the file of one bucket.
        dealt = keys.repartition(self.buckets, self.key)
        dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).mode("append").saveAsTable(self.name)
        return self

    def keys(self) -> DataFrame:
        """All keys, with repeats."""
        self._declare()
        return self.spark.table(self.name)

    def keys_for(self, batch: DataFrame) -> DataFrame:
        """Those keys that a batch can meet: all of them, or the ones it names if it has at most ``NAMED_KEYS``."""
        found = batch.select(F.col(self.key).cast("bigint").alias("key")).where("key IS NOT NULL").distinct().limit(NAMED_KEYS + 1).collect()
        if len(found) > NAMED_KEYS:
            return self.keys()
        return self.keys().where(F.col(self.key).isin([r.key for r in found]))
