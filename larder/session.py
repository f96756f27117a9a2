"""Session helpers: a local session for tests, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Folders written since the innermost `scratch` began; None outside of all.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def local_session(cpus: str = "8", app: str = "larder") -> SparkSession:
    """A single-machine session for tests and the benchmark script."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back on a temporary folder: on a cluster a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="larder-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder name below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    Cuts the lineage as a checkpoint does, so that a lost executor repeats
    nothing and changes nothing, but later reads fetch only the columns they
    need, and Catalyst knows the size.
    """
    path = fresh_dir(df.sparkSession, name)
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is stored inside is removed at the end, but for what is handed to the function this gives.

    Nothing lazy that reads a removed folder may be left by then.  What is
    kept belongs to the scratch around this one, if there is one.
    """
    own: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stored_at)
        return df

    before = _WRITTEN.set(own)
    try:
        yield keep
    finally:
        _WRITTEN.reset(before)
        around = _WRITTEN.get()
        if around is not None:
            around.extend(kept)
        remove(spark, [path for path in own if path not in kept])


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders of the shared folder."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that are written inside and still there at the end, for who removes them later."""
    own: list[str] = []
    before = _WRITTEN.set(own)
    try:
        yield own
    finally:
        _WRITTEN.reset(before)


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most so many rows at once in what is written inside, fewer if the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
