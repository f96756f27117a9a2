"""Exact searches of a query set over all rows: integer vectors, blocks of rows, lists of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import stored

SCALE = 256
#: Components of the vectors of one block and, at most, of one list of queries.
BLOCK_VALUES = 1 << 20
#: Queries of a list: a 32nd of all, but between these.
LIST_ROWS = (128, 4096)
#: Whole numbers below this are exact as doubles, and so are sums that stay below.
EXACT = 2.0**53
LONG = 2**63
PACKED = "n long, kind string, ids binary, labels binary, vectors binary"
KEYS = ["dim", "block", "list"]


def integer_vectors(table: DataFrame, id_column: str, vector: str, label: Column | None = None) -> DataFrame:
    """(vec_id, label, dim, v): ``v`` holds floor(256 x) of each component, as whole doubles.

    Left out: null ids, null or empty vectors, and those with null or
    non-finite components; with ``label``, null labels too.  Of rows with one
    id the least by (vector, label) counts.  A component whose 256-fold is
    beyond the largest double counts as that.
    """
    scaled = "least(greatest({0}D * x, -1.7976931348623157E308D), 1.7976931348623157E308D)".format(SCALE)
    whole = f"transform(vector, x -> if(abs({scaled}) < {2**52}D, cast(floor({scaled}) AS double), {scaled}))"
    good = (
        table.select(
            F.col(id_column).cast("long").alias("vec_id"),
            F.col(vector).cast("array<double>").alias("vector"),
            (F.lit(0) if label is None else label).cast("long").alias("label"),
        )
        .where("vec_id IS NOT NULL AND vector IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")
        .where("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
        .select("vec_id", "label", F.expr(whole).alias("v"))
    )
    one = good.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("row"))
    return one.select("vec_id", "row.label", F.size("row.v").alias("dim"), "row.v")


def sizes(rows: DataFrame, asked: Column) -> DataFrame:
    """(dim, blocks, lists): how many blocks and query lists the vectors of each length make."""
    least, most = LIST_ROWS
    counted = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"), F.count_if(asked).alias("asked"))
    held = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_VALUES) / F.col("dim")))
    each = F.least(held, F.lit(most), F.greatest(F.lit(least), F.ceil(F.col("asked") / 32)))
    return counted.select(
        "dim", F.ceil(F.col("rows") / held).cast("int").alias("blocks"), F.ceil(F.col("asked") / each).cast("int").alias("lists")
    )


def packed(rows: pd.DataFrame) -> dict:
    """Rows (vec_id, label, v) as arrays in bytes, by id; whole numbers take no more room than they need."""
    rows = rows.sort_values("vec_id")
    x = np.stack(rows["v"].tolist())
    most = np.abs(x).max()
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return {
        "n": len(rows),
        "kind": kind,
        "ids": rows["vec_id"].to_numpy(dtype="<i8").tobytes(),
        "labels": rows["label"].to_numpy(dtype="<i8").tobytes(),
        "vectors": x.astype(kind).tobytes(),
    }


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors (doubles) of a `packed` row."""
    x = np.frombuffer(row.vectors, dtype=row.kind).reshape(row.n, -1)
    return np.frombuffer(row.ids, dtype="<i8"), np.frombuffer(row.labels, dtype="<i8"), x.astype(np.float64)


def blocks_of(rows: DataFrame, of: DataFrame, more: str, build: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """One row (dim, block, lists and what ``build`` makes of its rows) for each block; stored."""

    def whole(keys: tuple, held: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"dim": keys[0], "block": keys[1], "lists": keys[2]} | build(held)])

    placed = rows.join(of.where("lists > 0"), "dim").withColumn("block", F.expr("pmod(xxhash64(vec_id), blocks)").cast("int"))
    schema = f"dim int, block int, lists int, {more}"
    return stored(placed.groupBy("dim", "block", "lists").applyInPandas(whole, schema), "blocks")


def lists_of(rows: DataFrame, of: DataFrame, more: str, build: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """One row (dim, list, blocks and what ``build`` makes of its queries) for each list; stored."""

    def whole(keys: tuple, held: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"dim": keys[0], "list": keys[1], "blocks": keys[2]} | build(held)])

    placed = rows.join(of.where("lists > 0"), "dim").withColumn("list", F.expr("pmod(xxhash64(vec_id, 1), lists)").cast("int"))
    schema = f"dim int, list int, blocks int, {more}"
    return stored(placed.groupBy("dim", "list", "blocks").applyInPandas(whole, schema), "lists")


def met(lists: DataFrame, blocks: DataFrame, meet: Callable[[pd.Series, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """``meet`` of each list with each block of the same vector length, a task's work at a time.

    A list travels to every block and a block to every list, so that each
    meeting needs no more memory than the two.
    """

    def once(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return meet(next(asked.itertuples()), next(held.itertuples()))

    to_blocks = lists.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    to_lists = blocks.withColumn("list", F.explode(F.expr("sequence(0, lists - 1)")))
    return to_blocks.groupBy(*KEYS).cogroup(to_lists.groupBy(*KEYS)).applyInPandas(once, schema)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of each row of ``a`` with each of ``b``, exactly; those beyond a long's range are its ends."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if greatest(a, b) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole_a, whole_b = ([[int(x) for x in row] for row in m] for m in (a, b))
    sums = [[sum(map(int.__mul__, p, q)) for q in whole_b] for p in whole_a]
    return np.array([[max(-LONG, min(LONG - 1, s)) for s in row] for row in sums], dtype=np.int64)


def greatest(a: np.ndarray, b: np.ndarray) -> float:
    """What no inner product of two rows exceeds."""
    with np.errstate(over="ignore"):
        return float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` highest scores are, highest first, ties to the smaller id."""
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bound)
        # Not the negated score: the least long has none.
        return near[np.lexsort((-ids[near], scores[near]))[::-1][:k]]
    return np.lexsort((-ids, scores))[::-1][:k]
