"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import valid_vectors
from larder.session import stored

NEIGHBOURS = 10
TREES = 8
#: Rows the trees' planes are fitted on, at most; every row is indexed.
SAMPLE = 8192
#: Sampled rows of a leaf.
LEAF = 128
#: Rows of a leaf, and queries, that meet in one task.
CHUNK = 4096
SEED = 97


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in heap order: plane ``i`` parts nodes 2i+1 and 2i+2."""

    normals: np.ndarray
    offsets: np.ndarray
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distance of each row to each plane."""
        return x @ self.normals.T - self.offsets

    def leaves(self, margins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(margins), dtype=np.int64), np.arange(len(margins))
        for _ in range(self.depth):
            node = 2 * node + 1 + (margins[rows, node] > 0)
        return node - (2**self.depth - 1)


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Random directions, cut at the median of the sample that reaches the node."""
    normals = rng.standard_normal((2**depth - 1, x.shape[1]))
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    offsets, node = np.zeros(len(normals)), np.zeros(len(x), dtype=np.int64)
    for i in range(len(normals)):
        here = node == i
        if here.any():
            along = x[here] @ normals[i]
            offsets[i] = np.median(along)
            node[here] = 2 * i + 1 + (along > offsets[i])
    return Tree(normals, offsets, depth)


def fit(vectors: DataFrame, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, seed: int = SEED) -> list[Tree]:
    """A forest over a bounded sample, the rows of the smallest id hashes."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select("vector").collect()
    x = np.array([r.vector for r in rows])
    depth = max(0, int(np.log2(max(1, len(x)) / leaf)))
    rng = np.random.default_rng(seed)
    return [grow(x, depth, rng) for _ in range(trees)] if len(x) else []


def visits(trees: list[Tree], x: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(row, tree, leaf) of the ``most`` leaves that each query should see first.

    All roots share one queue, ordered by the largest margin by which the way
    to a node left the query's own side.
    """
    margins = [t.margins(x) for t in trees]
    for row in range(len(x)):
        queue = [(0.0, t, 0) for t in range(len(trees))]
        seen = 0
        while queue and seen < most:
            worst, t, node = heapq.heappop(queue)
            if node >= len(trees[t].offsets):
                seen += 1
                yield row, t, node - len(trees[t].offsets)
                continue
            margin = margins[t][row, node]
            near = 2 * node + 1 + int(margin > 0)
            heapq.heappush(queue, (worst, t, near))
            heapq.heappush(queue, (max(worst, abs(margin)), t, 4 * node + 3 - near))


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest rows of each query with another id; distances from the differences themselves."""
    scale = (rows**2).sum(axis=1)
    out = []
    for at in range(0, len(queries), 256):
        q, own = queries[at : at + 256], query_ids[at : at + 256]
        about = (q**2).sum(axis=1)[:, None] + scale - 2 * q @ rows.T
        about[own[:, None] == ids] = np.inf
        if len(ids) > k:
            bound = np.partition(about, k - 1, axis=1)[:, k - 1]
            size = (q**2).sum(axis=1) + scale.max()
            hit = about <= (bound + 1e-9 * size)[:, None]
        else:
            hit = about < np.inf
        i, j = np.nonzero(hit & np.isfinite(about))
        exact = np.sqrt(((q[i] - rows[j]) ** 2).sum(axis=1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < k
        out.append((own[i[kept]], ids[j[kept]], exact[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def forest_neighbours(
    table: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    every: int = 100,
    k: int = NEIGHBOURS,
    trees: int = TREES,
    sample: int = SAMPLE,
    chunk: int = CHUNK,
) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``.

    The forest's planes come from a bounded sample; every row is put into its
    leaf of each tree.  A query takes leaves from one priority queue over all
    trees until it has seen a quarter more than one tree has, and ``trees`` more:
    somewhat more rows than the table holds, spread over the parts of all trees
    nearest to it.  In 64 dimensions without structure fewer find too little.  Rows and queries
    meet by leaf, each meeting returns each query's best by exact distance, and
    those are ranked.  Leaves and query lists longer than ``chunk`` meet in
    parts, so equal vectors in one leaf stay within a task's memory.

    Vectors that `valid_vectors` leaves out take no part.  Ties go to the
    smaller id; of rows with one id the nearest counts; a row is no neighbour
    of its own id.  An empty table has no neighbours.
    """
    rows = stored(valid_vectors(table, id_column, vector), "vectors")
    forest = fit(rows, trees, sample)
    schema = "query_id long, vec_id long, score double"
    if not forest:
        ranked = rows.select("vec_id", F.col("vec_id").alias("query_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        return ranked.select("query_id", "rank", "vec_id", "score")
    leaves = 2 ** forest[0].depth

    @F.pandas_udf("array<int>")
    def own_leaves(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.tolist())
        found = [t * leaves + tree.leaves(tree.margins(x)) for t, tree in enumerate(forest)]
        return pd.Series(list(np.stack(found, axis=1).astype(np.int32)))

    @F.pandas_udf("array<int>")
    def seen_leaves(vectors: pd.Series) -> pd.Series:
        found: list[list[int]] = [[] for _ in range(len(vectors))]
        for row, t, leaf in visits(forest, np.stack(vectors.tolist()), leaves + leaves // 4 + trees):
            found[row].append(t * leaves + leaf)
        return pd.Series(found)

    asked = rows.where(F.col("vec_id") % every == 0)
    placed = rows.select("vec_id", "vector", F.explode(own_leaves("vector")).alias("leaf"))
    # One count for each leaf of a forest whose depth the sample bounds.
    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}
    parts = F.create_map(*[F.lit(int(x)) for leaf, n in counts.items() for x in (leaf, -(-n // chunk))])[F.col("leaf")]
    lists = max(1, -(-asked.count() // chunk))
    placed = placed.select(
        "leaf",
        F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"),
        "vec_id",
        "vector",
    )
    asked = asked.select("vec_id", "vector", F.explode(seen_leaves("vector")).alias("leaf")).where(parts.isNotNull())
    asked = asked.select(
        "leaf",
        F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"),
        F.pmod(F.xxhash64("vec_id"), F.lit(lists)).cast("int").alias("list"),
        "vec_id",
        "vector",
    )

    def meet(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = nearest(
            np.stack(queries["vector"].tolist()), queries["vec_id"].to_numpy(), np.stack(held["vector"].tolist()), held["vec_id"].to_numpy(), k
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["leaf", "part", "list"]
    met = asked.groupBy(keys).cogroup(placed.groupBy(keys)).applyInPandas(meet, schema)
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
