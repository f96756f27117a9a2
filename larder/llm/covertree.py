"""Embedding near-dedup: cover trees over parts of the vectors, traversed in pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import valid_vectors
from larder.llm.components import components
from larder.session import stored

THRESHOLD = 0.9
#: Vectors of one tree.
BLOCK = 4096
#: Cells of the coarsest level, at most, and the vectors they are chosen from.
CELLS = 64
SAMPLE = 4096
#: Radii of the levels below the cells; each is half of the one above.
RADII = (0.5, 0.25, 0.125, 0.0625)
#: Bounds are widened by this, so that rounding prunes and includes nothing.
SLACK = 1e-3
#: Nodes that reach no farther are compared with one bound for all of them.
TIGHT = 0.05
#: Pairs that are compared at once.
PAIRS = 2_000_000


def normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def cover(x: np.ndarray) -> np.ndarray:
    """The node that covers each row at each level: level -> row -> row.

    A node at one level is a node at all lower ones.  The rows under a node are
    covered, at the next level, by the node itself and then by rows among them
    that are farther than its radius from those chosen before.
    """
    levels, above = [], np.zeros(len(x), dtype=np.int64)
    for radius in RADII:
        own = np.arange(len(x))
        order = np.lexsort((own != above, above))
        cuts = np.flatnonzero(np.diff(above[order])) + 1
        for rest in np.split(order, cuts):
            while len(rest) > 1:
                node = rest[0]
                near = ((x[rest] - x[node]) ** 2).sum(axis=1) <= radius * radius
                near[0] = True
                own[rest[near]] = node
                rest = rest[~near]
        levels.append(own)
        above = own
    return np.array(levels)


@dataclass
class CoverTree:
    """Rows with the nodes that cover them; ``reach`` is a node's largest distance to a row under it."""

    x: np.ndarray
    levels: np.ndarray
    copies: np.ndarray

    def __post_init__(self) -> None:
        self.unit = normalised(self.x).astype(np.float32)
        self.nodes, self.reach, self.weight, self.below = [], [], [], []
        n = len(self.x)
        for level, own in enumerate([*self.levels, np.arange(n)]):
            reach, weight = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.int64)
            np.maximum.at(reach, own, np.sqrt(((self.unit - self.unit[own]) ** 2).sum(axis=1)))
            np.add.at(weight, own, self.copies)
            self.nodes.append(np.unique(own))
            self.reach.append(reach)
            self.weight.append(weight)
            if level:
                held = self.nodes[level]
                parent = self.levels[level - 1][held]
                order = np.argsort(parent, kind="stable")
                parents = self.nodes[level - 1]
                self.below.append((held[order], np.searchsorted(parent[order], np.arange(n + 1)), parents))

    def covering(self, level: int) -> np.ndarray:
        return self.levels[level] if level < len(self.levels) else np.arange(len(self.x))


def _spread(tree: CoverTree, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children at ``level`` + 1 of each node in ``at``: (index into ``at``, child)."""
    held, starts, _ = tree.below[level]
    n = starts[at + 1] - starts[at]
    index = np.repeat(np.arange(len(at)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return index, held[starts[at][index] + place]


def linked(a: CoverTree, b: CoverTree, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Copies within the threshold of each row of ``a`` in ``b`` and the reverse, and what joins them.

    A pair of nodes is dropped if no two rows under them can be near enough,
    and taken as a whole, without looking below, if all must be: then the rows
    under each are joined through the nodes.  Other pairs are compared child by
    child; at the last level the cosine decides.  Joins are (level, node of
    ``a``, node of ``b``).
    """
    radius = np.float32(np.sqrt(2 - 2 * threshold))
    last = len(a.levels)
    to_a = [np.zeros(len(a.x), dtype=np.int64) for _ in range(last + 1)]
    to_b = [np.zeros(len(b.x), dtype=np.int64) for _ in range(last + 1)]
    joins: list[tuple[int, int, int]] = []
    open_pairs = _roots(a, b, radius)
    for level in range(last + 1):
        follow = []
        for i, j in open_pairs:
            apart = np.sqrt(((a.unit[i] - b.unit[j]) ** 2).sum(axis=1))
            both = a.reach[level][i] + b.reach[level][j]
            near = apart <= radius + both + SLACK
            i, j, apart, both = i[near], j[near], apart[near], both[near]
            if level == last:
                sure = cosines(a.x[i], b.x[j]) >= threshold
            else:
                sure = apart + both <= radius - SLACK
                follow.append((i[~sure], j[~sure]))
            i, j = i[sure], j[sure]
            np.add.at(to_a[level], i, b.weight[level][j])
            np.add.at(to_b[level], j, a.weight[level][i])
            joins += zip([level] * len(i), i.tolist(), j.tolist(), strict=True)
        open_pairs = (p for i, j in follow for p in _children(a, b, level, i, j)) if level < last else iter(())
        open_pairs = list(open_pairs) if level < last else []
    sums = []
    for tree, counts in ((a, to_a), (b, to_b)):
        sums.append(sum(counts[level][tree.covering(level)] for level in range(last + 1)))
    return sums[0], sums[1], joins


def _roots(a: CoverTree, b: CoverTree, radius: np.float32):
    """Pairs of the top nodes that may hold a link, by one matrix product for each slice.

    Most nodes hold a single row or near copies: for those one bound on the
    product will do, and the caller tests each pair by its own.
    """
    for left in _by_reach(a):
        for right in _by_reach(b):
            if not len(left) or not len(right):
                continue
            most = radius + a.reach[0][left].max() + b.reach[0][right].max() + SLACK
            least = np.float32(1 - most * most / 2 - SLACK)
            others = b.unit[right].T
            step = max(1, PAIRS // len(right))
            for at in range(0, len(left), step):
                part = left[at : at + step]
                i, j = np.nonzero(a.unit[part] @ others >= least)
                yield part[i], right[j]


def _by_reach(tree: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    top = tree.nodes[0]
    tight = tree.reach[0][top] <= TIGHT
    return top[tight], top[~tight]


def _children(a: CoverTree, b: CoverTree, level: int, i: np.ndarray, j: np.ndarray):
    """All pairs of children of each pair, in slices."""
    starts_a, starts_b = a.below[level][1], b.below[level][1]
    size = (starts_a[i + 1] - starts_a[i]) * (starts_b[j + 1] - starts_b[j])
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1
    for p, q in zip(np.split(i, cuts), np.split(j, cuts), strict=True):
        if len(p):
            of, left = _spread(a, level, p)
            again, right = _spread(b, level, q[of])
            yield left[again], right


class Sets:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def forest_of(a: CoverTree, b: CoverTree, joins: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Links between the rows of ``a`` (from 0) and ``b`` (after them) that span what the joins connect."""
    sets, shift = Sets(len(a.x) + len(b.x)), len(a.x)
    merged: set[tuple[int, int, int]] = set()
    under = [[_members(t.covering(level)) for level in range(len(t.levels) + 1)] for t in (a, b)] if joins else []
    for level, i, j in joins:
        sets.union(i, shift + j)
        for side, node, move in ((0, i, 0), (1, j, shift)):
            if (level, side, node) not in merged:
                merged.add((level, side, node))
                order, starts = under[side][level]
                for row in order[starts[node] : starts[node + 1]].tolist():
                    sets.union(move + row, move + node)
    return [(x, sets.find(x)) for x in range(len(sets.up)) if sets.find(x) != x]


def _members(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(len(own) + 1))


def embedding_groups(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table``.

    Equal vectors are one class with a count.  Classes are put into cells, the
    coarsest level, and cells cut into blocks with a cover tree each.  Two
    blocks meet unless their cells' radii keep them apart, and each pair is
    traversed once; a task returns counts and a spanning forest of the links,
    not the pairs.

    Vectors that `valid_vectors` leaves out are not linked and are their own
    component.  A null id keeps its row, without component.  Rows that repeat
    an id each have their links; the id is the component's if it is the
    smallest there.
    """
    rows = stored(valid_vectors(table, id_column, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    counts, links = _dual(classes, threshold, block)
    label = components(links)
    of_class = (
        classes.join(counts, "node", "left")
        .join(label, "node", "left")
        .select("vector", "first", F.coalesce("n", "copies").alias("n"), F.coalesce("component", "node").alias("component"))
    )
    of_class = stored(of_class, "labelled")
    smallest = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    good = rows.join(of_class.join(smallest, "component").select("vector", "n", "component_id"), "vector")
    good = good.select("vec_id", (F.col("n") - 1).alias("n_links"), "component_id")
    return _with_the_rest(table, id_column, vector, rows, good)


def _with_the_rest(table: DataFrame, id_column: str, vector: str, rows: DataFrame, good: DataFrame) -> DataFrame:
    """The rows that take no part: those that `valid_vectors` left out, as often as they are there."""
    all_ids = table.select(F.col(id_column).cast("long").alias("vec_id")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
    used = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("used"))
    left = all_ids.join(used, "vec_id", "left").withColumn("n", F.col("n") - F.coalesce("used", F.lit(0))).where("n > 0")
    alone = left.select("vec_id", F.explode(F.array_repeat(F.lit(0).cast("long"), F.col("n").cast("int"))).alias("n_links"))
    out = good.unionByName(alone.withColumn("component_id", F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())


def _dual(classes: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, n), n with the class's own copies, and links (u, v) between nodes."""
    spark = classes.sparkSession
    n = classes.count()
    if not n:
        none = spark.createDataFrame([], "node long, n long")
        return none, spark.createDataFrame([], "u long, v long")
    pivots = _pivots(classes, min(CELLS, max(1, n // block)))

    @F.pandas_udf("struct<cell: int, apart: double>")
    def nearest_pivot(vectors: pd.Series) -> pd.DataFrame:
        x = normalised(np.stack(vectors.tolist()))
        apart = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
        cell = apart.argmin(axis=1)
        return pd.DataFrame({"cell": cell, "apart": apart[np.arange(len(x)), cell]})

    dealt = classes.select("node", "copies", "vector", nearest_pivot("vector").alias("p")).select("node", "copies", "vector", "p.*")
    dealt = stored(dealt, "cells")
    # One row for each cell, CELLS at most.
    cells = {r.cell: r for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("reach")).collect()}
    parts = {c: -(-r.n // block) for c, r in cells.items()}
    radius = np.sqrt(2 - 2 * threshold)
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    partners = {
        c: [d for d in cells if c == d or between[c, d] <= radius + cells[c].reach + cells[d].reach + SLACK] for c in cells
    }

    def block_of(cell, part):
        return cell.cast("long") * (1 << 32) + part.cast("long")

    n_parts = F.create_map(*[F.lit(x) for c, k in parts.items() for x in (c, k)])
    with_whom = F.create_map(*[x for c, ds in partners.items() for x in (F.lit(c), F.array(*[F.lit(d) for d in ds]))])
    blocks = dealt.withColumn("part", F.pmod(F.xxhash64("node"), n_parts[F.col("cell")]).cast("int"))
    blocks = blocks.select(block_of(F.col("cell"), F.col("part")).alias("block"), "node", "copies", "vector")
    trees = stored(blocks.groupBy("block").applyInPandas(_tree_row, "block long, size int, dims int, tree binary"), "trees")
    cell = F.floor(F.col("block") / (1 << 32)).cast("int")
    met = (
        trees.select("*", F.explode(with_whom[cell]).alias("other_cell"))
        .select("*", F.explode(F.sequence(F.lit(0), n_parts[F.col("other_cell")] - 1)).alias("other_part"))
        .withColumn("other", block_of(F.col("other_cell"), F.col("other_part")))
        .select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "size", "dims", "tree")
    )

    def meet(pair: pd.DataFrame) -> pd.DataFrame:
        trees = [_tree_of(r) for r in pair.sort_values("block").itertuples()]
        (ids_a, a), (ids_b, b) = trees[0], trees[-1]
        to_a, to_b, joins = linked(a, b, threshold)
        found = [np.stack([ids_a, np.full(len(ids_a), -1), to_a], axis=1)]
        if len(trees) > 1:
            found.append(np.stack([ids_b, np.full(len(ids_b), -1), to_b], axis=1))
        ids = np.concatenate([ids_a, ids_b])
        spans = np.array(forest_of(a, b, joins), dtype=np.int64).reshape(-1, 2)
        found.append(np.stack([ids[spans[:, 0]], ids[spans[:, 1]], np.zeros(len(spans), dtype=np.int64)], axis=1))
        out = np.concatenate(found)
        return pd.DataFrame(out[(out[:, 1] >= 0) | (out[:, 2] > 0)], columns=["node", "v", "n"])

    found = stored(met.groupBy("i", "j").applyInPandas(meet, "node long, v long, n long"), "links")
    counts = found.where("v < 0").groupBy("node").agg(F.sum("n").alias("n"))
    return counts, found.where("v >= 0").select(F.col("node").alias("u"), "v")


def _pivots(classes: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors of a bounded sample, each the farthest from those before."""
    rows = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector").collect()
    x = normalised(np.array([r.vector for r in rows]))
    chosen, apart = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _tree_row(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's tree as one row, so that it travels to its partners as a whole."""
    x = np.stack(rows["vector"].tolist())
    levels = cover(normalised(x).astype(np.float32))
    parts = (rows["node"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), levels.astype(np.int32), x)
    tree = b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "size": [len(x)], "dims": [x.shape[1]], "tree": [tree]})


def _tree_of(row) -> tuple[np.ndarray, CoverTree]:
    n, at = row.size, 0
    parts = []
    for kind, count in ((np.int64, n), (np.int64, n), (np.int32, n * len(RADII)), (np.float64, n * row.dims)):
        parts.append(np.frombuffer(row.tree, dtype=kind, count=count, offset=at))
        at += parts[-1].nbytes
    ids, copies, levels, x = parts
    return ids, CoverTree(x.reshape(n, -1), levels.reshape(len(RADII), n).astype(np.int64), copies)
