"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.blocks import EXACT, LONG, PACKED, blocks_of, first, greatest, inner, integer_vectors, lists_of, met, packed, sizes, unpacked
from larder.session import stored

TOP = 5
EVERY = 50
#: Bits that an attribute is quantised to.
SLICES = 6
INDEX = f"{PACKED}, shift int, slices binary"


def sliced(x: np.ndarray) -> tuple[int, np.ndarray]:
    """(shift, slices): bitmaps over the rows, one for each bit and attribute.

    An attribute is taken from its smallest value on; the lowest ``shift`` bits
    are left out.  Values too large for that have no slices, and shift -1.
    """
    if np.abs(x).max() >= EXACT / 4:
        return -1, np.zeros(0, dtype=np.uint64)
    u = (x - x.min(axis=0)).astype(np.int64)
    shift = max(0, int(u.max()).bit_length() - SLICES)
    u >>= shift
    words = -(-len(x) // 64)
    bits = np.zeros((SLICES, x.shape[1], words * 8), dtype=np.uint8)
    for i in range(SLICES):
        own = np.packbits(((u >> i) & 1).astype(bool).T, axis=1, bitorder="little")
        bits[i, :, : own.shape[1]] = own
    return shift, bits.view("<u8")


def added(slices: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Bit slices, least first, of the sum of each row's quantised attributes times ``q``, from the least that sum can be.

    ``slices`` holds the bitmaps and, as further attributes, their complements:
    a negative factor counts how far the attribute is from the largest value.
    Bitmaps of one weight are added three at a time: the parity stays, the
    majority is carried to the next weight.
    """
    bits, twice, words = slices.shape
    flat = slices.reshape(bits * twice, words)
    size = np.abs(q)
    own = np.arange(len(q)) + np.where(q < 0, twice // 2, 0)
    held = [own[(size >> b) & 1 == 1] for b in range(int(size.max()).bit_length())]
    planes: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    while len(planes) < bits + len(held) - 1 or carried:
        t = len(planes)
        at = [(t - b) * twice + held[b] for b in range(max(0, t - bits + 1), min(t + 1, len(held)))]
        column = np.concatenate([flat[np.concatenate(at)] if at else flat[:0], *carried])
        carried = []
        while len(column) > 2:
            third = len(column) // 3
            a, b, c = (column[i * third : (i + 1) * third] for i in range(3))
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            column = np.concatenate([odd ^ c, column[3 * third :]])
        if len(column) == 2:
            carried.append(column[:1] & column[1:])
            column = column[:1] ^ column[1:]
        planes.append(column[0] if len(column) else np.zeros(words, dtype=np.uint64))
    return planes


def bound(planes: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The ``k``-th largest sum among ``rows``, of which there are more, from the most significant slice down."""
    value, above = 0, 0
    for plane in reversed(planes):
        ones = rows & plane
        n = int(np.bitwise_count(ones).sum())
        value <<= 1
        if above + n >= k:
            rows, value = ones, value | 1
        else:
            above += n
            rows = rows & ~plane
    return value


def at_least(planes: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Those of ``rows`` whose sum is ``value`` or more."""
    if value <= 0:
        return rows
    if value >> len(planes):
        return rows & np.uint64(0)
    over, equal = np.zeros_like(rows), rows
    for i in range(len(planes) - 1, -1, -1):
        if value >> i & 1:
            equal = equal & planes[i]
        else:
            over = over | (equal & planes[i])
            equal = equal & ~planes[i]
    return over | equal


class BlockIndex:
    """The slices of a block of rows, with the vectors themselves for the boundary."""

    def __init__(self, row):
        self.ids, _, self.x = unpacked(row)
        self.shift = row.shift
        if self.shift >= 0:
            plain = np.frombuffer(row.slices, dtype="<u8").reshape(SLICES, self.x.shape[1], -1)
            self.slices = np.concatenate([plain, ~plain], axis=1)
        held = np.zeros(-(-row.n // 64) * 64, dtype=bool)
        held[: row.n] = True
        self.rows = np.packbits(held, bitorder="little").view("<u8")

    def near(self, q: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Which of ``rows`` can be among the ``k`` best.

        What an attribute's dropped bits add to a score differs between two
        rows by less than ``lost`` in units of the sums, so all rows that far
        below the ``k``-th largest sum are boundary rows.
        """
        if self.shift < 0 or np.abs(q).max() >= EXACT or greatest(q[None, :], self.x) >= LONG or int(np.bitwise_count(rows).sum()) <= k:
            return rows
        q = q.astype(np.int64)
        if not q.any():
            return rows
        planes = added(self.slices, q)
        lost = (((1 << self.shift) - 1) * int(sum(map(abs, q.tolist())))) >> self.shift
        return at_least(planes, rows, bound(planes, rows, k) - lost)

    def best(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the ``k`` best rows other than ``own``."""
        rows = self.rows
        at = int(np.searchsorted(self.ids, own))
        if at < len(self.ids) and self.ids[at] == own:
            rows = rows.copy()
            rows[at >> 6] &= ~np.uint64(1 << (at & 63))
        held = np.flatnonzero(np.unpackbits(self.near(q, rows, k).view(np.uint8), bitorder="little"))
        scores = inner(q[None, :], self.x[held])[0]
        top = first(scores, self.ids[held], k)
        return self.ids[held[top]], scores[top]


def _indexed(rows: pd.DataFrame) -> dict:
    held = packed(rows)
    shift, slices = sliced(np.stack(rows.sort_values("vec_id")["v"].tolist()))
    return held | {"shift": shift, "slices": slices.tobytes()}


def top_inner_products(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = TOP
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner product for each row whose id is divisible by ``every``.

    Components are floor(256 x).  Rows are kept in blocks, each with a
    bit-sliced index: for every attribute, quantised to ``SLICES`` bits, a
    bitmap of the rows for each bit.  A query adds the slices times its
    components by bitmap arithmetic, finds the ``k``-th largest sum from the most
    significant slice down, and scores the boundary rows, those that the
    dropped bits could bring above it, exactly.  The best of all blocks are
    then ranked, so the result is exact.

    Every query meets every block: the work is that of the stated query set
    against all rows.  Vectors of different length do not meet.

    Vectors that `integer_vectors` leaves out take no part; a repeated id
    counts once.  Ties go to the smaller id; a query is no candidate of its
    own; where there are fewer than ``k`` others, all are returned.  Scores
    beyond a long's range are its ends.  Other columns are ignored; an empty
    table has no results.
    """
    rows = stored(integer_vectors(table, id_column, vector), "vectors")
    asked = F.col("vec_id") % every == 0
    of = stored(sizes(rows, asked), "sizes")
    index = blocks_of(rows, of, INDEX, _indexed)
    lists = lists_of(rows.where(asked), of, PACKED, packed)

    def meet(queries, held) -> pd.DataFrame:
        block = BlockIndex(held)
        ids, _, x = unpacked(queries)
        found = [block.best(q, own, k) for own, q in zip(ids.tolist(), x, strict=True)]
        return pd.DataFrame(
            {
                "query_id": np.repeat(ids, [len(f[0]) for f in found]),
                "vec_id": np.concatenate([f[0] for f in found]),
                "score": np.concatenate([f[1] for f in found]),
            }
        )

    best = met(lists, index, meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
