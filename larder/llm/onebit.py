"""Hard-negative mining with rotated one-bit codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.blocks import EXACT, LONG, PACKED, blocks_of, first, inner, integer_vectors, lists_of, met, packed, sizes, unpacked
from larder.session import stored

EVERY = 100
POSITIVES = 5
NEGATIVES = 5
#: One-bit codes of a vector: each codes, newly rotated, what those before left.
STAGES = 4
#: Bits of a query's components where codes are counted.
QUERY_BITS = 6
SEED = 4242
#: Bounds are widened by this share of the norms' product, for rounding.
SLACK = 1e-9
INDEX = f"{PACKED}, codes binary, aligned binary, rest binary, norms binary"


def rotated(x: np.ndarray, stage: int) -> np.ndarray:
    """Rows, filled up to a power of two, under a random rotation: three times random signs and a Hadamard transform."""
    size = 1 << max(6, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, stage, size])
    for _ in range(3):
        y = y * rng.choice([-1.0, 1.0], size)
        half = 1
        while half < size:
            y = y.reshape(len(x), -1, 2, half)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
            half *= 2
        y = y.reshape(len(x), size) / np.sqrt(size)
    return y


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (stage, row, words), the alignment of each stage's code vector with what it codes, and the norm left after all.

    A code vector has components of one size and the signs of what it codes,
    so the alignment is the inner product of the two.
    """
    codes, aligned, left = [], [], x
    for stage in range(STAGES):
        left = rotated(left, stage)
        root = np.sqrt(left.shape[1])
        positive = left >= 0
        codes.append(np.packbits(positive, axis=1, bitorder="little").view("<u8"))
        along = np.abs(left).sum(axis=1) / root
        aligned.append(along)
        left = left - np.where(positive, 1.0, -1.0) * (along / root)[:, None]
    return np.array(codes), np.array(aligned), np.sqrt((left**2).sum(axis=1))


def _indexed(rows: pd.DataFrame) -> dict:
    x = np.stack(rows.sort_values("vec_id")["v"].tolist())
    with np.errstate(over="ignore", invalid="ignore"):
        codes, aligned, rest = coded(x)
        norms = np.sqrt((x**2).sum(axis=1))
    return packed(rows) | {"codes": codes.tobytes(), "aligned": aligned.tobytes(), "rest": rest.tobytes(), "norms": norms.tobytes()}


class CodeIndex:
    """A block's rows with their codes."""

    def __init__(self, row):
        self.ids, self.labels, self.x = unpacked(row)
        self.codes = np.frombuffer(row.codes, dtype="<u8").reshape(STAGES, row.n, -1)
        self.aligned = np.frombuffer(row.aligned).reshape(STAGES, row.n)
        self.rest, self.norms = np.frombuffer(row.rest), np.frombuffer(row.norms)

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of every row's score with ``q``; not numbers where the norms are beyond doubles.

        A score is the sum over the stages of alignment times the query's
        product with the code vector, and the query's product with what is
        left, which by Cauchy-Schwarz is at most the product of the norms.
        The product with a code vector comes from counting common bits of the
        code and of the query's quantised components; what quantising moves is
        at most the sum of the moves.
        """
        norm = np.sqrt((q**2).sum())
        middle, half, left = np.zeros(len(self.ids)), norm * self.rest, q[None, :]
        for stage in range(STAGES):
            left = rotated(left, stage)
            size = left.shape[1]
            low, span = left.min(), left.max() - left.min()
            step = span / (2**QUERY_BITS - 1) or 1.0
            k = np.rint((left[0] - low) / step).astype(np.int64)
            moved = np.abs(left[0] - (low + step * k)).sum() / np.sqrt(size)
            code = self.codes[stage]
            common = np.zeros(len(self.ids), dtype=np.int64)
            for b in range(QUERY_BITS):
                plane = np.packbits((k >> b & 1).astype(bool), bitorder="little").view("<u8")
                common += np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) << b
            ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
            product = (step * (2 * common - k.sum()) + low * (2 * ones - size)) / np.sqrt(size)
            middle += self.aligned[stage] * product
            half = half + self.aligned[stage] * moved
        half = half + SLACK * norm * self.norms
        return middle - half, middle + half

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            if not np.isfinite((q**2).sum()):
                nothing = np.full(len(self.ids), np.nan)
                return nothing, nothing
            low, high = self.intervals(q)
            return np.clip(low, -LONG, LONG), np.clip(high, -LONG, LONG)

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return inner(q[None, :], self.x[rows])[0]

    def positives(self, q: np.ndarray, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows of the same label other than ``own``."""
        rows = np.flatnonzero((self.labels == label) & (self.ids != own))
        if len(rows) > k:
            low, high = (b[rows] for b in self.bounds(q))
            sure = np.partition(np.nan_to_num(low, nan=-np.inf), len(rows) - k)[len(rows) - k]
            # The rows of highest estimate, scored, give a higher bound that the best reach.
            likely = rows[np.argsort(-np.nan_to_num(low + high))[: 4 * k]]
            reached = np.sort(self.scores(q, likely))[-k]
            rows = rows[~(high < max(sure, float(reached)))]
        scores = self.scores(q, rows)
        top = first(scores, self.ids[rows], k)
        return self.ids[rows[top]], scores[top]

    def negatives(self, q: np.ndarray, label: int, wanted: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive score wanted, the ``k`` best rows of another label at 80 to 100 % of it."""
        nothing = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        able = [p for p in wanted if p >= 0]
        if not able:
            return [nothing] * len(wanted)
        low, high = self.bounds(q)
        outside = (high < 0.8 * min(able) * (1 - SLACK)) | (low > max(able) * (1 + SLACK))
        rows = np.flatnonzero(~outside & (self.labels != label))
        scores = self.scores(q, rows)
        large = len(scores) and max(map(abs, (int(scores.max()), int(scores.min()), *able))) >= EXACT
        wide = scores.astype(object) if large else scores
        out = []
        for p in wanted:
            fit = np.flatnonzero((4 * p <= 5 * wide) & (wide <= p)) if p >= 0 else np.zeros(0, dtype=np.int64)
            top = fit[first(scores[fit], self.ids[rows[fit]], k)]
            out.append((self.ids[rows[top]], scores[top]))
        return out


def hard_negatives(
    table: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each row whose id is divisible by ``every``.

    An anchor's positives are the best other rows of its label by integer
    inner product of floor(256 x); its hard negatives for each of them the
    best rows of other labels that score 80 to 100 % of the positive.

    Rows are kept in blocks with ``STAGES`` one-bit codes each: the signs
    after a random rotation, and the stored alignment of that code vector with
    the vector.  Counting bits estimates a score; what the codes leave bounds
    the error, by Cauchy-Schwarz and for certain.  Only rows whose interval can
    matter are scored, so the result is exact.  Every anchor meets every
    block, in lists; the best of all blocks are ranked.

    Rows that `integer_vectors` leaves out, and those without a label, take no
    part; a repeated id counts once.  Ties go to the smaller id.  A positive
    of negative score has no negatives.  Scores beyond a long's range are its
    ends.  Vectors of different length do not meet.  Other columns are
    ignored; an empty table has no results.
    """
    rows = stored(integer_vectors(table, id_column, vector, F.col(label)), "vectors")
    asked = F.col("vec_id") % every == 0
    of = stored(sizes(rows, asked), "sizes")
    index = blocks_of(rows, of, INDEX, _indexed)
    anchors = rows.where(asked)

    def meet_positives(asked, held) -> pd.DataFrame:
        block = CodeIndex(held)
        ids, labels, x = unpacked(asked)
        found = [block.positives(q, own, own_label, positives) for own, own_label, q in zip(ids.tolist(), labels.tolist(), x, strict=True)]
        return pd.DataFrame(
            {
                "anchor_id": np.repeat(ids, [len(f[0]) for f in found]),
                "positive_id": np.concatenate([f[0] for f in found]),
                "positive_score": np.concatenate([f[1] for f in found]),
            }
        )

    best = met(lists_of(anchors, of, PACKED, packed), index, meet_positives, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = stored(best.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "positives")
    # At most as many positives as asked for in an anchor's list.
    held = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("wanted"))
    known = anchors.join(held.withColumnRenamed("anchor_id", "vec_id"), "vec_id")

    def with_wanted(held: pd.DataFrame) -> dict:
        rows = [(w["positive_id"], w["positive_score"]) for of in held.sort_values("vec_id")["wanted"] for w in of]
        counts = [len(of) for of in held.sort_values("vec_id")["wanted"]]
        return packed(held) | {"counts": np.array(counts, dtype="<i8").tobytes(), "wanted": np.array(rows, dtype="<i8").tobytes()}

    def meet_negatives(asked, held) -> pd.DataFrame:
        block = CodeIndex(held)
        ids, labels, x = unpacked(asked)
        counts = np.frombuffer(asked.counts, dtype="<i8")
        wanted = np.split(np.frombuffer(asked.wanted, dtype="<i8").reshape(-1, 2), np.cumsum(counts)[:-1])
        found, keys = [], []
        for own, own_label, q, pairs in zip(ids.tolist(), labels.tolist(), x, wanted, strict=True):
            found += block.negatives(q, own_label, pairs[:, 1].tolist(), negatives)
            keys += [(own, positive, score) for positive, score in pairs.tolist()]
        key = np.repeat(np.array(keys), [len(near) for near, _ in found], axis=0)
        columns = {"anchor_id": key[:, 0], "positive_id": key[:, 1], "negative_id": np.concatenate([near for near, _ in found])}
        return pd.DataFrame(columns | {"positive_score": key[:, 2], "negative_score": np.concatenate([scores for _, scores in found])})

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    lists = lists_of(known, of, f"{PACKED}, counts binary, wanted binary", with_wanted)
    mined = met(lists, index, meet_negatives, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = mined.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
