"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import text_or_empty

BUCKETS = 2048
SIGNS = 8
#: Graded documents that the model is fitted on, at most.
SAMPLE = 6000
STEPS = 300
#: Texts whose vectors are held at once when scoring.
SLICE = 256
PENALTY = 2e-4
#: A document is selected if its grade is this or higher ...
LEAST_GRADE = 1
#: ... with this probability at least.
LEAST_PROBABILITY = 0.5


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams and byte kinds, and signs of repetition.

    The first buckets hold trigrams, the next 64 bytes by themselves in four
    times the weight, both scaled to length 1; the last eight how much of the
    text repeats its previous word, its words, its lines, and its commonest
    word.  An empty text is all zeros.
    """
    out = np.zeros(BUCKETS, dtype=np.float32)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return out
    codes = raw.astype(np.uint32)
    grams = BUCKETS - 64 - SIGNS
    if len(raw) > 2:
        hashed = ((codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761)) >> np.uint32(12)
        out[:grams] = np.bincount(hashed % np.uint32(grams), minlength=grams) / len(raw)
    out[grams:-SIGNS] = np.bincount(raw >> 2, minlength=64) / len(raw) * 4
    out = np.sqrt(out)
    out /= np.linalg.norm(out)
    words, lines = text.split(), text.split("\n")
    counts = Counter(words)
    n = max(1, len(words))
    signs = (
        sum(map(eq, words, words[1:])) / n,
        1 - len(counts) / n if words else 0,
        1 - len(set(lines)) / len(lines),
        max(counts.values(), default=0) / n,
    )
    out[-SIGNS:] = [*signs, *(float(s > 0.3) for s in signs)]
    return out


@dataclass(frozen=True)
class CumulativeLink:
    """P(grade > k) = 1 / (1 + exp(thresholds[k] - weights . x)), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > 0), P(grade > 1), ... of each row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - (x @ self.weights.astype(x.dtype))[:, None], -60, 60)))


def fit(x: np.ndarray, grade: np.ndarray, grades: int, steps: int = STEPS, penalty: float = PENALTY) -> CumulativeLink:
    """Maximum likelihood by Adam over all rows; the same rows give the same model.

    Thresholds are a first one and positive steps, so they stay in order.
    Without any rows every tail is a half.
    """
    w, first, gaps = np.zeros(x.shape[1]), 0.0, np.zeros(grades - 2)
    state = [np.zeros(x.shape[1] + grades - 1) for _ in range(2)]
    rows = np.arange(len(x))
    for t in range(1, steps + 1 if len(x) else 1):
        cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        tail = 1 / (1 + np.exp(np.clip(cuts - (x @ w.astype(x.dtype))[:, None], -60, 60)))
        edges = np.concatenate([np.ones((len(x), 1)), tail, np.zeros((len(x), 1))], axis=1)
        p = np.maximum(edges[rows, grade] - edges[rows, grade + 1], 1e-9)
        slope = edges * (1 - edges)
        up, down = slope[rows, grade] / p, slope[rows, grade + 1] / p
        d_cut = np.zeros((len(x), grades + 1))
        d_cut[rows, grade] -= up
        d_cut[rows, grade + 1] += down
        d_cut = d_cut[:, 1:-1].mean(axis=0)
        later = np.cumsum(d_cut[::-1])[::-1]
        gradient = -np.concatenate([(up - down).astype(x.dtype) @ x / len(x) - penalty * w, [later[0]], later[1:] * np.exp(gaps)])
        state[0] += 0.1 * (gradient - state[0])
        state[1] += 0.001 * (gradient**2 - state[1])
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-9)
        w, first, gaps = w - step[: len(w)], first - step[len(w)], gaps - step[len(w) + 1 :]
    return CumulativeLink(w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for low quality, 1 for good but toxic, 2 for good and not toxic.

    Rows with a null are no grades; a doc_id that is labelled more than once
    gets its lowest grade.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def sampled(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, grade, x) of at most ``sample`` graded documents, by hash of the id."""
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "grade": rows["grade"], "x": [features(t).tobytes() for t in rows["text"]]})

    # The sample is bounded, so it may be broadcast.  Of rows with one id the text of least checksum is learnt from.
    text = text_or_empty()
    of = docs.select("doc_id", text.alias("text"), F.crc32(text.cast("binary")).alias("crc")).join(F.broadcast(chosen), "doc_id")
    of = of.groupBy("doc_id").agg(F.min_by(F.struct("grade", "text"), F.struct("crc", "text")).alias("row")).select("doc_id", "row.*")
    return of.mapInPandas(vectors, "doc_id long, grade int, x binary")


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CumulativeLink:
    """The model of a bounded sample of graded documents; repeated documents are taken once."""
    rows = sampled(docs, graded(labels), sample).orderBy("doc_id").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(-1, BUCKETS)
    return fit(x, rows["grade"].to_numpy(dtype=np.int64), 3)


def _tails(model: CumulativeLink):
    @F.pandas_udf("struct<p_good: double, p_clean: double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = [np.zeros((0, 2))]
        # Vectors of a few texts at a time: a worker is used again and keeps what it once needed.
        for i in range(0, len(texts), SLICE):
            out.append(model.tails(np.array([features(t) for t in texts[i : i + SLICE]], dtype=np.float32)))
        return pd.DataFrame(np.concatenate(out), columns=["p_good", "p_clean"])

    return of(text_or_empty())


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Expected grade and tail probabilities of each row of ``docs``.

    ``p_good`` is P(grade >= 1) and ``p_clean`` P(grade >= 2); their sum is the
    expected grade.  A document is selected by the tail at ``LEAST_GRADE``.

    Null texts are empty texts, and those are scored by the thresholds alone.
    Without labels every tail is about a half.  Other columns are ignored;
    repeated rows have equal scores.
    """
    tails = docs.select("doc_id", _tails(trained(docs, labels, sample)).alias("t"))
    keep = (F.col("t.p_good") if LEAST_GRADE == 1 else F.col("t.p_clean")) >= LEAST_PROBABILITY
    return tails.select(
        "doc_id", (F.col("t.p_good") + F.col("t.p_clean")).alias("expected_grade"), "t.p_good", "t.p_clean", keep.alias("selected")
    )


def selected(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier selects."""
    tail = _tails(trained(docs, labels, sample)).getField("p_good" if LEAST_GRADE == 1 else "p_clean")
    return docs.where(tail >= LEAST_PROBABILITY)
