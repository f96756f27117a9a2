"""Toxicity by compression distance: how much better a toxic dictionary packs a text's windows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import crc_of_id, text_or_empty
from larder.session import stored

#: Labelled documents that are learnt from, at most: toxic ones, others.
SAMPLE = (2000, 4000)
#: Rows with this remainder of the id's CRC are held out.
FOLDS, HELD_OUT = 5, 0
#: Bytes of the dictionaries: what toxic and ordinary text have by themselves, and what both share.
OWN, SHARED = 1024, 4096
#: A term is a word's beginning of this many characters or more ...
SHORTEST, LONGEST = 4, 24
#: ... and is toxic from this log-likelihood ratio.
LEAST_RATIO = 25.0
#: Ordinary windows taken of a document, evenly over its length, and their words.
WINDOWS, WINDOW_WORDS = 16, 12
LEVEL, LEAST_MATCH = 7, 5
#: A window is a word, or so many bytes of a longer one.
WINDOW_BYTES = 64
#: Savings are counted in bins from -BINS to BINS bytes.
BINS = 8
#: Windows whose result is remembered in a task.
REMEMBERED = 500_000
#: Frames each window, so that what differs between two compressors is the window alone.
FRAME = b"0123456789abcdefghijklmnopqrstuvwxyz"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().translate(LOWER))


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights of a text's counts of savings."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def compressor(content: bytes):
    """Compressed size under a dictionary of plain content, without headers."""
    own = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, window_log=17, min_match=LEAST_MATCH, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=own).compress


def counter(toxic: bytes, ordinary: bytes):
    """A function from a text to its features."""
    by_toxic, by_ordinary = compressor(toxic), compressor(ordinary)
    known: dict[bytes, int] = {}

    def saved(window: bytes) -> int:
        framed = FRAME + b" " + window + b"\n" + FRAME[:16]
        return max(-BINS, min(BINS, len(by_ordinary(framed)) - len(by_toxic(framed))))

    def features(text: str) -> np.ndarray:
        counts = np.zeros(2 * BINS + 1)
        for word, n in Counter(words_of(text)).items():
            for at in range(0, len(word), WINDOW_BYTES):
                window = word[at : at + WINDOW_BYTES]
                if (own := known.get(window)) is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    own = known[window] = saved(window)
                counts[own + BINS] += n
        return np.concatenate([np.log1p(counts), 10 * counts / max(1.0, counts.sum())])

    return features


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold; of several labels the highest counts."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_of_id() % FOLDS != HELD_OUT)
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sampled(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, half) of a bounded sample by hash of the id; half 0 trains dictionaries, half 1 calibrates."""
    known = learnable(labels).withColumn("h", F.xxhash64("doc_id"))
    first = [known.where(of).orderBy("h", "doc_id").limit(n) for of, n in (("toxic = 1", sample[0]), ("toxic <> 1", sample[1]))]
    chosen = first[0].union(first[1]).select("doc_id", "toxic", F.pmod(F.shiftright("h", 32), F.lit(2)).cast("int").alias("half"))
    # The sample is bounded, so it may be broadcast.  Of rows with one id the text of least checksum is learnt from.
    text = text_or_empty()
    of = docs.select("doc_id", text.alias("text"), F.crc32(text.cast("binary")).alias("crc")).join(F.broadcast(chosen), "doc_id")
    one = of.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic", "half"), F.struct("crc", "text")).alias("row"))
    return one.select("doc_id", "row.*")


def beginnings(words: set[bytes]) -> set[str]:
    texts = (w.decode() for w in words)
    return {t[:k] for t in texts for k in range(SHORTEST, min(len(t), LONGEST) + 1)}


def toxic_terms(sample: DataFrame) -> dict[str, float]:
    """Beginnings of words that toxic documents have more often, by log-likelihood ratio."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
                for term in beginnings(set(words_of(text))):
                    counts.setdefault(term, [0, 0])[int(toxic == 1)] += 1
            yield pd.DataFrame([(t, a, b) for t, (a, b) in counts.items()], columns=["term", "ordinary", "toxic"])

    n = sample.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not n.b or n.b == n.n:
        return {}
    counts = sample.mapInPandas(count, "term string, ordinary long, toxic long").groupBy("term")
    a, b = F.sum("ordinary").alias("a"), F.sum("toxic").alias("b")
    both, share = F.col("a") + F.col("b"), n.b / n.n

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("a"), both * (1 - share)) + part(F.col("b"), both * share))
    terms = counts.agg(a, b).where(F.col("b") > both * share).withColumn("ratio", ratio).where(F.col("ratio") > LEAST_RATIO)
    # The sample is bounded, and so are its terms.
    return {r.term: r.ratio for r in terms.orderBy(F.desc("ratio"), "term").collect()}


def training_text(sample: DataFrame, terms: dict[str, float]) -> tuple[list[bytes], list[bytes]]:
    """What the dictionaries are trained on: the toxic terms of each toxic document, and windows of the others."""

    def best(word: bytes) -> bytes:
        text = word.decode()
        options = [(terms[text[:k]], k) for k in range(SHORTEST, min(len(text), LONGEST) + 1) if text[:k] in terms]
        return text[: max(options)[1]].encode() if options else b""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc_id, text, toxic in zip(rows["doc_id"], rows["text"], rows["toxic"], strict=True):
                words = words_of(text)
                if toxic == 1:
                    held = sorted({best(w) for w in set(words)} - {b""})
                    if held:
                        out.append((doc_id, 1, 0, b" " + b" ".join(held)))
                else:
                    step = max(WINDOW_WORDS, len(words) // WINDOWS)
                    for i in range(0, len(words), step):
                        out.append((doc_id, 0, i, b" " + b" ".join(words[i : i + WINDOW_WORDS])[:400]))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "at", "window"])

    rows = sample.mapInPandas(extract, "doc_id long, toxic int, at int, window binary").toPandas()
    rows = rows.sort_values(["toxic", "doc_id", "at"], kind="stable")
    return [bytes(w) for w in rows.loc[rows.toxic == 1, "window"]], [bytes(w) for w in rows.loc[rows.toxic == 0, "window"]]


def dictionary(size: int, texts: list[bytes]) -> bytes:
    """Trained content of ``size`` bytes at most; of too few texts, the texts themselves."""
    texts = [t for t in texts if len(t) >= 8]
    try:
        # The content is the end of a trained dictionary.
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def trained(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """Dictionaries of one half of the sample, weights of the other.

    Both dictionaries hold the same ordinary text; beside it, the toxic one
    what was trained on toxic terms, the ordinary one as much other ordinary
    text.  So windows that neither knows better compress alike.
    """
    rows = stored(sampled(docs, labels, sample), "sample")
    first = rows.where("half = 0")
    terms = toxic_terms(first)
    toxic, ordinary = training_text(first, terms)
    shared, own = dictionary(SHARED, ordinary[::2]), dictionary(OWN, toxic)
    # Terms too rare for the trained content stand before it.
    held = sorted({t for window in toxic for t in window.split()}, key=lambda t: (terms[t.decode()], t))
    own = b"".join(b" " + t for t in held if b" " + t not in own) + own
    more = dictionary(max(OWN, len(own)), ordinary[1::2])
    contents = own + shared, more[-len(own) :] + shared if own else shared

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = counter(*contents)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "toxic": rows["toxic"], "x": [features(t).tolist() for t in rows["text"]]})

    known = rows.where("half = 1").mapInPandas(vectors, "doc_id long, toxic int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(known["x"].tolist()).reshape(len(known), -1) if len(known) else np.zeros((0, 4 * BINS + 2))
    weights = logistic(x, (known["toxic"] == 1).to_numpy(float))
    return Model(*contents, weights[:-1], float(weights[-1]))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights, with the bias last, by Newton's method; of one class only, that class for all."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(slope, x.T @ (p - y) + ridge * w)
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Each word of a text is a window, compressed by the toxic and the ordinary
    dictionary between the same frames.  The bytes that the toxic one saves are
    counted by size over the whole text, and a logistic calibration of these
    counts is the score.

    Null texts are empty and have the score of no windows.  Null ids are not
    held out.  Without toxic labels to learn from, all scores are below a half.
    Repeated rows have equal scores; other columns are ignored.
    """
    model = trained(docs, labels, sample)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = counter(model.toxic, model.ordinary)
        for texts in batches:
            yield pd.Series(model.scores(np.array([features(t) for t in texts]).reshape(len(texts), -1)))

    held_out = F.coalesce(crc_of_id() % FOLDS == HELD_OUT, F.lit(False)).alias("held_out")
    out = docs.select("doc_id", held_out, score(text_or_empty()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
