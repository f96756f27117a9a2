"""Best-fit packing of token sequences by large-item matching."""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ranked, text_or_empty
from larder.session import stored

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added token of byte_bpe_50k.json; the ranks don't hold it.
SPECIAL = {"<|endoftext|>": 50256}
#: Runs of white space, as the pattern understands it, that are encoded by themselves.
BLANKS = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
RANGES = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str | None = None):
    """Ids of a byte-level BPE vocabulary, given as ranks; the marker of a text's end is one id, as tokenizers reads it."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return partial(encoded, own)


def encoded(own, text: str) -> list[int]:
    """Ids of a text; long runs of blanks, in which the pattern's search would need too much stack, are cut out.

    The pattern takes a run as one piece, but for its last blank if anything
    other than the marker follows: that belongs to what comes next.
    """
    ids: list[int] = []
    at = 0
    for run in BLANKS.finditer(text):
        start, end = run.span()
        ids += own.encode(text[at:start], allowed_special="all")
        at = end if end == len(text) or text.startswith(tuple(SPECIAL), end) else end - 1
        ids += own._encode_single_piece(text[start:at])
    return ids + own.encode(text[at:], allowed_special="all")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, order: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's tokens, and ``_order``, zero without ``order``.

    A document is its ids and the end id.  Only one longer than ``capacity`` is
    cut: its first piece takes what doesn't fill whole pieces.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for rows in batches:
            out = []
            for doc_id, text, at in zip(rows["doc_id"], rows["text"], rows["_order"], strict=True):
                ids = np.array([*encode(text), END], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), at))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "_order"])

    at = F.coalesce(F.col(order).cast("long"), F.lit(0)) if order else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), at.alias("_order")).mapInPandas(cut, f"{PIECES}, _order long")


@dataclass
class Bins:
    """``count`` bins with the same content, numbered from ``first``."""

    first: int
    count: int
    gap: int

    def split(self, n: int) -> Bins:
        """Take the first ``n`` of them out."""
        own = Bins(self.first, n, self.gap)
        self.first, self.count = self.first + n, self.count - n
        return own


@dataclass
class Plan:
    """Where the items of each length go: runs of ranks to runs of bins."""

    capacity: int
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)
    bins: int = 0

    def open(self, n: int) -> Bins:
        self.bins += n
        return Bins(self.bins - n, n, self.capacity)

    def put(self, length: int, into: Bins) -> None:
        """One item of ``length`` in each of the bins."""
        self.runs.append((length, self.used[length], into.first, self.capacity - into.gap))
        self.used[length] += into.count
        into.gap -= length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``counts`` of items by length; its cost depends on the lengths, not on the counts.

    At most two items above a third of the capacity share a bin: from the
    longest down, each is matched with the longest one that still fits, which
    gives as many pairs as can be.  The shorter ones, from the longest down,
    go into the smallest gap that takes them, or into new bins.
    """
    out, left = Plan(capacity), {k: n for k, n in counts.items() if n}
    gaps: dict[int, list[Bins]] = defaultdict(list)
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for x in large:
        while left.get(x):
            y = next((k for k in large if k <= min(x, capacity - x) and left[k] - (k == x) > 0), None)
            n = left[x] if y is None else left[x] // 2 if y == x else min(left[x], left[y])
            own = out.open(n)
            for k in (x,) if y is None else (x, y):
                out.put(k, own)
                left[k] -= n
            gaps[own.gap].append(own)
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        for gap in range(s, capacity + 1):
            while left[s] and gaps.get(gap):
                left[s] -= _fill(out, gaps, gaps[gap].pop(), s, left[s])
            if not left[s]:
                break
        while left[s]:
            left[s] -= _fill(out, gaps, out.open(-(-left[s] // (capacity // s))), s, left[s])
    return out


def _fill(out: Plan, gaps: dict[int, list[Bins]], held: Bins, s: int, n: int) -> int:
    """Put up to ``n`` items into ``held``, each bin filled before the next; how many."""
    each = held.gap // s
    if n < each:
        each, whole = n, 1
    else:
        whole = min(held.count, n // each)
    own = held.split(whole)
    if held.count:
        gaps[held.gap].append(held)
    for _ in range(each):
        out.put(s, own)
    gaps[own.gap].append(own)
    return each * whole


def _order_range(cut: DataFrame):
    """A column function from ``_order`` to one of RANGES ranges that hold about as many pieces each.

    The column can't be null, and Catalyst is told so: else a join by it adds
    a filter that evaluates it once more, with twice the Python workers, which
    then stay and grow in whatever runs next.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    held = cut.agg(F.percentile_approx("_order", shares, 10 * RANGES)).first()[0]
    edges = np.array(held or [], dtype=np.int64)

    @F.pandas_udf("long")
    def of(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, order.to_numpy()).astype(np.int64))

    return lambda order: F.coalesce(of(order), F.lit(0))


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, order: str | None = None) -> DataFrame:
    """Each piece's sequence and its offset there.

    The packing is planned from the number of pieces of each length, at most
    ``capacity`` numbers, so the plan is as small for any number of documents.
    Pieces of one length are interchangeable: a piece's rank among them, taken
    in hash ranges so that a frequent length is no task of its own, leads to
    its place.

    With ``order``, a whole-number column of ``docs``, pieces of one length
    are ranked by it and sequences are numbered by the order of their first
    piece, which is their longest: read by ``sequence_id``, the packed text
    keeps the order of the documents as far as the lengths leave it.

    A null text is empty and packs as the end id alone; repeated rows are
    packed one by one; an empty table gives no rows.
    """
    cut = stored(
        pieces(docs, capacity, path, order).withColumn("_range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1024))),
        "pieces",
    )
    if order:
        of_order = _order_range(cut)
        cut = cut.withColumn("_range", of_order("_order"))
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = np.array(sorted(plan(counts, capacity).runs), dtype=np.int64).reshape(-1, 4)
    key = (runs[:, 0] << 48) | runs[:, 1]
    by_rank = ranked(cut, ["length"], "_range", ["_order", "doc_id", "piece", "ids_crc32", "start"], "_rank")

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, (length.to_numpy() << 48) | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 2] + rank.to_numpy() - runs[at, 1], "offset": runs[at, 3]})

    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    named = by_rank.withColumn("_place", place("length", "_rank")).select(*own, "_order", "_place.*")
    if order:
        named = stored(named, "placed")
        heads = named.where("offset = 0").select("sequence_id", "_order", of_order("_order").alias("_range"), F.lit(0).alias("_all"))
        numbers = ranked(stored(heads, "heads"), ["_all"], "_range", ["_order", "sequence_id"], "_number")
        named = named.join(numbers.select("sequence_id", "_number"), "sequence_id").withColumn("sequence_id", F.col("_number").cast("long"))
    return named.select(*own, "sequence_id", "offset")
