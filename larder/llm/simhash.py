"""SimHash near-dedup: fingerprints linked by BK-trees over shards of them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import text_or_empty
from larder.llm.components import components
from larder.session import batches, scratch, stored

WORDS = 3
RADIUS = 3
SEED = 42
SHARD = 4096
#: Near copies: the share of five-word shingles that two texts have in common.
CHECK_WORDS = 5
SIMILARITY = 0.8
#: Most differing bits of 128 for a candidate: texts of that similarity differ in 19 on average, and hardly ever in more.
CHECK_BITS = 34
#: Keys of a text, and smallest hashes in each: at a similarity of 0.8 two texts share none with probability 7e-10.
BANDS, BAND_ROWS = 40, 4
#: Of a pair's keys so many must be equal before its shingles are counted: at a similarity of 0.8 fewer are with probability 2.6e-6.
SHARED_KEYS = 4
#: Pairs that one task counts, about, and hashes of either side that it holds.
TASK_PAIRS, TASK_HASHES = 8192, 1 << 21
#: Bits of the parities of a set of hashes.
PARITY_BITS = 2048
#: Bits that tell which rows may have been dropped; 2 MB, for any number of rows.
DROPPED_BITS = 1 << 24
#: Pairs that a task searching candidates holds before it reduces them to their forest.
HELD_PAIRS = 1 << 18
#: Texts that a Python worker is given at once.
BATCH = 1000
#: Ids that may be broadcast; they take 90 bytes each in the driver's memory, and 4 in the file that Catalyst goes by.
BROADCAST_ROWS = 1 << 20
#: Pivots are compared with their key's holders while this many pairs a holder are open, at most so many times.
OPEN_PAIRS, PIVOTS = 4, 6
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str, words: int) -> Iterator[bytes]:
    """All shingles in order; fewer words than ``words`` are one shingle, no words none."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    for a, b in zip(starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True):
        yield joined[a:b]


def majority(hashed: np.ndarray) -> np.ndarray:
    """64-bit words whose bits are set where over half of the rows of ``hashed`` have them set."""
    width = hashed.shape[1]
    counts = np.zeros(64 * width, dtype=np.int64)
    for at in range(0, len(hashed), 65_536):
        bits = np.unpackbits(hashed[at : at + 65_536].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64 * width).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashed), bitorder="little").view("<u8")


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it set."""
    hashed = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, words)], dtype="<u8")
    return int(majority(hashed.reshape(-1, 1))[0])


def wide_fingerprint(text: str, words: int = CHECK_WORDS) -> tuple[int, int]:
    """128 bits of the same kind, as two numbers."""
    high, low = majority(wide_hashes(text, words))
    return int(high), int(low)


def wide_hashes(text: str, words: int = CHECK_WORDS) -> np.ndarray:
    """A row of two 64-bit hashes for each shingle."""
    hashed = b"".join([xxhash.xxh3_128_digest(s, SEED) for s in shingles(text, words)])
    return np.frombuffer(hashed, dtype="<u8").reshape(-1, 2)


def set_hash(distinct: np.ndarray) -> tuple[int, int]:
    """128 bits, as two numbers, of a sorted set of hashes."""
    both = xxhash.xxh3_128_intdigest(distinct.tobytes(), SEED)
    return both >> 64, both & (1 << 64) - 1


def band_keys(distinct: np.ndarray) -> list[int]:
    """BANDS keys of a set of hashes, each made of BAND_ROWS minima under permutations of its own.

    A minimum is shared with the probability of the sets' similarity, wherever
    in the texts the difference is and however often a shingle is repeated.
    """
    if not len(distinct):
        return [0] * BANDS
    odd, flip = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
    odd = odd << np.uint64(1) | np.uint64(1)
    parts = [((distinct[at : at + 4096] ^ flip) * odd).min(axis=1) for at in range(0, len(distinct), 4096)]
    least = np.min(parts, axis=0).reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)]


def parities(distinct: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, as numbers of 64: whether an odd number of the hashes falls on each.

    Hashes that two sets share cancel out, so the bits in which their parities
    differ are at most the hashes that one of them has and the other has not.
    """
    odd = np.bincount((distinct % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; a null text counts as empty."""

    return docs.select("doc_id", F.pandas_udf(_fingerprinter(words), "long")(text_or_empty()).alias("fp"))


def _fingerprinter(words: int):
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return of


class BKTree:
    """Values in a tree whose edges carry the Hamming distance of child to parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            step = (value ^ node[0]).bit_count()
            below = node[1].get(step)
            if below is None:
                if step:
                    node[1][step] = (value, {})
                return
            node = below

    def near(self, value: int, radius: int) -> list[int]:
        """All values within ``radius``; only edges that can lead there are followed."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            held, below = open_nodes.pop()
            far = (value ^ held).bit_count()
            if far <= radius:
                found.append(held)
            if below:
                open_nodes += [n for step, n in below.items() if far - radius <= step <= far + radius]
        return found


class Joined:
    """Union-find over the values of one task; ``links`` spans each set."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.parent.setdefault(x, x)
        while up != x:
            self.parent[x] = x = self.parent[up]
            up = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def key_blocks(n: int, radius: int) -> tuple[int, int]:
    """Into how many blocks the 64 bits are cut, and how many of them a key joins.

    Values within ``radius`` differ in at most ``radius`` blocks, so they agree
    in the others: each choice of ``blocks - radius`` blocks is a key, and no
    link is missed.  The more values, the longer the keys, so that what shares
    a key stays small.
    """
    for blocks in range(radius + 1, radius + 4):
        taken = blocks - radius
        if n <= 64 << (64 * taken // blocks):
            break
    return blocks, taken


def keys_of(fp: F.Column, blocks: int, taken: int) -> F.Column:
    """Array of (choice, bits) keys of a fingerprint."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    choices = [sum(c) for c in itertools.combinations(masks, taken)]
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])


def fingerprint_links(values: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (u, v) that connect all ``fp`` of ``values`` (distinct) within ``radius`` bits.

    Fingerprints that share a key form a shard with a BK-tree of its own, built
    where its members meet.  A key with more than ``shard`` members is split
    into parts by hash, and each pair of parts is one task, so that a task
    holds two parts at most.  Each task returns a spanning forest of the links
    it found, not all pairs.
    """
    search = _searcher(radius)
    return _dealt(values, radius, shard).groupBy("task").applyInPandas(search, "u long, v long")


def _dealt(values: DataFrame, radius: int, shard: int) -> DataFrame:
    """The rows of ``values`` in each task that they are searched in.

    Only the keys that are split are counted into a table, one row at most for
    each ``shard`` rows and choice of bits, so the rows meet it where they are;
    rows whose key no other has are alone in their task's meeting.
    """
    own = values.columns
    n = values.count()
    blocks, taken = key_blocks(n, radius)
    keyed = values.where("fp IS NOT NULL").select(*own, F.explode(keys_of(F.col("fp"), blocks, taken)).alias("key")).select(*own, "key.*")
    # Stored, or Catalyst would take the keys of all rows for as few as the rows and send them to the driver.
    large = stored(keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard), "large")
    parts = F.coalesce(F.ceil(F.col("n") / shard).cast("int"), F.lit(1))
    part = F.pmod(F.xxhash64(*own), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = (
        keyed.join(large, ["choice", "bits"], "left")
        .select("choice", "bits", *own, parts.alias("parts"))
        .select("*", part.alias("part"))
        .select("*", other.alias("other"))
        .select("choice", "bits", *own, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )
    tasks = max(1, -(-n * math.comb(blocks, taken) // (2 * shard)))
    task = F.pmod(F.xxhash64("choice", "bits", "i", "j"), F.lit(tasks))
    return dealt.withColumn("task", task)


def _meetings(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[slice, list[bool], bool]]]:
    """The rows in order; where those that meet are, which are of the second part, and if there are two."""
    rows = rows.sort_values(["choice", "bits", "i", "j", "part"], kind="stable")
    keys = rows[["choice", "bits", "i", "j"]].to_numpy()
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    second = (rows["part"] == rows["j"]).to_numpy().tolist()
    two = (rows["i"] != rows["j"]).to_numpy().tolist()
    bounds = itertools.pairwise([0, *cuts.tolist(), len(rows)])
    return rows, [(slice(a, b), second[a:b], two[a]) for a, b in bounds if b - a > 1]


def _links_frame(links: list[tuple[int, int]], kind: type) -> pd.DataFrame:
    both = np.array(links, dtype=kind).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"u": both[:, 0], "v": both[:, 1]})


def _searcher(radius: int):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = Joined()
        rows, meetings = _meetings(rows)
        fps = rows["fp"].to_numpy().view(np.uint64).tolist()
        for here, second, two in meetings:
            _link(fps[here], second, two, radius, found)
        return _links_frame(found.links(), np.uint64)

    return search


def _link(fps: list[int], second: list[bool], pair: bool, radius: int, found: Joined) -> None:
    """Search the tree of the first part; within one part, of those before."""
    tree = BKTree()
    for fp, is_second in zip(fps, second, strict=True):
        if not pair or is_second:
            for other in tree.near(fp, radius):
                found.union(fp, other)
        if not pair or not is_second:
            tree.add(fp)


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Equal fingerprints are one node, so copies add no links.  Null text is
    empty text; texts without words have fingerprint zero and are linked like
    any other; a null doc_id keeps its row and never is the component's id
    unless all ids of the component are null.  Repeated rows come back as often
    as they are given.
    """
    marked = stored(fingerprints(docs, words), "fingerprints")
    values = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = components(fingerprint_links(values.select("fp"), radius)).withColumnRenamed("node", "fp")
    classes = values.join(label, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    classes = stored(classes, "classes")
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    of_value = classes.join(smallest, "component").select("fp", "component_id")
    return marked.join(of_value, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidate_links(nodes: DataFrame, radius: int, bits: int = CHECK_BITS, shard: int = SHARD) -> DataFrame:
    """Likely near copies (u, v) among ``nodes`` (node, fp, high, low), each with a number of its own.

    Fingerprints within ``radius`` are found as in `fingerprint_links`; of
    those, pairs whose wide fingerprints differ in more than ``bits`` are left
    out.  Each task returns a shortest spanning forest by the differing bits:
    what is left out of it is connected by links that look at least as similar.
    """
    search = _candidate_searcher(radius, bits)
    found = _dealt(nodes, radius, shard).groupBy("task").applyInPandas(search, "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _candidate_searcher(radius: int, bits: int):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows, meetings = _meetings(rows)
        fps = rows["fp"].to_numpy().view(np.uint64).tolist()
        wide = rows[["high", "low"]].to_numpy().view(np.uint64)
        nodes = rows["node"].to_numpy()
        pairs, size = [np.empty((0, 3), dtype=np.int64)], 0
        for here, second, two in meetings:
            for near in _near_pairs(fps[here], second, two, wide[here], nodes[here], radius, bits):
                pairs.append(near)
                size += len(near)
                if size >= HELD_PAIRS:
                    pairs, size = [_forest(pairs)], 0
        return _links_frame(_forest(pairs)[:, 1:], np.int64)

    return search


def _forest(pairs: list[np.ndarray]) -> np.ndarray:
    """A shortest spanning forest of (differing bits, node, node), shortest first; of equals the earlier ones.

    With later pairs behind it, it gives the same forest as all pairs would.
    """
    pairs = np.concatenate(pairs)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    found = Joined()
    return pairs[[found.union(u, v) for u, v in zip(pairs[:, 1].tolist(), pairs[:, 2].tolist(), strict=True)]] if len(pairs) else pairs


def _near_pairs(fps, second, two, wide, nodes, radius: int, bits: int) -> Iterator[np.ndarray]:
    """(differing bits, node, node) for what lies within ``radius`` and ``bits``, by one tree of the first part."""
    tree, held = BKTree(), {}
    for at, fp in enumerate(fps):
        if not two or second[at]:
            near = np.array([k for other in tree.near(fp, radius) for k in held[other]], dtype=np.int64)
            if len(near):
                steps = np.bitwise_count(wide[near] ^ wide[at]).sum(axis=1, dtype=np.int64)
                near, steps = near[steps <= bits], steps[steps <= bits]
                yield np.stack([steps, nodes[near], np.full(len(near), nodes[at])], axis=1)
        if not two or not second[at]:
            tree.add(fp)
            held.setdefault(fp, []).append(at)


def similar_links(links: DataFrame, texts: DataFrame, words: int = CHECK_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The ``links`` (u, v) whose ``texts`` (node, text) share ``similarity`` of their distinct shingles.

    Give stored links.  A task counts the pairs of a group of u with a group
    of v, so that a set of shingles travels to as many tasks as there are
    groups and not to every pair; where one text is in very many pairs, a task is
    cut by the other.  The longer the texts, the more groups, so that what a
    task holds does not grow with them.
    """

    @F.pandas_udf("array<long>")
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(t, words)], dtype=np.uint64)).view(np.int64) for t in values])

    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = stored(texts.join(ends, "node", "left_semi").select("node", hashed(text_or_empty()).alias("set")), "shingles")
    hashes = sets.agg(F.sum(F.size("set"))).first()[0] or 0
    side = max(1, math.ceil(math.sqrt(links.count() / TASK_PAIRS)), math.ceil(hashes / TASK_HASHES))
    grouped = links.select("u", "v", *[F.pmod(F.xxhash64(c), F.lit(side)).alias(f"of_{c}") for c in "uv"])
    cuts = grouped.groupBy("of_u", "of_v").agg(F.ceil(F.count(F.lit(1)) / (4 * TASK_PAIRS)).alias("cuts"))
    dealt = grouped.join(cuts, ["of_u", "of_v"]).select("u", "v", F.struct("of_u", "of_v", F.pmod(F.xxhash64("u", "v"), "cuts").alias("cut")).alias("task"))
    needed = dealt.select(F.col("task").alias("at"), F.explode(F.array("u", "v")).alias("node")).distinct().join(sets, "node")

    def count(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(held["node"].tolist(), held["set"], strict=True))
        good = []
        for u, v in zip(pairs["u"].tolist(), pairs["v"].tolist(), strict=True):
            a, b = of[u], of[v]
            if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
                good.append(False)
                continue
            common = len(np.intersect1d(a, b, assume_unique=True))
            good.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
        return pairs.loc[good, ["u", "v"]]

    return dealt.groupBy("task").cogroup(needed.groupBy("at")).applyInPandas(count, "u long, v long")


def plausible(pairs: DataFrame, keyed: DataFrame, least: int = SHARED_KEYS) -> DataFrame:
    """Those of ``pairs`` (u, v) that share ``least`` of their `BANDS` keys; of nodes with fewer keys all."""
    u, v = (keyed.select(F.col("node").alias(c), F.col("keys").alias(f"of_{c}")) for c in "uv")
    whole = (F.size("of_u") == BANDS) & (F.size("of_v") == BANDS)
    shared = F.size(F.array_intersect("of_u", "of_v")) >= least
    return pairs.join(u, "u").join(v, "v").where(~whole | shared).select("u", "v")


def possible(similarity: float = SIMILARITY) -> F.Column:
    """Whether sets of ``n_u`` and ``n_v`` hashes with parities ``odd_u`` and ``odd_v`` can have that similarity; never false if they have.

    It bounds the hashes that only one set has, and the bits in which the
    parities differ and the difference of the counts are no more than those.
    """
    most = (F.col("n_u") + F.col("n_v")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    bits = F.aggregate(F.zip_with("odd_u", "odd_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)
    return F.when(F.abs(F.col("n_u") - F.col("n_v")) <= most, bits <= most).otherwise(False)


def possible_pairs(pairs: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (u, v) that `possible` does not rule out by the ``sketches`` (node, n, odd)."""
    u, v = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "uv")
    return pairs.join(u, "u").join(v, "v").where(possible(similarity)).select("u", "v")


def completed_links(
    links: DataFrame, keyed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, sketches: DataFrame | None = None
) -> DataFrame:
    """``links`` (u, v) and more, so that all similar texts that share a key of ``keyed`` (node, keys) are connected.

    Only what already is one component goes without a count, and pairs that
    the ``sketches`` (node, n, odd) rule out, if given; those are no rows of
    any join.  The pairs still open are all compared when they are few.  Else,
    for some rounds, a key's smallest node is compared with all holders in
    other components and then leaves the key, as nothing about it is open any
    more; so a group of near copies does not become all its pairs.
    """
    every, spark = keyed, links.sparkSession
    for last in [False] * PIVOTS + [True]:
        with scratch(spark) as keep:
            label = components(links)
            held = keyed.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("of"), F.explode("keys").alias("key"))
            apart = held.groupBy("key").agg(F.min("of").alias("a"), F.max("of").alias("b"), F.min("node").alias("pivot")).where("a <> b")
            held = held.join(stored(apart.select("key", "pivot"), "apart"), "key")
            if sketches is not None:
                held = held.join(sketches, "node")
            held = keep(stored(held, "open"))
            holders = held.count()
            if not holders:
                return links
            own = [c for c in ("node", "of", "n", "odd") if c in held.columns]
            u, v = (held.select("key", "pivot", *[F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in own]) for s in "uv")
            rest = F.expr("of_u <> of_v AND u < v")
            if sketches is not None:
                rest = F.when(rest, possible(similarity)).otherwise(False)
            v = v.drop("pivot")
            if holders > BROADCAST_ROWS // 8:
                # Parities that are the same for all keys of a node take 600 bytes a row in memory and few in the file that Catalyst goes by.
                v = v.hint("merge")
            apart_pairs = u.join(v, "key").where(rest)
            last = last or apart_pairs.count() <= OPEN_PAIRS * holders
            pairs = apart_pairs if last else u.where("u = pivot").join(v, "key").where(rest)
            pairs = stored(pairs.select("u", "v").distinct(), "pairs")
            pairs = stored(plausible(pairs, every), "plausible")
            links = keep(stored(links.union(similar_links(pairs, texts, similarity=similarity)), "confirmed"))
        if last:
            return links
        keyed = held.where("node <> pivot").select("node", F.array("key").alias("keys"))
    return links


def by_rows(ids: DataFrame, rows: int | None = None) -> DataFrame:
    """Stored ``ids`` to join with, merged instead of broadcast where they are more than ``rows``."""
    return ids.hint("merge") if ids.count() > (BROADCAST_ROWS if rows is None else rows) else ids


def dropped_bits(rows: DataFrame, kept: DataFrame, bits: int = DROPPED_BITS) -> DataFrame:
    """(bucket, bits): a bitmap of ``bits`` bits in which the hash of each row of ``rows`` (row) is set that is not in ``kept`` (row)."""
    place = _place(bits)
    return (
        rows.join(kept, "row", "left_anti")
        .groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )


def _place(bits: int) -> F.Column:
    return F.pmod(F.xxhash64("row"), F.lit(bits)) + 1


def without_dropped(rows: DataFrame, kept: DataFrame, held: DataFrame, bits: int = DROPPED_BITS) -> DataFrame:
    """The ``rows`` (row and others) that are in ``kept`` (row); ``held`` is their `dropped_bits`.

    A row whose bit is not set was not dropped, and stays where it is.  Only
    the others, few but for what was dropped, are dealt out and joined, so
    that most texts are never shuffled.  The bitmap's size is bounded, so it
    may be broadcast.
    """
    place = _place(bits)
    marked = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(held), "bucket", "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.when(F.col("bits").isNotNull(), F.getbit(byte, (at % 8).cast("int")) == 1).otherwise(False)
    own = marked.select(*rows.columns, is_set.alias("in_doubt"))
    sure, rest = own.where("NOT in_doubt"), own.where("in_doubt")
    return sure.select(*rows.columns).union(rest.select(*rows.columns).join(kept, "row", "left_semi").select(*rows.columns))


def deduplicated(docs: DataFrame, words: int = 2, radius: int = 8, similarity: float = SIMILARITY) -> DataFrame:
    """The columns of ``docs``, one row of each group of near copies: that of the smallest doc_id.

    Candidates have fingerprints of ``words``-word shingles within ``radius``
    bits, or share one of their `band_keys`; a candidate is a link if the
    distinct five-word shingles of both texts really have a similarity of
    ``similarity`` or more.  The fingerprints find most links at little cost;
    what they miss, or what was left out of their forest, the keys find.  Pairs
    that the counts and parities of their shingles rule out need no count.  Without a count,
    only texts with the same set of five-word shingles are copies.  Null text is empty text; texts without words are copies of each
    other.  Rows are told apart by a number given when they are first stored,
    so that repeated rows are reduced to one as well.  A group without any
    doc_id keeps one row.  An empty table stays empty.
    """

    @F.pandas_udf("struct<fp: long, high: long, low: long, set_high: long, set_low: long, n: long, bands: array<long>, odd: array<long>>")
    def marks(values: pd.Series) -> pd.DataFrame:
        sums, bands, odd = [], [], []
        for text in values:
            hashed = wide_hashes(text)
            distinct = np.unique(hashed[:, 0])
            sums.append((fingerprint(text, words), *majority(hashed).tolist(), *set_hash(distinct), len(distinct)))
            bands.append(np.array(band_keys(distinct), dtype=np.uint64).view(np.int64))
            odd.append(parities(distinct))
        sums = np.array(sums, dtype=np.uint64).reshape(-1, 6).view(np.int64)
        return pd.DataFrame(sums, columns=["fp", "high", "low", "set_high", "set_low", "n"]).assign(bands=bands, odd=odd)

    # The columns travel as one, so that none can clash with those added here.
    row = F.monotonically_increasing_id().alias("row")
    with scratch(docs.sparkSession) as keep, batches(docs.sparkSession, BATCH):
        marked = keep(stored(docs.select(F.struct("*").alias("doc"), marks(text_or_empty()).alias("mark"), row), "fingerprinted"))
        first = F.min(F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"), F.col("row"))).alias("first")
        same = [F.col(f"mark.{c}").alias(c) for c in ("fp", "high", "low", "set_high", "set_low")]
        nodes = stored(marked.groupBy(*same).agg(first).select("*", F.col("first.row").alias("node")), "nodes")
        texts = marked.select(F.col("row").alias("node"), F.col("doc.text").alias("text"))
        sketches = marked.select(F.col("row").alias("node"), F.col("mark.n").alias("n"), F.col("mark.odd").alias("odd"))
        with scratch(docs.sparkSession) as hold:
            links = candidate_links(nodes.select("node", "fp", "high", "low"), radius)
            links = stored(possible_pairs(stored(links, "candidates"), sketches, similarity), "possible")
            links = hold(stored(similar_links(links, texts, similarity=similarity), "confirmed"))
        bands = marked.select(F.col("row").alias("node"), F.col("mark.bands").alias("keys"))
        keyed = stored(bands.join(nodes.select("node"), "node", "left_semi"), "keys")
        kept = (
            nodes.join(components(completed_links(links, keyed, texts, similarity, sketches)), "node", "left")
            .groupBy(F.coalesce("component", "node"))
            .agg(F.min("first").alias("first"))
            .select(F.col("first.row").alias("row"))
        )
        kept = by_rows(keep(stored(kept, "kept")))
        held = keep(stored(dropped_bits(marked.select("row"), kept), "dropped"))
    return without_dropped(marked.select("row", "doc"), kept, held).select("doc.*")
