"""Exact searches of a query set over all rows, against brute force with whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import bitslices, blocks, onebit
from larder.llm.bitslices import BlockIndex, added, at_least, bound, sliced, top_inner_products
from larder.llm.onebit import CodeIndex, coded, hard_negatives, rotated

SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(row):
    return [math.floor(256 * x) if abs(x) < 2**52 else int(x) * 256 for x in row]


def good(rows):
    """The rows that take part, by id: (vector, label)."""
    out = {}
    for i, v, label in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            out.setdefault(i, []).append((whole(v), label))
    return {i: min(held) for i, held in out.items()}


def product(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))


def top(rows, every=50, k=5):
    held = {i: v for i, (v, _) in good(rows).items()}
    out = set()
    for q in (i for i in held if i % every == 0):
        near = sorted((-product(held[q], v), i) for i, v in held.items() if i != q and len(v) == len(held[q]))
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(near[:k])}
    return out


def negatives(rows, every=100, k=5):
    held = {i: row for i, row in good([r for r in rows if r[2] is not None]).items()}
    out = set()
    for q in (i for i in held if i % every == 0):
        v, label = held[q]
        others = {i: (product(v, w), own) for i, (w, own) in held.items() if i != q and len(w) == len(v)}
        same = sorted((-s, i) for i, (s, own) in others.items() if own == label)[:k]
        for s, p in same:
            fit = sorted((-t, i) for i, (t, own) in others.items() if own != label and 80 * -s <= 100 * t <= 100 * -s)
            out |= {(q, p, rank + 1, i, -s, -t) for rank, (t, i) in enumerate(fit[:k])}
    return out


def results(df):
    return {tuple(r) for r in df.collect()}


def planted(kind, n=700, dim=20):
    """Rows of one kind: without structure, in clusters, many equal, with far too large components."""
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(n, dim))
    if kind == "clusters":
        x = rng.normal(size=(7, dim))[rng.integers(0, 7, n)] + 0.1 * x
    if kind == "equal":
        x[: n // 3] = x[0]
        x[n // 3 : n // 2] = 0
    if kind == "large":
        x[::50] *= 1e9
        x[7], x[50], x[51] = 1e30, 1e300, -1.7e308
    if kind == "positive":
        x = np.abs(x)
    return [(i, row.tolist(), int(label)) for i, (row, label) in enumerate(zip(x, rng.integers(0, 5, n), strict=True))]


@pytest.fixture
def small_blocks(monkeypatch):
    """Several blocks and lists also of few rows."""
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 2000)
    monkeypatch.setattr(blocks, "LIST_ROWS", (3, 5))


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "large", "positive"])
def test_top_products(spark, small_blocks, kind):
    rows = planted(kind)
    found = top_inner_products(spark.createDataFrame(rows, SCHEMA))
    assert results(found) == top(rows)


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "large", "positive"])
def test_hard_negatives(spark, small_blocks, kind):
    rows = planted(kind)
    want = negatives(rows, every=20)
    found = hard_negatives(spark.createDataFrame(rows, SCHEMA), every=20)
    assert results(found) == want
    assert want or kind == "large"


def index_row(x, ids, build):
    import pandas as pd

    rows = pd.DataFrame({"vec_id": ids, "label": 0, "v": list(x)})
    return next(pd.DataFrame([build(rows)]).itertuples())


def test_slices_add_up():
    rng = np.random.default_rng(3)
    x = rng.integers(-100, 120, size=(200, 9)).astype(float)
    shift, slices = sliced(x)
    u = (x - x.min(axis=0)).astype(int) >> shift
    assert u.max() < 1 << bitslices.SLICES
    q = rng.integers(-70, 70, size=9)
    held = slices.reshape(bitslices.SLICES, 9, -1)
    planes = added(np.concatenate([held, ~held], axis=1), q)
    bits = np.array([np.unpackbits(p.view(np.uint8), bitorder="little")[:200] for p in planes]).astype(int)
    sums = (bits << np.arange(len(planes))[:, None]).sum(axis=0)
    most = (1 << bitslices.SLICES) - 1
    assert (sums == (np.where(q < 0, most - u, u) * np.abs(q)).sum(axis=1)).all()
    rows = np.zeros(4, dtype=np.uint64)
    rows[:3], rows[3] = ~np.uint64(0), (1 << 8) - 1
    for k in (1, 2, 17, 199, 200):
        value = bound(planes, rows, k)
        assert value == np.sort(sums)[-k]
        kept = np.unpackbits(at_least(planes, rows, value).view(np.uint8), bitorder="little")[:200]
        assert (kept == (sums >= value)).all()


def test_few_rows_are_scored_exactly():
    """The index leaves a small part of the rows to be scored."""
    x = np.floor(256 * np.random.default_rng(1).normal(size=(8192, 64)) / 8)
    block = BlockIndex(index_row(x, np.arange(8192), bitslices._indexed))
    near = [int(np.bitwise_count(block.near(q, block.rows, 5)).sum()) for q in x[:20]]
    assert max(near) < 8192 / 10


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=(300, 33)) * 90, rng.integers(0, 3, size=(300, 64)).astype(float), np.zeros((5, 3))):
        block = CodeIndex(index_row(np.floor(x), np.arange(len(x)), onebit._indexed))
        for q in block.x[:30]:
            low, high = block.bounds(q)
            scores = block.x @ q
            assert (low <= scores).all() and (scores <= high).all()


def test_codes_leave_little():
    x = np.random.default_rng(4).normal(size=(100, 64))
    assert np.allclose((rotated(x, 0) ** 2).sum(axis=1), (x**2).sum(axis=1))
    _, aligned, rest = coded(x)
    norms = np.sqrt((x**2).sum(axis=1))
    assert np.allclose((aligned**2).sum(axis=0) + rest**2, norms**2)
    assert (rest < 0.2 * norms).all()


ODD = [
    (0, [1.0, 0.0], 1), (100, [0.0, 2.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (2, [1.0, 0.0], 2), (2, [0.9, 0.1], 1), (3, None, 1),
    (4, [0.0, 0.0], 3), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, None], 1), (8, [], 1), (9, [1.0, 2.0, 3.0], 1),
    (None, [1.0, 0.0], 1), (None, None, None), (10, [1.9, 0.0], None), (11, [-0.001, 0.001], 2), (-50, [0.5, 0.5], 2), (12, [1.8, 1.0], 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    names = ("v", "dim", "blocks", "lists", "n", "ids", "rank", "row", "vector", "score", "block", "list", "rows", "asked", "place", "wanted")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in names})


def test_odd_rows(odd):
    assert results(top_inner_products(odd)) == top(ODD)
    assert results(hard_negatives(odd)) == negatives(ODD)
    assert negatives(ODD)


def test_empty_and_alone(odd):
    for few in (odd.limit(0), odd.where("vec_id = 100"), odd.where("vec_id = 3")):
        assert top_inner_products(few).count() == 0
        assert hard_negatives(few).count() == 0
