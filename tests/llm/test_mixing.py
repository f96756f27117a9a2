"""The mixture against an earliest-deadline-first schedule with exact weights, slot by slot."""

from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from larder.llm import mixing


def in_slots(spark, rows, **options):
    """Sources in the order of the mixture's slots."""
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "doc_id long, source string")
    out = mixing.scheduled(docs, **options).select("doc_id", "source", "mix_slot", "mix_order").orderBy("mix_order").collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    seen = {r.mix_slot: r.source for r in out}
    return out, seen


def exact(weights, slots):
    """Sources of the slots by earliest deadline first, with fractions; ties to the first source."""
    total = sum(weights.values())
    share = {s: Fraction(w) / total for s, w in weights.items()}
    done, out = Counter(), []
    for t in range(slots):
        due = [(-(-(done[s] + 1) // w), i, s) for i, (s, w) in enumerate(share.items()) if done[s] // w <= t]
        own = min(due)[2]
        done[own] += 1
        out.append(own)
    return out


def deviation(order, weights, slots):
    """The largest distance of a source's served blocks from its share, over all times."""
    total, worst, done = sum(weights.values()), 0.0, Counter()
    for t in range(slots):
        done[order[t]] += 1
        worst = max(worst, max(abs(done[s] - w / total * (t + 1)) for s, w in weights.items()))
    return worst


def test_small_shares_get_their_slots(spark):
    """Shares of 0.9969, 0.0029 and 0.0002 of the real weights, not of a frame of a few hundred."""
    weights = {"a": 9969, "b": 29, "c": 2}
    rows = ["a"] * 10_000 + ["b"] * 40 + ["c"] * 10
    _, seen = in_slots(spark, rows, block_rows=1, weights={s: w / 10_000 for s, w in weights.items()} | {"": 1e-9})
    order = [seen[t] for t in range(9000)]
    assert deviation(order, weights, 9000) < 1
    assert abs(Counter(order)["b"] - Counter(exact(weights, 9000))["b"]) <= 1


def test_the_schedule_is_earliest_deadline_first(spark):
    """Where the weights divide the frame, it is the exact schedule up to ties."""
    weights = {"a": 7, "b": 5, "c": 3, "d": 1}
    rows = [s for s, w in weights.items() for _ in range(w * 12)]
    _, seen = in_slots(spark, rows, block_rows=1, weights={s: float(w) for s, w in weights.items()} | {"": 1e-9}, frame=1 << 14)
    order = [seen[t] for t in range(12 * 16)]
    assert deviation(order, weights, len(order)) < 1
    assert deviation(exact(weights, len(order)), weights, len(order)) < 1


def test_a_thousand_equal_sources_get_equal_shares(spark):
    rows = [f"s{i % 1000}" for i in range(8000)]
    out, _ = in_slots(spark, rows, block_rows=2)
    at = defaultdict(list)
    for place, r in enumerate(out):
        at[r.source].append(place)
    # Of any stretch of 4,000 rows each source has its 4, to within a block on either side.
    for places in at.values():
        held = np.searchsorted(places, [2000, 6000])
        assert abs((held[1] - held[0]) - 4) <= 2
    early = Counter(r.source for r in out[:4000])
    assert len(early) == 1000 and max(early.values()) <= 6


def test_pooled_sources_keep_their_weights(spark):
    """Sources of many sizes beyond the strata: each is spread by the square root of its size."""
    sizes = {f"s{i}": 20 + 3 * i for i in range(60)}
    rows = [s for s, n in sizes.items() for _ in range(n)]
    out, _ = in_slots(spark, rows, block_rows=1, strata=10)
    weight = {s: n**0.5 for s, n in sizes.items()}
    total, upto = sum(weight.values()), 600
    served = Counter(r.source for r in out if r.mix_slot < upto)
    assert sum(served.values()) == upto
    pooled = sorted(sizes, key=lambda s: -sizes[s])[10:]
    assert all(abs(served[s] - weight[s] / total * upto) < 2.5 for s in pooled)


@pytest.mark.parametrize("n", [1, 5, 300])
def test_frames_are_whole(spark, n):
    slots = spark.createDataFrame([(f"s{i}", 1 + i % 7) for i in range(n)], "stratum string, slots int")
    plan = mixing.frame_schedule(slots).toPandas()
    frame = sum(1 + i % 7 for i in range(n))
    assert sorted(plan["at"]) == list(range(frame)) and set(plan.frame) == {frame}
    for _, own in plan.groupby("stratum"):
        k, a = own.k.to_numpy(), own.slots.iloc[0]
        assert ((k * frame) // a <= own["at"]).all() and (own["at"] < -(-(k + 1) * frame // a)).all()
