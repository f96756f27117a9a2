"""Conversation repair against all ways to edit a conversation."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm.conversations import END, Grammar, digests, entered, number, repair_report, repaired, vector

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out[c] += [(t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        held = text.strip(BLANKS)
        out.append("blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired rows): the least of all ways, each tried."""

    @cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(rest, cost, letter, *kept):
            if rest:
                ways.append((rest[0] + cost, letter + rest[1], kept + rest[2]))

        for initial, role in (("u", "user"), ("a", "assistant")):
            if inserted < 3 and (state, initial) in NEXT:
                add(best(i, NEXT[state, initial], inserted + 1), 2, "I", f"{role}:")
        if i < len(rows):
            _, own, text = rows[i]
            add(best(i + 1, state, 0), 3, "D")
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                if (state, own[:1]) in NEXT:
                    add(best(i + 1, NEXT[state, own[:1]], 0), extra, "K", f"{own}:{text}")
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in NEXT:
                        add(best(i + 1, NEXT[state, initial], 0), 2 + extra, "R", f"{role}:{text}")
        return min(ways, key=lambda w: w[:2], default=None)

    return best(0, "", 0)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def reports(rows):
    out = {}
    for c, held in damage(rows).items():
        held = in_order(held)
        turns = [t for t, *_ in held if t is not None]
        initials = [role[:1] for _, role, _ in held]
        faults = faults_of(held)
        cost, audit, lines = cheapest(held, faults)
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def planted(n=60, most=40):
    rng, rows = random.Random(3), []
    for c in [None, *range(n)]:
        style = rng.randrange(5)
        for t in range(rng.randrange(1, most)):
            role = (["user", "assistant"][t % 2], "user", rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["system", "user", "assistant"]), "tool")[style]
            text = rng.choice([f"Word {t}.", f"Open {t}", "", None, " \n", "Same.", f"End {t}! \t\n", " "])
            rows.append((c, rng.choice([t, t, t, t * 2, None]), role, text))
    return rows


def results(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("chunk, fan", [(4096, 1024), (3, 2)])
def test_all_conversations(spark, chunk, fan):
    """Also in stretches of three rows, of which two are joined at a time."""
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert results(repair_report(df, chunk, fan)) == reports(rows)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert results(repair_report(df, chunk=50)) == reports(rows)


def test_one_conversation_holds_most_rows(spark):
    """Runs that never converge: one role only, and one row repeated; 900 rows in stretches of 16."""
    rows = [(1, t, "user", f"{t}.") for t in range(400)] + [(1, 400, "user", "Again.")] * 300
    rows += [(1, 401 + t, "tool", f"{t}!") for t in range(200)] + [(2, 0, "user", "Hello.")]
    rows = [(c, t * 20, role, text) for c, t, role, text in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    steps, faults = repaired(df, chunk=16, fan=4)
    found = {r.conv: r for r in digests(steps).collect()}
    held = in_order([r[1:] for r in rows if r[0] == 1])
    cost, audit, lines = cheapest_long(held)
    assert (found["1"].cost, found["1"].audit) == (cost, audit)
    assert found["1"].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert {r.conv: r.duplicate for r in faults.collect()} == {"1": 299, "2": 0}


def cheapest_long(rows):
    """`cheapest` from the end on, so that Python's stack holds it: costs by state, then the least letters."""
    faults, states = faults_of(rows), ("", "s", "u", "a")
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    after = {s: (0, "", ()) if s in ("", "a") else None for s in states}
    table = []
    for i in range(len(rows), -1, -1):
        here = {s: after[s] if i == len(rows) else None for s in states}
        if i < len(rows):
            nxt, (_, own, _), fault = table[-1], rows[i], faults[i]
            for s in states:
                ways = [nxt[s] + 3]
                if fault not in ("blank", "duplicate"):
                    extra = int(fault == "truncated")
                    ways.append(nxt[due[s]] + 2 + extra)
                    if (s, own[:1]) in NEXT:
                        ways.append(nxt[NEXT[s, own[:1]]] + extra)
                here[s] = min(ways)
        else:
            here = {s: 0 if s in ("", "a") else 10**9 for s in states}
        for _ in range(3):
            here = {s: min(here[s], here[due[s]] + 2) for s in states}
        table.append(here)
    table.reverse()
    state, letters, lines = "", "", []
    for i, (_, own, text) in enumerate(rows):
        extra = int(faults[i] == "truncated")
        while True:
            here, nxt = table[i][state], table[i + 1]
            if here == nxt[state] + 3:
                letters += "D"
                break
            if here == table[i][due[state]] + 2:
                letters, state = letters + "I", due[state]
                lines.append({"u": "user:", "a": "assistant:"}[state])
                continue
            if (state, own[:1]) in NEXT and here == nxt[NEXT[state, own[:1]]] + extra:
                letters, state = letters + "K", NEXT[state, own[:1]]
                lines.append(f"{own}:{text}")
            else:
                letters, state = letters + "R", due[state]
                lines.append({"u": "user:", "a": "assistant:"}[state] + text)
            break
    while table[-1][state]:
        letters, state = letters + "I", due[state]
        lines.append({"u": "user:", "a": "assistant:"}[state])
    return table[0][""], letters, lines


CODES = st.lists(st.integers(0, 15), max_size=9)


@given(CODES, st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_reruns_and_splits_agree_with_one_run(codes, cut):
    """A stretch run again from any costs, and a split run, are the run over all rows."""
    grammar = Grammar()
    cut = min(cut, len(codes))
    left, right = codes[:cut], codes[cut:]
    whole = grammar.vectors(codes, END)
    middle = grammar.vectors(right, END)[0]
    assert middle == whole[cut]
    assert grammar.rerun(left, middle, grammar.vectors(left, END)) == whole[0]
    letters, state = grammar.traced(codes, END, 0)
    head, between = grammar.traced(left, middle, 0)
    tail, end = grammar.traced(right, END, between)
    assert (head + tail, end) == (letters, state)
    kinds = {0: "s", 1: "u", 2: "a", 3: "x"}
    rows = [(i, kinds[c // 4], "x") for i, c in enumerate(codes)]
    faults = [("", "blank", "duplicate", "truncated")[c % 4] for c in codes]
    cost, audit, _ = cheapest(rows, faults)
    assert "".join(letters) + "I" * (END[state] // 2) == audit
    assert cost >= 0 and vector(number(middle)) == middle


def test_vectors_are_few():
    """Costs that differ by a constant are one vector, so passes end soon whatever the rows are."""
    grammar, seen, todo = Grammar(), {END}, [END]
    while todo:
        costs = todo.pop()
        for code in range(16):
            found = grammar.back(code, costs)
            if found not in seen:
                seen.add(found)
                todo.append(found)
    assert len(seen) < 50
    assert max(max(v) for v in seen) < 10


def test_entered_by_levels(spark):
    rng = random.Random(1)
    tables = [{a: rng.randrange(3) for a in range(3)} for _ in range(23)]
    maps = spark.createDataFrame([("c", at, a, b) for at, t in enumerate(tables) for a, b in t.items()], "conv string, at long, a long, b long")
    for forward in (True, False):
        found = {r.at: r.a for r in entered(maps, 1, forward, fan=3).collect()}
        a = 1
        for at in range(23) if forward else range(22, -1, -1):
            assert found[at] == a
            a = tables[at][a]


def test_odd_conversations(spark):
    long = "word " * 400_000 + "."
    rows = [(None, None, None, None), (1, 1, "user", long), (1, None, "system", "First."), (2, 2**63 - 1, "user", "a."), (2, -(2**63), "user", "a."), (3, 5, "user", " ")]
    rows += [(3, 5, "user", " ")] * 2 + [(4, 4, "User", "No!"), (5, 0, "", "x?"), (-7, 3, "assistant", "é")]
    clashes = ("conv", "block", "code", "digest", "pos", "kind", "fault", "edits", "first", "at", "copy", "hit", "seen", "n", "blank", "salt", "part", "step")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in clashes})
    want = reports(rows)
    want[2] = (min(want[2][0], 2**63 - 1), *want[2][1:])
    assert results(repair_report(df)) == want
    assert repair_report(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More"), (1, 2, "assistant", ""), (1, 3, "user", "Hi."), (2, 0, "assistant", "A.")]
    steps, faults = repaired(spark.createDataFrame(rows, SCHEMA))
    by = defaultdict(list)
    for r in steps.collect():
        by[r.conv].append((r.step, r.edit, r.role, r.text, r.turn, r.cost))
    assert by["1"] == [
        (0, "K", "user", "Hi.", 0, 0), (1, "R", "assistant", "More", 1, 3), (2, "D", None, None, 2, 3), (3, "D", None, None, 3, 3),
    ]
    assert by["2"] == [(0, "I", "user", "", None, 2), (1, "K", "assistant", "A.", 0, 0)]
    assert {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) for r in faults.collect()} == {"1": (0, 1, 1, 1, 1), "2": (0, 0, 0, 0, 0)}
