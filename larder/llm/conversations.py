"""Repair of conversation structure by the cheapest edits, found with a parallel Viterbi."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import stored

#: Rows of one stretch of a conversation, and stretches that are joined at once.
CHUNK = 4096
FAN = 1024
BLANKS = " \t\n\x0b\x0c\r"
OPEN, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = ("system", "user", "assistant")
OTHER = 3
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What each state waits for, if not s: the next state, which names the role too.
DUE = (USER, USER, ASSISTANT, USER)
DELETE, CHANGE, INSERT, UNFINISHED = 3, 2, 2, 1
#: What it costs to finish after the last row, from each state.
END = (0, 4, 2, 0)
#: Neighbours that are legal, as kinds: su, ua, au.
LEGAL = np.zeros((4, 4), dtype=bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True

Costs = tuple[int, int, int, int]


class Grammar:
    """Costs to go before a row from those after it, and the edits that reach them; remembered, as there are few."""

    def __init__(self) -> None:
        self.before: dict[tuple[int, Costs], Costs] = {}
        self.edits: dict[tuple[int, Costs, int], tuple[str, int]] = {}

    @staticmethod
    def kept(kind: int, state: int) -> int | None:
        """The state after a row is kept, if it may be."""
        if kind == 0:
            return SYSTEM if state == START else None
        return kind + 1 if kind != OTHER and DUE[state] == kind + 1 else None

    def costs(self, code: int, after: Costs) -> list[int]:
        """The cheapest way from each state before a row, given the costs after it."""
        kind, fault = divmod(code, 4)
        out = [DELETE + c for c in after]
        if fault not in (BLANK, DUPLICATE):
            extra = UNFINISHED if fault == TRUNCATED else 0
            for state in range(4):
                to = self.kept(kind, state)
                ways = [CHANGE + after[DUE[state]]] + ([after[to]] if to is not None else [])
                out[state] = min(out[state], extra + min(ways))
        out[USER], out[ASSISTANT] = min(out[USER], out[ASSISTANT] + INSERT), min(out[ASSISTANT], out[USER] + INSERT)
        for state in (START, SYSTEM):
            out[state] = min(out[state], out[USER] + INSERT)
        return out

    def back(self, code: int, after: Costs) -> Costs:
        """`costs` without their smallest: vectors that differ by a constant are one."""
        key = code, after
        if key not in self.before:
            found = self.costs(code, after)
            self.before[key] = tuple(c - min(found) for c in found)
        return self.before[key]

    def forward(self, code: int, after: Costs, state: int) -> tuple[str, int]:
        """The least letters of all cheapest ways over a row, and the state after it."""
        key = code, after, state
        if key not in self.edits:
            kind, fault = divmod(code, 4)
            here, extra, letters = self.costs(code, after), UNFINISHED if fault == TRUNCATED else 0, ""
            while True:
                if here[state] == DELETE + after[state]:
                    self.edits[key] = letters + "D", state
                    break
                if here[state] == INSERT + here[DUE[state]]:
                    letters, state = letters + "I", DUE[state]
                    continue
                to = self.kept(kind, state)
                if to is not None and here[state] == extra + after[to]:
                    self.edits[key] = letters + "K", to
                else:
                    self.edits[key] = letters + "R", DUE[state]
                break
        return self.edits[key]

    def vectors(self, codes: list[int], after: Costs) -> list[Costs]:
        """Costs before each row and, last, after all of them."""
        out = [after]
        for code in reversed(codes):
            out.append(self.back(code, out[-1]))
        return out[::-1]

    def rerun(self, codes: list[int], after: Costs, base: list[Costs]) -> Costs:
        """Costs before the first row, from other costs after the last one: as soon as they equal the first run's, its end is theirs."""
        for i in range(len(codes) - 1, -1, -1):
            if after == base[i + 1]:
                return base[0]
            after = self.back(codes[i], after)
        return after

    def traced(self, codes: list[int], after: Costs, state: int) -> tuple[list[str], int]:
        """Each row's letters and the state after the last one."""
        out = []
        for code, costs in zip(codes, self.vectors(codes, after)[1:], strict=True):
            letters, state = self.forward(code, costs, state)
            out.append(letters)
        return out, state


def number(costs: Costs) -> int:
    return sum(c << 8 * i for i, c in enumerate(costs))


def vector(n: int) -> Costs:
    return tuple(n >> 8 * i & 255 for i in range(4))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by crc32(``conv_id:turn``) % 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 removes the characters ``.!?``, 3
    repeats the row, 4 makes the role user.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = rows.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("hit")).where("hit <> 0")
    return hit.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate(F.coalesce("text", blank), ".!?", "")).otherwise(F.coalesce("text", blank)).alias("text"),
        F.explode(F.expr("if(hit = 3, array(0, 1), array(0))")).alias("copy"),
    ).drop("copy")


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with their conversation as text, the digest that stands for the text, and whether it is blank or truncated."""
    blank = F.lit(" ")
    plain = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), blank).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    return plain.select(
        "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("unfinished"), "text"
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows without their texts, numbered through in the order of (conversation, turn, role, digest)."""
    slim = rows.drop("text").withColumn("salt", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "digest", "salt"]
    inside = slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("inside", F.monotonically_increasing_id())
    placed = stored(inside.withColumn("part", F.shiftright("inside", 33)), "turns")
    counts = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # one for each task
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total - (part << 33)))
        total += counts[part]
    offsets = rows.sparkSession.createDataFrame(starts, "part long, offset long")
    return placed.join(F.broadcast(offsets), "part").withColumn("pos", F.col("inside") + F.col("offset")).drop("inside", "offset", "part")


def _chunks(turns: DataFrame, chunk: int) -> DataFrame:
    """(conv, block, codes, ...): each conversation in stretches of ``chunk`` rows at most; stored.

    A code holds the role's initial and the row's first fault.
    """
    key = ["conv", "role", "digest"]
    again = turns.where("NOT blank").groupBy(*key).agg(F.min("pos").alias("seen"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("seen"), DUPLICATE).when(F.col("unfinished"), TRUNCATED).otherwise(OPEN)
    coded = turns.join(again, key, "left").withColumns({"fault": fault, "code": (kind * 4 + fault).cast("int")})
    whole = coded.groupBy("conv", F.expr(f"pos div {chunk}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"),
        F.min(F.struct("pos", "turn", "role", "digest")).alias("first"),
        *[F.count_if(F.col("fault") == f).alias(name) for f, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))],
    )
    return stored(whole.withColumn("codes", F.expr("transform(rows, r -> r.code)")).drop("rows"), "chunks")


def entered(maps: DataFrame, start: int, forward: bool, fan: int = FAN) -> DataFrame:
    """(conv, at, a): with what each stretch is entered, from ``maps`` (conv, at, a, b) of what it leaves with.

    The first stretch, which is number 0 or, backward, the highest, is entered
    with ``start``.  Runs of ``fan`` stretches are composed, and those again,
    until one is left of each conversation; then what enters is handed down.
    """

    def tables(held: pd.DataFrame) -> list[tuple[int, dict[int, int]]]:
        by = {at: dict(zip(own["a"].tolist(), own["b"].tolist(), strict=True)) for at, own in held.groupby("at")}
        return sorted(by.items(), reverse=not forward)

    def compose(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        steps, out = tables(held), []
        for a in steps[0][1]:
            b = a
            for _, table in steps:
                b = table[b]
            out.append((key[0], key[1], a, b))
        return pd.DataFrame(out, columns=["conv", "at", "a", "b"])

    def walk(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        a, out = int(held["enters"].iloc[0]), []
        for at, table in tables(held):
            out.append((key[0], at, a))
            a = table[a]
        return pd.DataFrame(out, columns=["conv", "at", "a"])

    runs = maps.withColumn("run", F.expr(f"at div {fan}"))
    whole = stored(runs.groupBy("conv", "run").applyInPandas(compose, "conv string, at long, a long, b long"), "runs")
    tops = whole.select("conv", "at").distinct().withColumn("a", F.lit(start).cast("long"))
    if not whole.where("at > 0").isEmpty():
        tops = entered(whole, start, forward, fan)
    tops = tops.select("conv", F.col("at").alias("run"), F.col("a").alias("enters"))
    return stored(runs.join(tops, ["conv", "run"]).groupBy("conv", "run").applyInPandas(walk, "conv string, at long, a long"), "entered")


def _costs_after(split: DataFrame, fan: int) -> DataFrame:
    """(conv, at, a): the costs to go after each stretch of the conversations that are split.

    Every stretch is first run from the costs at a conversation's end.  Where
    that gives other costs before it, all stretches are run again from those,
    each only until its costs differ from the first run's by a constant.  The
    costs of two states differ by a bounded number, so there are few vectors
    and few passes, whether or not the runs converge.
    """

    def passed(starts: list[int]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grammar = Grammar()
            for rows in batches:
                out = []
                for conv, at, codes in zip(rows["conv"], rows["at"], rows["codes"], strict=True):
                    codes = codes.tolist()
                    base = grammar.vectors(codes, END)
                    out += [(conv, at, a, number(grammar.rerun(codes, vector(a), base))) for a in starts]
                yield pd.DataFrame(out, columns=["conv", "at", "a", "b"])

        return stored(split.select("conv", "at", "codes").mapInPandas(run, "conv string, at long, a long, b long"), "passed")

    maps, seen, new = None, set(), [number(END)]
    while new:
        found = passed(new)
        seen |= set(new)
        new = sorted({r.b for r in found.select("b").distinct().collect()} - seen)
        maps = found if maps is None else maps.unionByName(found)
    return entered(maps, number(END), forward=False, fan=fan)


def _states_before(split: DataFrame, fan: int) -> DataFrame:
    """(conv, at, a): the state before each stretch, of which the costs after it are known as ``after``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar()
        for rows in batches:
            out = []
            for conv, at, codes, after in zip(rows["conv"], rows["at"], rows["codes"], rows["after"], strict=True):
                out += [(conv, at, s, grammar.traced(codes.tolist(), vector(after), s)[1]) for s in range(4)]
            yield pd.DataFrame(out, columns=["conv", "at", "a", "b"])

    return entered(split.mapInPandas(run, "conv string, at long, a long, b long"), START, forward=True, fan=fan)


def _edits(chunks: DataFrame, fan: int) -> DataFrame:
    """(conv, block, first, edits, illegal): each stretch's letters for its rows, separated by blanks; stored.

    The letters that finish a conversation stand after its last row's.
    """
    spans = chunks.groupBy("conv").agg(F.min("block").alias("lowest"), F.max("block").alias("highest"))
    placed = chunks.join(spans, "conv").withColumn("at", F.col("block") - F.col("lowest"))
    split = stored(placed.where("highest > lowest").select("conv", "at", "codes"), "split")
    entry = chunks.sparkSession.createDataFrame([], "conv string, at long, after long, state long, previous int")
    if not split.isEmpty():
        after = _costs_after(split, fan).withColumnRenamed("a", "after")
        known = stored(split.join(after, ["conv", "at"]), "known")
        states = _states_before(known, fan).withColumnRenamed("a", "state")
        ends = split.select("conv", (F.col("at") + 1).alias("at"), F.expr("int(element_at(codes, -1) div 4)").alias("previous"))
        entry = known.select("conv", "at", "after").join(states, ["conv", "at"]).join(ends, ["conv", "at"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar()
        for rows in batches:
            out = []
            for codes, after, state, previous, is_last in zip(rows["codes"], rows["after"], rows["state"], rows["previous"], rows["is_last"], strict=True):
                letters, at_end = grammar.traced(codes.tolist(), vector(after), state)
                if is_last and END[at_end]:
                    letters.append("I" * (END[at_end] // INSERT))
                kinds = codes // 4 if previous < 0 else np.concatenate([[previous], codes // 4])
                out.append((" ".join(letters), int((~LEGAL[kinds[:-1], kinds[1:]]).sum())))
            made = pd.DataFrame(out, columns=["edits", "illegal"])
            yield pd.concat([rows[["conv", "block", "first"]].reset_index(drop=True), made], axis=1)

    ready = placed.join(entry, ["conv", "at"], "left").select(
        "conv",
        "block",
        "first",
        "codes",
        F.coalesce("after", F.lit(number(END))).alias("after"),
        F.coalesce("state", F.lit(START)).alias("state"),
        F.coalesce("previous", F.lit(-1)).alias("previous"),
        (F.col("block") == F.col("highest")).alias("is_last"),
    )
    first = "struct<pos: long, turn: long, role: string, digest: binary>"
    return stored(ready.mapInPandas(run, f"conv string, block long, first {first}, edits string, illegal long"), "edits")


STEPS = "conv string, step long, edit string, role string, text string, turn string, cost long"


def _steps(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """All edits of all conversations; a conversation's are together in one partition, in order.

    The letters of a stretch come in front of its rows and wait in a queue;
    rows that are equal in all of the order are the same, so it doesn't matter
    which of them a letter meets.
    """
    none, names = F.lit(None), [c.split()[0] for c in STEPS.split(", ")]
    order = ["conv", "turn", "role", "digest", "block"]
    letters = edits.select("conv", "first.turn", "first.role", "first.digest", "block", "edits", none.cast("string").alias("text"), F.lit(False).alias("unfinished"))
    texts = rows.select("conv", "turn", "role", "digest", F.lit(2**62).alias("block"), none.cast("string").alias("edits"), "text", "unfinished")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, step, waiting = None, START, 0, deque()

        def inserted(out: list, letters: str) -> None:
            nonlocal state, step
            for _ in letters:
                state = DUE[state]
                out.append((conv, step, "I", ROLES[state - 1], "", None, INSERT))
                step += 1

        for held in batches:
            out: list[tuple] = []
            for own, turn, role, edits, text, unfinished in zip(*(held[c].tolist() for c in ("conv", "turn", "role", "edits", "text", "unfinished")), strict=True):
                if own != conv:
                    inserted(out, "".join(waiting))
                    conv, state, step = own, START, 0
                    waiting.clear()
                if edits is not None:
                    waiting.extend(edits.split(" "))
                    continue
                letters = waiting.popleft()
                inserted(out, letters[:-1])
                edit, extra = letters[-1], UNFINISHED if unfinished else 0
                if edit == "D":
                    out.append((conv, step, edit, None, None, turn, DELETE))
                elif edit == "K":
                    state = SYSTEM if role[0] == "s" else DUE[state]
                    out.append((conv, step, edit, role, text, turn, extra))
                else:
                    state = DUE[state]
                    out.append((conv, step, edit, ROLES[state - 1], text, turn, CHANGE + extra))
                step += 1
            yield pd.DataFrame(out, columns=names)
        out = []
        inserted(out, "".join(waiting))
        yield pd.DataFrame(out, columns=names)

    together = letters.unionByName(texts).select(*order, "edits", "text", "unfinished")
    sorted_rows = together.repartition("conv").sortWithinPartitions(*order)
    # Turns as text: beside a null, pandas would make doubles of them.
    plain = sorted_rows.select("conv", F.col("turn").cast("string"), "role", "edits", "text", "unfinished")
    return plain.mapInPandas(walk, STEPS).withColumn("turn", F.col("turn").cast("long"))


def repaired(rows: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits that make each conversation's roles read ``(s?(ua)+)?``, and what was wrong.

    ``rows`` has conv_id, turn, role and text.  A conversation's rows are
    taken by turn, nulls first, then by role and the text's SHA-256.  A row is
    blank (no text but blanks), else a duplicate (role and text seen earlier),
    else truncated (the last character that is no blank is none of ``.!?``).
    Keeping a row costs 0, changing its role 2, deleting it 3, inserting an
    empty row 2; blank and duplicate rows must be deleted, truncated ones
    cost 1 more unless deleted.  Of the cheapest edits those with the least
    letters (D, I, K, R) are taken.

    The first result has a row for each edit: conv (conv_id as text, one space
    for null), step, edit, role and text as repaired (null if deleted), turn
    (null if inserted) and cost; a conversation's steps are together in one
    partition, in order.  The second has a row for each conversation: conv,
    gaps, blank, duplicate, truncated and illegal.

    Costs to go are found from the end, in stretches of ``chunk`` rows at
    once, however long a conversation is: see `_costs_after`.  Only the last
    walk over the texts takes a conversation in one task, row by row, as its
    steps are in order there.

    A null role or text is one space; roles other than s, u and a by their
    first letter can't be kept, an empty one neither.  Repeated rows are
    duplicates.  An empty table has no edits.  Other columns are ignored.
    """
    ready = _prepared(rows)
    turns = _numbered(ready)
    chunks = _chunks(turns, chunk)
    edits = _edits(chunks, fan)
    wide = F.col("turn").cast("decimal(20,0)")
    gap = F.max(wide) - F.min(wide) + 1 - F.countDistinct("turn")
    gaps = turns.groupBy("conv").agg(F.least(F.coalesce(gap, F.lit(0)), F.lit(2**63 - 1)).cast("long").alias("gaps"))
    faults = chunks.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    illegal = edits.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    return _steps(ready, edits), gaps.join(faults, "conv").join(illegal, "conv")


def digests(steps: DataFrame) -> DataFrame:
    """(conv, cost, audit, repaired_sha256) of the steps of `repaired`, read in their order.

    A digest of all text is made from its start to its end, so a
    conversation's passes through one task, a row at a time.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, total, letters, digest, empty = None, 0, [], hashlib.sha256(), True
        for held in batches:
            out = []
            for own, edit, role, text, cost in zip(*(held[c].tolist() for c in ("conv", "edit", "role", "text", "cost")), strict=True):
                if own != conv:
                    if conv is not None:
                        out.append((conv, total, "".join(letters), digest.hexdigest()))
                    conv, total, letters, digest, empty = own, 0, [], hashlib.sha256(), True
                letters.append(edit)
                total += cost
                if edit != "D":
                    digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                    empty = False
            yield pd.DataFrame(out, columns=["conv", "cost", "audit", "repaired_sha256"])
        if conv is not None:
            yield pd.DataFrame([(conv, total, "".join(letters), digest.hexdigest())], columns=["conv", "cost", "audit", "repaired_sha256"])

    return steps.mapInPandas(read, "conv string, cost long, audit string, repaired_sha256 string")


def repair_report(rows: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row for each conv_id of ``rows``: what is wrong after `damaged`, and the digest of the repair.

    A conversation that loses all rows has zeros, an empty audit and the
    digest of an empty text.  A null conv_id is a conversation of its own.
    """
    named = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), "conv_id").distinct()
    steps, faults = repaired(damaged(rows), chunk, fan)
    whole = named.join(faults, "conv", "left").join(digests(steps), "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
