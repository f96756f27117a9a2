"""Secret scans: a trigram index asks which texts a rule can match, and those are verified."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _constants as C  # noqa: PLC2701
from re import _parser as parser  # noqa: PLC2701

from larder.llm.common import text_or_empty

#: Texts of one index segment; a longer text makes a segment of its own.
SEGMENT_CHARS = 4_000_000
#: Bytes of a segment whose trigrams are numbers at once.
STRETCH = 1 << 18
#: A string set of a regex part is given up beyond this size.
MOST_STRINGS = 64
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Rule:
    """``least``: code points that ``group`` must have; shorter matches are dropped.  ``span``: the group that is the secret."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII
    span: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.finditer(self.pattern, text, self.flags)
        return [m.span(self.span) for m in found if m.end(self.group) - m.start(self.group) >= self.least]


ANY_CASE = re.ASCII | re.IGNORECASE
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ANY_CASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]
#: The method's own rules: formats of public services.
MORE = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Tried once for each run of such characters, from its first eyJ, or a run of many would take quadratic time.
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*)", span=1),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
]

#: A query in conjunctive form: each clause is a set of alternatives, each of
#: which is a set of trigrams that must all occur.
Query = list[frozenset[frozenset[bytes]]]


def trigrams(text: str) -> frozenset[bytes]:
    """Of the UTF-8 bytes, A-Z in lower case: the index doesn't tell them apart."""
    raw = text.encode().translate(LOWER)
    return frozenset(raw[i : i + 3] for i in range(len(raw) - 2))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The trigrams that every match has; empty if the rule has no mandatory ones."""
    query: Query = []
    _flush(_strings(parser.parse(pattern, flags), query), query)
    return query


def _flush(strings: set[str] | None, query: Query) -> None:
    """Add that one of ``strings`` occurs, if each has a trigram."""
    if strings:
        options = {trigrams(s) for s in strings}
        if all(options):
            query.append(frozenset(o for o in options if not any(p < o for p in options)))


def _strings(part, query: Query) -> set[str] | None:
    """All strings a sequence matches, or None; what is known of its pieces goes to ``query``."""
    run: set[str] | None = {""}
    exact = True
    for op, arg in part:
        own: set[str] | None = None
        if op is C.LITERAL:
            own = {chr(arg)}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            own = {chr(a) for _, a in arg}
        elif op is C.SUBPATTERN:
            own = _strings(arg[-1], query)
        elif op is C.BRANCH:
            own = _branches(arg[1], query)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            if (least, most) == (0, 1):
                inner = _strings(body, [])
                own = None if inner is None else {"", *inner}
            elif least >= 1:
                # One pass must occur, and what follows it is unknown.
                _flush(_strings(body, query), query)
        joined = None if own is None or run is None else {a + b for a in run for b in own}
        if joined is not None and len(joined) <= MOST_STRINGS:
            run = joined
        else:
            _flush(run, query)
            exact, run = False, own if own is not None else {""}
    if not exact:
        _flush(run, query)
    return run if exact else None


def _branches(branches, query: Query) -> set[str] | None:
    exact: set[str] | None = set()
    for branch in branches:
        own = _strings(branch, [])
        exact = None if own is None or exact is None else exact | own
    if exact is not None and len(exact) <= MOST_STRINGS:
        return exact
    options = []
    for branch in branches:
        inner = trigram_query_of(branch)
        if not inner:
            return None
        options.append(inner)
    # (a1 and a2) or (b1 and b2): only the first clause of each is asked for.
    query.append(frozenset(o for inner in options for o in inner[0]))
    return None


def trigram_query_of(part) -> Query:
    query: Query = []
    _flush(_strings(part, query), query)
    return query


class Segment:
    """The postings of some texts: for each wanted trigram, the texts that hold it."""

    def __init__(self, texts: list[str], wanted: Iterable[bytes]) -> None:
        raw = [t.encode().translate(LOWER) for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        whole = np.frombuffer(b"".join(raw), dtype=np.uint8)
        del raw
        self.size = len(texts)
        self.postings: dict[bytes, np.ndarray] = dict.fromkeys(wanted, np.array([], dtype=np.int64))
        if len(whole) < 3:
            return
        known = {t: int.from_bytes(t, "big") for t in self.postings}
        table = np.zeros(1 << 24, dtype=bool)
        table[list(known.values())] = True
        pairs = np.array([], dtype=np.int64)
        for start in range(0, len(whole) - 2, STRETCH):
            codes = whole[start : start + STRETCH + 2].astype(np.uint32)
            codes = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
            at = np.flatnonzero(table[codes])
            text = np.searchsorted(ends, at + start, side="right")
            inside = at + start + 2 < ends[text]
            pairs = np.union1d(pairs, (codes[at[inside]].astype(np.int64) << 32) | text[inside])
        for trigram, code in known.items():
            a, b = np.searchsorted(pairs, [code << 32, (code + 1) << 32])
            self.postings[trigram] = pairs[a:b] & 0xFFFFFFFF

    def candidates(self, query: Query) -> np.ndarray:
        """Texts that satisfy every clause; all texts if there is none."""
        held = np.arange(self.size)
        for clause in query:
            options = [self._all(option) for option in clause]
            held = np.intersect1d(held, np.unique(np.concatenate(options)), assume_unique=True)
        return held

    def _all(self, option: frozenset[bytes]) -> np.ndarray:
        lists = sorted((self.postings[t] for t in option), key=len)
        held = lists[0]
        for other in lists[1:]:
            held = np.intersect1d(held, other, assume_unique=True)
        return held


def find_spans(texts: list[str], rules: list[Rule], queries: list[Query]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text, by start, then in the order of the rules."""
    segment = Segment(texts, {t for q in queries for clause in q for option in clause for t in option})
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for i in segment.candidates(query).tolist():
            found[i] += [(a, order, b) for a, b in rule.spans(texts[i])]
    return [[(rules[k].kind, a, b) for a, k, b in sorted(f)] for f in found]


def segments(texts: Iterable[str], most: int = SEGMENT_CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _show(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame, more: list[Rule] | None = None) -> DataFrame:
    """The secrets of each text: counts and spans by rule.

    Each task indexes its texts in segments: postings of the trigrams that the
    rules' Boolean queries ask for.  A rule is run over the texts whose
    postings satisfy its query; the hex rule has no mandatory trigram and is
    run over all.  Nothing is shuffled.

    A null text is empty.  Every row of ``docs`` has its own result, repeated
    ones and null ids too; other columns are ignored.
    """
    rules = BASE + (MORE if more is None else more)
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    base = {r.kind for r in BASE}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [s for part in segments(rows["text"]) for s in find_spans(part, rules, queries)]
            own = [[s for s in spans if s[0] in base] for spans in found]
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    **{f"n_{r.kind}": [sum(s[0] == r.kind for s in o) for o in own] for r in BASE},
                    "base_sha256": [hashlib.sha256(_show(o).encode()).hexdigest() for o in own],
                    "spans": [_show(f) for f in found],
                }
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(scan, schema)


def redacted(docs: DataFrame, more: list[Rule] | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mask`` in place of each secret; ``n_chars`` follows, if there is one.

    Overlapping spans are masked together.  A null text stays null.
    """
    rules = BASE + (MORE if more is None else more)
    queries = [trigram_query(r.pattern, r.flags) for r in rules]

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        parts, at = [], 0
        for _, a, b in spans:
            if a >= at:
                parts += [text[at:a], mask]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        whole = [t for t in texts if t is not None]
        found = (s for part in segments(whole) for s in find_spans(part, rules, queries))
        return pd.Series([None if t is None else clean(t, next(found)) for t in texts], dtype=object)

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
