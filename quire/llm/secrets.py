"""Secret scan behind a trigram inverted index.

Each rule is a regular expression. From its syntax tree a Boolean trigram query is derived: what every
match must contain. The texts of a step are indexed by exactly the trigrams that the queries name; the
postings are intersected and united as the queries say, and only the candidates are matched. A rule whose
query is empty (no mandatory trigram) scans every text in full. Rules whose expression would scan one run of
characters again from each of its positions name an anchor instead: they are matched outward from it.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import text_batches


@dataclass(frozen=True)
class Anchor:
    """How to match a rule outward from each place of `literal`: back over a run of the characters `run` to its
    first match of `head` in it, at least `least` characters before the literal; then `tail` from the literal on.

    Runs hold no literal, and no run is looked at twice, so the work follows the length of the text.
    """

    literal: str
    run: str
    head: str
    tail: str
    least: int = 0


@dataclass(frozen=True)
class Rule:
    """kind: its name. group, least: a match counts if that group has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    anchor: Anchor | None = None

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """The counted matches: the leftmost that don't overlap, less those that are too short."""
        if self.anchor is None:
            for m in self.regex.finditer(text):
                if m.end(self.group) - m.start(self.group) >= self.least:
                    yield m.start(), m.end()
            return
        head, tail, literal = re.compile(self.anchor.head), re.compile(self.anchor.tail, re.ASCII), self.anchor.literal
        done, at = 0, text.find(literal)
        while at >= 0:
            low = at
            while low > done and text[low - 1] in self.anchor.run:
                low -= 1
            start = head.search(text, low, at)
            end = tail.match(text, at) if start and at - start.start() >= self.anchor.least else None
            if end:
                yield start.start(), end.end()
                done = end.end()
            else:
                done = max(done, at)
            at = text.find(literal, max(at + 1, done))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
_WORD = string.ascii_letters + string.digits
#: Further well-known credential formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", anchor=Anchor(".eyJ", _WORD + "_-", "eyJ", r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 11)),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@[^\s/]+", anchor=Anchor("://", string.ascii_lowercase + string.digits + "+.-", "[a-z]", r"://[^\s:/@]+:[^\s:/@]+@[^\s/]+")),
)

#: A query: None (anything may match), or a set of alternatives, each a set of trigrams all needed.
Query = frozenset[frozenset[str]] | None
#: Strings that one piece of a pattern may stand for before it counts as unknown.
MOST_STRINGS = 64


def _cross(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    return None if a is None or b is None or len(a) * len(b) > MOST_STRINGS else {x + y for x in a for y in b}


def _strings(op, value) -> set[str] | None:
    """All strings that a node matches, if they are few; None if unknown."""
    if op is C.LITERAL:
        return {chr(value)}
    if op is C.IN:
        if all(kind is C.LITERAL for kind, _ in value) and len(value) <= 8:
            return {chr(x) for _, x in value}
        return None
    if op is C.SUBPATTERN:
        return _sequence_strings(value[3])
    if op is C.BRANCH:
        parts = [_sequence_strings(x) for x in value[1]]
        return None if any(x is None for x in parts) else set().union(*parts)
    if op is C.MAX_REPEAT and value[1] <= 3:
        part, found = _sequence_strings(value[2]), set()
        for times in range(value[0], value[1] + 1):
            power = {""}
            for _ in range(times):
                power = _cross(power, part)
            if power is None:
                return None
            found |= power
        return found
    return {""} if op is C.AT else None


def _sequence_strings(nodes) -> set[str] | None:
    found = {""}
    for op, value in nodes:
        found = _cross(found, _strings(op, value))
    return found


def _sequence_query(nodes) -> Query:
    """The best single requirement along a sequence of nodes: that of its most demanding piece."""
    options, held = [], {""}

    def close() -> None:
        if held != {""} and all(len(s) >= 3 for s in held):
            options.append(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in held))

    for op, value in nodes:
        joined = _cross(held, _strings(op, value))
        if joined is not None:
            held = joined
            continue
        close()
        held = {""}
        inner = None
        if op is C.SUBPATTERN:
            inner = _sequence_query(value[3])
        elif op is C.MAX_REPEAT and value[0] >= 1:
            inner = _sequence_query(value[2])
        elif op is C.BRANCH:
            parts = [_sequence_query(x) for x in value[1]]
            inner = None if any(x is None for x in parts) else frozenset().union(*parts)
        if inner is not None:
            options.append(inner)
    close()
    return max(options, key=lambda q: (min(map(len, q)), -len(q)), default=None)


def trigram_query(rule: Rule) -> Query:
    """What each match of the rule must contain, in lower case; None if there is no mandatory trigram."""
    query = _sequence_query(parser.parse(rule.pattern))
    return query and frozenset(frozenset(t.lower() for t in part) for part in query)


class TrigramIndex:
    """Postings of the trigrams in `wanted`, over the texts of one step, ignoring ASCII case."""

    LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

    def __init__(self, wanted: set[str]):
        self.number = {t: i for i, t in enumerate(sorted(wanted))}
        code = {t: t.encode() for t in wanted}
        if any(len(c) != 3 for c in code.values()):
            raise ValueError("only ASCII literals can be indexed")
        self.table = np.full(1 << 24, -1, dtype=np.int16)
        for t, i in self.number.items():
            self.table[int.from_bytes(code[t], "big")] = i

    def postings(self, texts: list[bytes]) -> list[set[int]]:
        found: list[set[int]] = [set() for _ in self.number]
        data = self.LOWER[np.frombuffer(b"\0\0".join(texts) + b"\0\0", dtype=np.uint8)].astype(np.uint32)
        if len(data) < 3:
            return found
        hit = self.table[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(hit >= 0)
        ends = np.cumsum([len(t) + 2 for t in texts])
        pairs = np.unique(hit[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        for pair in pairs.tolist():
            found[pair // len(texts)].add(pair % len(texts))
        return found


def candidates(query: Query, index: TrigramIndex, postings: list[set[int]], n: int) -> range | list[int]:
    if query is None:
        return range(n)
    united: set[int] = set()
    for part in query:
        lists = sorted((postings[index.number[t]] for t in part), key=len)
        united |= set.intersection(*lists)
    return sorted(united)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, kinds array<string>, starts, ends array<int>) for each row of docs.

    The arrays list every counted match of every rule by start, then in the order of the rules; offsets
    are code points, ends exclusive. Of each rule the leftmost matches that don't overlap are taken, then
    those that are too short go. Null and empty texts have none; repeated rows repeat. One pass, no
    shuffle; the index of a step holds the texts of that step only.
    """
    queries = [trigram_query(rule) for rule in rules]
    wanted = set().union(*(part for query in queries if query for part in query))

    def run(batches):
        index = TrigramIndex(wanted)
        for batch in text_batches(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            postings = index.postings([t.encode() for t in texts])
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, query) in enumerate(zip(rules, queries)):
                for i in candidates(query, index, postings, len(texts)):
                    spans[i] += [(start, k, end) for start, end in rule.spans(texts[i])]
            for found in spans:
                found.sort()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[rules[k].kind for _, k, _ in s] for s in spans], pa.list_(pa.string())), pa.array([[x for x, _, _ in s] for s in spans], pa.list_(pa.int32())), pa.array([[x for _, _, x in s] for s in spans], pa.list_(pa.int32()))],
                ["id", "kinds", "starts", "ends"],
            )

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, kinds array<string>, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)
