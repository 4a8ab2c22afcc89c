"""Secrets by an inverted index of trigrams.

A Boolean query over trigrams is derived from each rule's regular expression: what any match must hold.
Each piece of the table becomes an index segment with the postings of the trigrams that queries name;
queries intersect and unite postings, and the regular expression runs on the candidates alone. A rule
without mandatory trigrams runs on every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import spans as S
from .common import arrow_map, texts


@dataclass(frozen=True)
class Rule:
    """A match counts if group has at least least characters; matches that fail are dropped, not retried."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed by the contract: the first three kinds. The rest are public token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("ghtoken", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    # From the start of a run only, so that a run of many openings is read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
)
BASE = 3
#: Alternatives that a query keeps apart at a point of the expression; beyond, what follows starts anew.
MOST = 64

#: A query: True (anything), a trigram, ("and", queries) or ("or", queries).
Query = bool | str | tuple


def every(parts: list[Query]) -> Query:
    own = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not own else own[0] if len(own) == 1 else ("and", *own)


def some(parts: list[Query]) -> Query:
    own = list(dict.fromkeys(parts))
    return True if not own or True in own else own[0] if len(own) == 1 else ("or", *own)


def _of_string(s: str) -> Query:
    return every([s[i : i + 3] for i in range(len(s) - 2)])


def _members(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            found.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


class _Analysis:
    """Walks a parsed expression. exact: the strings that what was read since the last gap can be, lower-cased."""

    def __init__(self) -> None:
        self.query: list[Query] = []
        self.exact: set[str] = {""}

    def gap(self) -> None:
        """Something that could be many strings follows: what is known so far becomes a condition."""
        self.query.append(some([_of_string(s) for s in sorted(self.exact)]))
        self.exact = {""}

    def then(self, strings: set[str]) -> None:
        if len(self.exact) * len(strings) > MOST:
            self.gap()
        self.exact = {a + b for a in self.exact for b in strings}

    def walk(self, items) -> None:
        for op, arg in items:
            if op is C.LITERAL:
                self.then({chr(arg).lower()})
            elif op is C.IN:
                found = _members(arg)
                self.then(found) if found else self.gap()
            elif op is C.SUBPATTERN:
                self.walk(arg[3])
            elif op is C.BRANCH:
                ways = [_exact(w) for w in arg[1]]
                if all(w is not None for w in ways) and sum(map(len, ways)) <= MOST:
                    self.then(set().union(*ways))
                else:
                    self.gap()
                    self.query.append(some([query_of(w) for w in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                least, most, inner = arg
                once = _exact(inner)
                if most == 1 and once is not None:
                    self.then(once | {""})
                elif least == most and once is not None and len(once) == 1:
                    self.then({next(iter(once)) * least})
                else:
                    if least >= 1:
                        one = query_of(inner)
                        self.gap()
                        self.query.append(one)
                    self.gap()
            elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):
                self.gap()


def _exact(items) -> set[str] | None:
    """All strings that the items match, lower-cased, if they are few."""
    a = _Analysis()
    a.walk(items)
    return a.exact if not a.query else None


def query_of(items) -> Query:
    a = _Analysis()
    a.walk(items)
    a.gap()
    return every(a.query)


def trigram_query(pattern: str) -> Query:
    """The condition on a text's trigrams, A-Z lower-cased, that any match of the pattern implies."""
    return query_of(parser.parse(pattern))


def named(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(named, query[1:]))


def _packed(trigram: str) -> int:
    a, b, c = trigram.encode("latin-1")
    return a << 16 | b << 8 | c


class Segment:
    """Postings of the wanted trigrams over some texts: ordinals of the texts, ascending."""

    def __init__(self, column: pa.Array, wanted: dict[str, int], lookup: np.ndarray) -> None:
        column = pc.fill_null(column, "").cast(pa.string())
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + self.n + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        folded = _FOLD[raw]
        number = np.zeros(0, dtype=lookup.dtype)
        if len(folded) > 2:
            code = folded[:-2].astype(np.int32)
            code <<= 8
            code |= folded[1:-1]
            code <<= 8
            code |= folded[2:]
            number = lookup[code]
        at = np.flatnonzero(number)
        row = np.searchsorted(offsets - offsets[0], at, side="right") - 1
        # A trigram across two texts only adds a candidate.
        self.postings = {t: np.unique(row[number[at] == k]) for t, k in wanted.items()}

    def find(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        found = [self.find(q) for q in query[1:]]
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@lru_cache(maxsize=4)
def _plan(rules: tuple[Rule, ...]) -> tuple[list, dict[str, int], np.ndarray]:
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = {t: k for k, t in enumerate(sorted(set().union(*map(named, queries))), 1)}
    # A byte a trigram while 255 numbers do, and as many bytes as more of them take.
    lookup = np.zeros(1 << 24, dtype=np.min_scalar_type(len(wanted)))
    for t, k in wanted.items():
        lookup[_packed(t)] = k
    compiled = []
    for r in rules:
        # A run of one class without a group is found at its full length only.
        run = re.fullmatch(r"(\[[^\[\]^\\]+\])\+", r.pattern)
        compiled.append(re.compile(f"{run[1]}{{{r.least},}}" if run and not r.group else r.pattern, re.ASCII))
    return [*zip(rules, queries, compiled, strict=True)], wanted, lookup


def scan(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[S.Span]]:
    """For each text (start, number of the rule, end) of all that the rules find."""
    plan, wanted, lookup = _plan(rules)
    segment = Segment(column, wanted, lookup)
    own = texts(column)
    found: list[list[S.Span]] = [[] for _ in own]
    for k, (rule, query, compiled) in enumerate(plan):
        for row in segment.find(query).tolist():
            for m in compiled.finditer(own[row]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[row].append((m.start(), k, m.end()))
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: int = BASE) -> DataFrame:
    """id_col, n_<kind> for the first base rules, base_sha256 over their spans, spans of all rules.

    Matches are leftmost and do not overlap within a kind. Null text is empty; a text without secrets
    has an empty list and its digest; each row stands for itself, repeated or not. Very long texts are read
    whole, each rule in linear time; an empty table gives none.
    """
    kinds = tuple(r.kind for r in rules)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan(batch.column(1), rules)
        own = [[s for s in x if s[1] < base] for x in found]
        counts = [pa.array([sum(s[1] == k for s in x) for x in own], pa.int64()) for k in range(base)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array([S.digest(S.line(x, kinds)) for x in own]), pa.array([S.line(x, kinds) for x in found])],
            [id_col, *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"],
        )

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + "".join(f"n_{k} bigint, " for k in kinds[:base]) + "base_sha256 string, spans string"
    return arrow_map(docs.select(id_col, text_col), run, schema, text_col)
