"""Secrets in text, found through a trigram inverted index.

Each rule's pattern is parsed and turned into a Boolean query over trigrams that
any match must contain. Batches of documents are indexed by those trigrams
(postings: trigram -> documents), the postings are intersected and joined as each
query says, and only the documents left are searched with the pattern. A rule
from which no mandatory trigram follows is searched in every document.

Defined cases: null text is read as empty; an empty text has no spans; texts of
any length are handled whole; repeated rows are answered once each; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from re import _constants as sre
from re import _parser as parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, counts_of, pick, spans_text

Query = frozenset | None  # a set of alternatives, each a set of trigrams that must all occur; None: no condition
_MOST = 64  # strings or alternatives kept while a query is derived; beyond, the condition is weakened, never wrong


def either_case(word: str) -> str:
    """A pattern for word with ASCII letters in either case (IGNORECASE would also take two other letters)."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)
    base: bool = False


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, base=True),
    # A run of hexadecimal characters is matched whole, so the least length can stand in the pattern.
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # Only from where its run of characters begins: from each eyJ in a long run it would cost the run's square.
    Rule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/:@]++@[A-Za-z0-9.-]+"),
)
_RANK = {r.kind: i for i, r in enumerate(RULES)}


def _trigrams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _any(strings: set[str]) -> Query:
    """Condition that one of strings occurs."""
    if not strings or len(strings) > _MOST or min(map(len, strings)) < 3:
        return None
    return frozenset(_trigrams(s) for s in strings)


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a or b
    if len(a) * len(b) > _MOST:
        return a if len(a) <= len(b) else b
    return frozenset(x | y for x in a for y in b)


def _or(a: Query, b: Query) -> Query:
    return None if a is None or b is None or len(a | b) > _MOST else a | b


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """Of a parsed element: the strings it can match, case folded (None: too many), and its condition."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN and all(k is sre.LITERAL or (k is sre.RANGE and v[1] - v[0] < 8) for k, v in arg):
        chars = {chr(c).lower() for k, v in arg for c in ([v] if k is sre.LITERAL else range(v[0], v[1] + 1))}
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        exact = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
        query = found[0][1] or _any(found[0][0] or set())
        for s, q in found[1:]:
            query = _or(query, q or _any(s or set()))
        return (exact, None) if exact is not None and len(exact) <= _MOST else (None, query)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = arg
        exact, query = _sequence(body)
        if exact is not None and most <= 4 and len(exact) ** most <= _MOST:
            return {"".join(p) for n in range(least, most + 1) for p in product(exact, repeat=n)}, None
        return None, (query or _any(exact or set())) if least else None
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, None
    return None, None


def _sequence(items) -> tuple[set[str] | None, Query]:
    """Strings of neighbours are joined as long as they are few; each joined stretch gives a condition."""
    query: Query = None
    run, whole = {""}, True
    for op, arg in items:
        exact, own = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= _MOST:
            run = {a + b for a in run for b in exact}
            continue
        query, whole = _and(_and(query, _any(run)), own), False
        run = exact if exact is not None else {""}
    return (run, None) if whole else (None, _and(query, _any(run)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, folded to lower case; None if a match needs no particular one."""
    exact, query = _sequence(parser.parse(pattern))
    return _any(exact) if exact is not None else query


class Scanner:
    """Rules with their queries, compiled once for each worker."""

    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        grams = sorted({g for _, _, q in self.rules for alt in q or () for g in alt if g.isascii()})
        self.number = {g: i + 1 for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 21, np.uint16)
        for g, i in self.number.items():
            a, b, c = g.encode()
            self.table[a << 14 | b << 7 | c] = i
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.fold[128:] = 0

    def postings(self, texts: list[str]) -> dict[int, np.ndarray]:
        """Trigram number -> documents of the batch that have it."""
        joined = "\0\0".join(texts).encode()
        starts = np.cumsum([0, *(len(t.encode()) + 2 for t in texts)])
        found = []
        step = 1 << 22
        for at in range(0, len(joined), step):
            u = self.fold[np.frombuffer(joined, np.uint8, min(step + 2, len(joined) - at), at)].astype(np.uint32)
            if len(u) < 3:
                break
            ids = self.table[u[:-2] << 14 | u[1:-1] << 7 | u[2:]]
            at_hits = np.flatnonzero(ids)
            doc = np.searchsorted(starts, at_hits + at, "right") - 1
            found.append(np.unique(ids[at_hits].astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64)))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        gram, doc = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return {i: doc[np.searchsorted(gram, i) : np.searchsorted(gram, i + 1)] for i in self.number.values()}

    def candidates(self, query: Query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        out = np.zeros(0, np.int64)
        for alternative in query:
            lists = sorted((index[self.number[g]] for g in alternative if g in self.number), key=len)
            left = lists[0] if lists else np.arange(n)
            for other in lists[1:]:
                left = np.intersect1d(left, other, assume_unique=True)
            out = np.union1d(out, left)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        index = self.postings(texts)
        for rule, pattern, query in self.rules:
            for i in self.candidates(query, index, len(texts)):
                out[i] += [(rule.kind, *m.span()) for m in pattern.finditer(texts[i]) if rule.keep(m)]
        for spans in out:
            spans.sort(key=lambda s: (s[1], _RANK[s[0]]))
        return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) in code points, by start, then rule. One row per document."""

    def run(batches):
        scanner = Scanner()
        for b in batches:
            yield {"doc_id": b["doc_id"], "spans": [[{"kind": k, "start": a, "end": z} for k, a, z in s] for s in scanner.scan(b["text"])]}

    return arrow_map(pick(docs, "doc_id", "text"), run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """The columns that op6 returns: counts and hash of base spans, all spans as text, and how many of them."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = tuple(_RANK)
    return found.select("doc_id", *counts_of("spans", BASE_KINDS), F.sha2(spans_text(base, kinds), 256).alias("base_sha256"), spans_text(F.col("spans"), kinds).alias("spans"), F.size("spans").cast("bigint").alias("n_found"))
