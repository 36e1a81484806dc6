"""Personal data in text, plain or disguised, with positions in the source.

A plain pass finds identifiers in the text itself. Then two transducers rewrite
disguises: one works on characters (look-alikes, wide and foreign digits,
invisible characters), one on words (spelled digits; at and dot written as words
or in brackets). Each writes, beside every output character, the source range
that it stands for, so a span found in the rewritten text maps back to source
characters exactly.

Defined cases: null text is read as empty; empty text has no spans; a text of any
length is handled whole; repeated rows are answered once each; other columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, batch_map, counts_of, pick, spans_text, with_column

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: were it possible, it would have been so at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @ outwards, which costs nothing in text that has none."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def plain_spans(text: str) -> list[Span]:
    """Identifiers written plainly, by start, then kind."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdecimal() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]]))


# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = dict(zip("аеорсхуіјѕһԁԛԝɡӏвнкмтАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι", "aeopcxyijshdqwglbhkmtABEKMHOPCTXIJSABEZHIKMNOPTYXoavi", strict=True))
_LOOKALIKES |= dict.fromkeys("。｡", ".")
_INVISIBLE = "­​‌‍⁠﻿"


@lru_cache(maxsize=4096)
def narrow(ch: str) -> str:
    """The ASCII character that ch imitates, nothing for an invisible one, else ch itself."""
    if ch in _INVISIBLE:
        return ""
    if ch in _LOOKALIKES:
        return _LOOKALIKES[ch]
    if (d := unicodedata.decimal(ch, None)) is not None:
        return str(d)
    if unicodedata.category(ch) == "Pd":
        return "-"
    flat = unicodedata.normalize("NFKC", ch)
    return flat if len(flat) == 1 and flat.isascii() else ch


_DIGIT_WORDS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
}
_DIGIT_WORDS["oh"] = "0"
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase", "dot|punkt|point|punto"
_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_DOT_ENTITY, _AT_ENTITY = "(?:&(?:#0*46|#x0*2e|period);|%2e)", "(?:&(?:#0*64|#x0*40|commat);|%40)"
# A mark takes the white space around it whole, so it is never sought from within a run of white space: that would cost its square.
_DOT_MARK = rf"(?:(?<!\s)\s*+[\[({{<]\s*+(?:{_DOT_WORDS}|\.)\s*+[\])}}>]\s*+|{_DOT_ENTITY})"
_AT_MARK = rf"(?:(?<!\s)\s*+[\[({{<]\s*+(?:{_AT_WORDS}|@)\s*+[\])}}>]\s*+|{_AT_ENTITY})"
_TIMES = {"double": 2, "triple": 3, "doble": 2, "doppel": 2}
_SEVERAL = rf"(?:{'|'.join(_TIMES)})\s+(?:(?:{_WORD})\b|[0-9]\b)"
_ITEM = rf"(?:{_SEVERAL}|(?:{_WORD}|{_DOT_WORDS}|dash|hyphen)\b|[0-9]+)"
_RUN = rf"(?:\bplus\s+|\+\s*)?(?<!\w){_ITEM}(?:(?:{_DOT_MARK}|[\s,.-]+){_ITEM}){{2,}}(?!\w)"
_PART = re.compile(rf"(?P<times>\b{_SEVERAL})|(?P<dot>{_DOT_MARK}|(?:{_DOT_WORDS})\b)|(?P<dash>dash|hyphen)|(?P<plus>plus)|(?P<word>(?:{_WORD})\b)|(?P<num>[0-9]+)|(?P<other>[\s\S])", re.I)
# A lone "at" between words is prose; it counts only where a dot is spelled after it.
_SPELLED_AT = rf"(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\s+dot\s+|{_DOT_MARK})[A-Za-z0-9])"
_SPELLED_DOT = r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])"
_SPACED_AT = r"(?<=[A-Za-z0-9])\s+@\s+(?=[A-Za-z0-9-]+(?:\s*\.\s*[A-Za-z0-9-]+)*\s*\.\s*[A-Za-z]{2,}\b)"
_LABEL = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"


def _address(at: str, dot: str) -> str:
    """An address with at and at least one dot after it in words."""
    return rf"\s++(?:{at})\s++{_LABEL}(?:(?:\s+(?:{dot})\s+|{_DOT_MARK}){_LABEL})+"


# English prose has "at the point of", so there "point" is a dot only after an at of the language.
_TAIL = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:{_address('arroba|arobase', _DOT_WORDS)}|{_address('at', 'dot|punkt|punto')})", re.I)
# What stands before a tail, with its dots in words, read backwards from there: forwards, each of a row of such words would be tried.
_LOCAL_SAID = re.compile(r"[A-Za-z0-9._%+-]++(?:\s++(?:tod|tknup|otnup)\s++[A-Za-z0-9._%+-]++)*+(?![\w.%+-])", re.I)
_SPACED = rf"(?<=[A-Za-z0-9])\s+@\s+[A-Za-z0-9-]+(?:(?:\s+\.\s+|\.)[A-Za-z0-9-]+)*(?:\s+\.\s+|\.)[A-Za-z]{{2,}}\b"
_ADDRESS_PART = re.compile(rf"(?P<at>\s+(?:{_AT_WORDS})\s+|{_AT_MARK}|\s+@\s+)|(?P<dot>\s+(?:{_DOT_WORDS})\s+|{_DOT_MARK}|\s+\.\s+)", re.I)
_REWRITE = re.compile(rf"(?P<address>{_SPACED})|(?P<at>{_AT_MARK}|{_SPELLED_AT}|{_SPACED_AT})|(?P<run>{_RUN})|(?P<dot>{_DOT_MARK}|{_SPELLED_DOT})|(?P<zero>(?<=[0-9])[Oo](?=[0-9]))|(?P<one>(?<=[0-9])[lI](?=[0-9]))", re.I)
_SAYS = re.compile(r"[A-Za-z\[({<]")
_SAID = rf"{_WORD}|dash|hyphen|{'|'.join(_TIMES)}"
#: Without one of these no rewrite applies: a run without dots has two neighbours of which one is said, or plus before figures. Letters of western European languages are not among them.
_HINT = re.compile(rf"[\[({{<]\s*(?:{_AT_WORDS}|{_DOT_WORDS}|\.|@)\s*[\])}}>]|{_AT_ENTITY}|{_DOT_ENTITY}|\b(?:{_DOT_WORDS})\b|\s@\s|[0-9][OolI][0-9]|\bplus\s+[0-9]|\b(?:{_SAID})\b[\s,.-]+(?:(?:{_SAID})\b|[0-9])|[0-9][\s,.-]+(?:{_SAID})\b", re.I)
_ODD = re.compile(r"[^\x00-\x7f\xa1-\xac\xae-\xb1\xb4-\xb8\xba-ɏ‘-”…€]")


def addresses(text: str) -> list[tuple[int, int]]:
    """Addresses with at and dots in words, in order; none overlaps another."""
    out: list[tuple[int, int]] = []
    back = None
    for m in _TAIL.finditer(text):
        back = text[::-1] if back is None else back
        if (local := _LOCAL_SAID.match(back, len(text) - m.start())) and (start := len(text) - local.end()) >= (out[-1][1] if out else 0):
            out.append((start, m.end()))
    return out


def rewrites(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what is rewritten, in order; of two that overlap the first, of two that begin together an address."""
    at, m = 0, _REWRITE.search(text)
    waiting = iter(addresses(text))
    a = next(waiting, None)
    while m or a:
        if a and a[0] < at:
            a = next(waiting, None)
        elif m and m.start() < at:
            m = _REWRITE.search(text, at)
        elif a and (not m or a[0] <= m.start()):
            yield "address", *a
            at = a[1]
        else:
            yield m.lastgroup, *m.span()
            at = m.end()


def normalise(text: str) -> tuple[str, list[int], list[int]] | None:
    """The rewritten text and, for each of its characters, start and end in the source; None if nothing is rewritten."""
    starts: list[int] | range = range(len(text))
    ends: list[int] | range = range(1, len(text) + 1)
    flat = text
    if _ODD.search(text):
        mapped = [narrow(c) if c > "\x7f" else c for c in text]
        if any(a != b for a, b in zip(mapped, text, strict=True)):
            keep = [i for i, c in enumerate(mapped) if c]
            flat, starts, ends = "".join(mapped), keep, [i + 1 for i in keep]
    if not _HINT.search(flat):
        return None if flat == text else (flat, list(starts), list(ends))
    pieces, s, e, last = [], [], [], 0

    def put(chars: str, a: int, b: int) -> None:
        pieces.append(chars)
        s.extend([starts[a]] * len(chars))
        e.extend([ends[b - 1]] * len(chars))

    def keep_as_is(a: int, b: int) -> None:
        pieces.append(flat[a:b])
        s.extend(starts[a:b])
        e.extend(ends[a:b])

    for kind, first, stop in rewrites(flat):
        if kind == "run" and not _SAYS.search(flat, first, stop):
            continue
        keep_as_is(last, first)
        last = stop
        if kind == "address":
            at = first
            for p in _ADDRESS_PART.finditer(flat, first, stop):
                keep_as_is(at, p.start())
                put("@" if p.lastgroup == "at" else ".", p.start(), p.end())
                at = p.end()
            keep_as_is(at, stop)
        elif kind == "run":
            parts = list(_PART.finditer(flat, first, stop))
            parts = [p for p in parts if p.end() <= stop]
            solid = [p for p in parts if p.lastgroup != "other"]
            nxt = iter(solid[1:])
            before, after = None, solid[0] if solid else None
            for p in parts:
                if p.lastgroup == "other":
                    # A separator stays only between numbers in figures, and a + stays.
                    if p[0] == "+" or (before and after and before.lastgroup == after.lastgroup == "num"):
                        keep_as_is(p.start(), p.end())
                    continue
                before, after = p, next(nxt, None)
                if p.lastgroup == "num":
                    keep_as_is(p.start(), p.end())
                elif p.lastgroup == "times":
                    times, digit = p[0].lower().split()
                    put(_DIGIT_WORDS.get(digit, digit) * _TIMES[times], p.start(), p.end())
                else:
                    put({"dot": ".", "dash": "-", "plus": "+"}.get(p.lastgroup) or _DIGIT_WORDS[p[0].lower()], p.start(), p.end())
        else:
            put({"at": "@", "dot": ".", "zero": "0", "one": "1"}[kind], first, stop)
    keep_as_is(last, len(flat))
    out = "".join(pieces)
    return None if out == text else (out, s, e)


def added_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that only show after rewriting, in source positions."""
    if (n := normalise(text)) is None:
        return []
    flat, starts, ends = n
    known = {kind: [(a, b) for k, a, b in plain if k == kind] for kind in KINDS}  # of one kind none overlaps another
    out = set()
    for kind, a, b in plain_spans(flat):
        x, y = starts[a], ends[b - 1]
        at = bisect_right(known[kind], x, key=lambda p: p[0])
        if text[x:y] != flat[a:b] and not (at and y <= known[kind][at - 1][1]):
            out.add((kind, x, y))
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2])))


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span, overlapping ones taken together, replaced by its kind in angle brackets."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, plain and added: arrays of (kind, start, end) in code points of the source. One row per document."""

    def run(batches):
        for b in batches:
            plain = [plain_spans(t) for t in b["text"]]
            added = [added_spans(t, p) for t, p in zip(b["text"], plain, strict=True)]
            yield {"doc_id": b["doc_id"], **{n: [[{"kind": k, "start": a, "end": z} for k, a, z in s] for s in col] for n, col in (("plain", plain), ("added", added))}}

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    return arrow_map(pick(docs, "doc_id", "text"), run, f"doc_id bigint, plain {span}, added {span}")


def digest(found: DataFrame) -> DataFrame:
    """The columns that op1 returns: counts and hash of plain spans, all spans as text, and how many of them."""
    every = F.concat("plain", "added")
    return found.select("doc_id", *counts_of("plain", KINDS), F.sha2(spans_text(F.col("plain"), KINDS), 256).alias("base_sha256"), spans_text(every, KINDS).alias("spans"), F.size("added").cast("bigint").alias("n_added"), F.size(every).cast("bigint").alias("n_found"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind; a null text stays null. Other columns are kept as they are; n_chars, if there, is counted anew."""

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else redacted(t, (p := plain_spans(t)) + added_spans(t, p)) for t in batch.column("text").to_pylist()]
        return with_column(batch, "text", texts)

    out = batch_map(docs, clean)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
