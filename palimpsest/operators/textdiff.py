"""Line diffs of two texts, their application, and replacement of a method in a source text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.batches import small_batches
from palimpsest.operators.linediff import changes, lines_of
from palimpsest.sources.patches import parse_hunks

CONTEXT = 3


def unified(before: str, after: str, path: str) -> str:
    """A unified diff with three lines of context; empty if nothing changes. A last line without an end is marked as such."""
    a, b = lines_of(before), lines_of(after)
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in changes(a, b):
        if groups and c[0] - groups[-1][-1][1] <= 2 * CONTEXT:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = [f"--- a/{path}\n+++ b/{path}\n"] if groups else []
    for group in groups:
        low, high = max(0, group[0][0] - CONTEXT), min(len(a), group[-1][1] + CONTEXT)
        left, right = group[0][2] - (group[0][0] - low), group[-1][3] + high - group[-1][1]
        # The start of no lines is the line before them.
        out.append(f"@@ -{low + (high > low)},{high - low} +{left + (right > left)},{right - left} @@\n")
        at = low
        for i, i2, j, j2 in group:
            out += [*_marked(" ", a[at:i]), *_marked("-", a[i:i2]), *_marked("+", b[j:j2])]
            at = i2
        out += _marked(" ", a[at:high])
    return "".join(out)


def _marked(op: str, lines: list[str]) -> list[str]:
    return [op + x if x.endswith("\n") else f"{op}{x}\n\\ No newline at end of file\n" for x in lines]


def applied(before: str, patch: str) -> str:
    """before with a patch applied; ValueError where the patch does not fit."""
    if not patch:
        return before
    lines, out, at = lines_of(before), [], 0
    for h in parse_hunks(patch):
        start = h.old_start - 1 if h.old_len else h.old_start
        if not at <= start <= len(lines):
            raise ValueError(f"line {start + 1} is not there, or was passed before")
        out += lines[at:start]
        at = start
        for op, text, ended in h.lines:
            line = text + "\n" if ended else text
            if op != "+":
                if at >= len(lines) or lines[at] != line:
                    raise ValueError(f"line {at + 1} differs")
                at += 1
            if op != "-":
                out.append(line)
    out += lines[at:]
    if any(not x.endswith("\n") for x in out[:-1]):
        raise ValueError("a line within the text has no end")
    return "".join(out)


def fitted(text: str | None, patch: str | None) -> str | None:
    """text with the patch applied; None if it does not fit, or either is missing."""
    try:
        return None if text is None or patch is None else applied(text, patch)
    except ValueError:
        return None


def diff(before: str | Column, after: str | Column, path: str | Column) -> Column:
    @F.pandas_udf(StringType())
    def run(b: pd.Series, a: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([unified(x or "", y or "", q or "") for x, y, q in zip(b, a, p, strict=True)], dtype=object)

    small_batches(SparkSession.active())
    return run(before, after, path)


def line_multiset_diff(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """Rows of left beyond those of right, counted; an order-free diff without Python."""
    return left.select(*columns).exceptAll(right.select(*columns))


#: What braces and semicolons do not count in (text blocks, strings, characters, comments), and they themselves.
_TOKEN = re.compile(r'"""(?:\\[\s\S]|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*[\s\S]*?\*/|[{};]')


def method_slice(source: str, name: str) -> tuple[int, int] | None:
    """Start and end of a void method with its annotations, or of its declaration if it has no body. Braces are matched, and the
    method is sought, outside text blocks, strings, characters and comments."""
    head = re.compile(rf"(?:^[ \t]*@\w+(?:\([^)\n]*\))?[ \t]*\n)*^[^\n;{{}}]*\bvoid\s+{re.escape(name)}\s*\(", re.M)
    tokens = [(t.start(), t.end(), t[0]) for t in _TOKEN.finditer(source)]
    starts = [t[0] for t in tokens]
    for m in head.finditer(source):
        i = bisect_right(starts, m.end() - 1)
        if i and tokens[i - 1][1] >= m.end():
            continue  # within a comment or a string
        depth = 0
        for _, end, what in tokens[i:]:
            if what == ";" and depth == 0:
                return m.start(), end
            depth += {"{": 1, "}": -1}.get(what, 0)
            if what == "}" and depth <= 0:
                return (m.start(), end) if depth == 0 else None
        return None
    return None


def replaced_method(source: str, name: str, method: str) -> str | None:
    """source with the method replaced by another, whose own outer white space is trimmed, followed by a blank line; None if it is not there."""
    found = method_slice(source, name)
    return None if found is None else source[: found[0]] + method.strip() + "\n" + source[found[1] :]


def replace_method(source: str | Column, name: str | Column, method: str | Column) -> Column:
    """replaced_method as a column; null where the method is not there."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or z is None else replaced_method(x, y, z) for x, y, z in zip(s, n, m, strict=True)], dtype=object)

    small_batches(SparkSession.active())
    return run(source, name, method)


def fold_patches(sources: DataFrame, patches: DataFrame, *key: str) -> DataFrame:
    """Sources (key, text) after their patches (key, seq, raw), applied in the order of seq: key, text, applied, rejected.

    The order comes from the data. A patch that does not fit, or is null, is rejected and the rest goes on; so are all patches of a
    key without a source or with a null one, whose text stays null. A key's text is the only state kept.
    """
    kinds = dict(sources.dtypes)
    n = len(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, text, done, refused = None, None, 0, 0
        out: list[tuple] = []
        for b in batches:
            for row in b.itertuples(index=False, name=None):
                k, source, first, raw = row[:n], row[n], row[n + 1], row[n + 3]
                if k != now:
                    if now is not None:
                        out.append((*now, text, done, refused))
                    now, text, done, refused = k, None, 0, 0
                if source:
                    text = first
                elif (new := fitted(text, raw)) is None:
                    refused += 1
                else:
                    text, done = new, done + 1
            yield pd.DataFrame(out, columns=names)
            out = []
        if now is not None:
            yield pd.DataFrame([(*now, text, done, refused)], columns=names)

    small_batches(sources.sparkSession)
    names = [*key, "text", "applied", "rejected"]
    none = F.lit(None)
    both = sources.select(*key, F.lit(True).alias("_source"), "text", none.cast("bigint").alias("seq"), none.cast("string").alias("raw"))
    both = both.unionByName(patches.select(*key, F.lit(False).alias("_source"), none.cast("string").alias("text"), F.col("seq").cast("bigint"), "raw"))
    # Sorted runs of a key stream through one pass; no group is built in memory.
    ordered = both.repartition(*key).sortWithinPartitions(*key, F.desc("_source"), F.col("seq").asc_nulls_first(), "raw")
    return ordered.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", text string, applied bigint, rejected bigint")
