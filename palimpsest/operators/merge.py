"""Three-way merge of two edits of one text: what only one side changed is taken, what both changed differently is a conflict.

Both edits are aligned with the base by the line diff. Changes that overlap or touch in the base, so that no line between them is
the same in all three, are one chunk.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.batches import small_batches
from palimpsest.operators.linediff import changes, lines_of

LEFT, BASE, MIDDLE, RIGHT = "<<<<<<< left\n", "||||||| base\n", "=======\n", ">>>>>>> right\n"


class Chunk(NamedTuple):
    """A stretch of the base (start, end) that a side changed, and each side's lines for it."""

    start: int
    end: int
    base: list[str]
    left: list[str]
    right: list[str]

    def settled(self) -> list[str] | None:
        """The lines to take; None for a conflict."""
        if self.left == self.right or self.right == self.base:
            return self.left
        return self.right if self.left == self.base else None


def chunks(base: list[str], left: list[str], right: list[str]) -> list[Chunk]:
    """Changed stretches of the base, ascending; at least one unchanged line is between two of them."""
    edits = sorted([(i, i2, i2 - i, j2 - j, 0) for i, i2, j, j2 in changes(base, left)] + [(i, i2, i2 - i, j2 - j, 1) for i, i2, j, j2 in changes(base, right)])
    out: list[Chunk] = []
    shift = [0, 0]  # by how much each side is ahead of the base
    at = 0
    while at < len(edits):
        start, end, before = edits[at][0], edits[at][1], list(shift)
        while at < len(edits) and edits[at][0] <= end:
            _, stop, old, new, side = edits[at]
            end = max(end, stop)
            shift[side] += new - old
            at += 1
        out.append(Chunk(start, end, base[start:end], left[start + before[0] : end + shift[0]], right[start + before[1] : end + shift[1]]))
    return out


def merge3(base: str, left: str, right: str) -> tuple[str, list[tuple[int, str, str, str]]]:
    """The merged text, conflicts between marks, and the conflicts: line of the base (from 1), and the three sides' text."""
    b, out, conflicts, at = lines_of(base), [], [], 0
    for c in chunks(b, lines_of(left), lines_of(right)):
        out += b[at : c.start]
        at = c.end
        if (lines := c.settled()) is None:
            sides = ["".join(x) for x in (c.base, c.left, c.right)]
            conflicts.append((c.start + 1, *sides))
            whole = [x if not x or x.endswith("\n") else x + "\n" for x in sides]
            lines = [LEFT, whole[1], BASE, whole[0], MIDDLE, whole[2], RIGHT]
        out += lines
    return "".join([*out, *b[at:]]), conflicts


_MERGED = "text string, conflicts array<struct<line: int, base: string, left: string, right: string>>"


def merged(base: str | Column, left: str | Column, right: str | Column) -> Column:
    """(text, conflicts) of three texts; null if any of them is."""

    @F.pandas_udf(_MERGED)
    def run(b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [merge3(*t) if all(isinstance(s, str) for s in t) else (None, None) for t in zip(b, x, y, strict=True)]
        return pd.DataFrame({"text": [r[0] for r in rows], "conflicts": [r[1] and [dict(zip(("line", "base", "left", "right"), c, strict=True)) for c in r[1]] if r[1] is not None else None for r in rows]})

    small_batches(SparkSession.active())
    return run(base, left, right)


def conflict_rows(rows: DataFrame, merged: str, *keys: str) -> DataFrame:
    """A row per conflict of a column that merged() made: the keys, line, base, left, right."""
    return rows.select(*keys, F.inline(f"{merged}.conflicts"))
