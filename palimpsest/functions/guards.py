"""Text guards as Column expressions: a required method is present, a forbidden marker is absent.

The expressions stay inside generated code and need no shuffle. Null text counts as
empty text: no method is present in it, and no marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers that must not occur, in the order in which they are reported.
DISALLOWED_MARKERS = ["@Ignore", "org.junit.Ignore"]
# Messages of failed guards.
METHOD_MESSAGE = "Test method disappeared: "
MARKER_MESSAGE = "Disallowed marker found: "


def _text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def escaped(name: Column) -> Column:
    """name as a pattern that matches it literally."""
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def method_present(text: str | Column, name: str | Column, returns: str = "void") -> Column:
    """Whether text declares `name` with the return type, anywhere, comments included.

    `name` is a string, then the pattern is compiled once a task, or a Column, then once for each change of value.
    """
    if isinstance(name, str):
        name = F.lit(name)
    return F.regexp_like(_text(text), F.concat(F.lit(rf"(?U)\b{returns}\s+"), escaped(name), F.lit(r"\s*\(")))


def first_marker(text: str | Column, markers: list[str] | None = None) -> Column:
    """The first of markers, in list order, that text contains; null if none."""
    found = F.lit(None).cast("string")
    for m in reversed(DISALLOWED_MARKERS if markers is None else markers):
        found = F.when(F.contains(_text(text), F.lit(m)), F.lit(m)).otherwise(found)
    return found


def guard(rows: DataFrame, text: str, name: str, markers: list[str] | None = None) -> DataFrame:
    """rows with method_present, first_marker, ok and message (null if ok); the method is checked first."""
    checked = rows.withColumns({"method_present": method_present(text, F.coalesce(F.col(name), F.lit(""))), "first_marker": first_marker(text, markers)})
    message = F.when(~F.col("method_present"), F.concat(F.lit(METHOD_MESSAGE), F.col(name))).when(F.col("first_marker").isNotNull(), F.concat(F.lit(MARKER_MESSAGE), F.col("first_marker")))
    return checked.withColumns({"message": message, "ok": F.col("method_present") & F.col("first_marker").isNull()})


def enforced(rows: DataFrame, text: str, name: str, markers: list[str] | None = None) -> DataFrame:
    """rows unchanged; running it fails with the guard's message at the first row that breaks a guard."""
    checked = guard(rows, text, name, markers)
    passed = F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.col("message")).cast("boolean"))
    return checked.where(passed).select(*rows.columns)
