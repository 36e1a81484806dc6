"""Edit patterns of repaired tests as columns: counts per side and what changed between the sides.

Counts are of surface text, strings and comments included.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each pattern counts.
PATTERNS = {
    "asserts": r"\bassert\w+\s*\(",
    "try_blocks": r"\btry\s*\{",
    "expected": r"@Test\s*\([^)]*expected",
    "timeouts": r"@Test\s*\([^)]*timeout",
    "verify_exception": r"\bverifyException\s*\(",
    "fails": r"\bfail\s*\(",
    "undeclared_notes": r"// Undeclared exception!",
    "unstable_notes": r"Unstable assertion",
    "literal_first": r"\bassertEquals\s*\(\s*-?[0-9]",
    "instance_of": r"\binstanceof\b",
    "for_loops": r"\bfor\s*\(",
    "finally_blocks": r"\bfinally\s*\{",
    "reflection": r"\bsetAccessible\s*\(|\bgetDeclared(?:Field|Method)\s*\(",
    "throws_exception": r"\bthrows Exception\b",
    "non_ascii": r"[^\x00-\x7F]",
    "state_calls": r"\.\s*(?:set|add|put|remove|push|append|insert|clear)\w*\s*\(",
}
#: A value in a test's text: a number or a string.
LITERAL = r"-?\b[0-9]+(?:\.[0-9]+)?\b|\"[^\"\n]*\""
#: Both values of a two-sided assertion, where neither has a call or a comma of its own.
TWO_SIDED = r"\bassert(?:Equals|Same)\s*\(\s*([^,()\n]+)\s*,\s*([^,()\n]+)\)"
# Kinds of assertion.
ASSERTIONS = ("NotNull", "Equals", "True", "False", "Null", "Same", "NotEquals", "NotSame", "ArrayEquals", "Throws")


def count_of(text: str | Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(pattern)).cast("bigint")


def self_comparing(text: Column) -> Column:
    """Assertions whose two sides are the same text."""
    sides = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TWO_SIDED), F.lit(i)), lambda x: F.trim(x)) for i in (1, 2)]
    return F.size(F.filter(F.zip_with(*sides, lambda a, b: a == b), lambda same: same)).cast("bigint")


#: Patterns that are counted in one scan of a text, since no match of one can overlap a match of another, and how a match of each begins.
_BEGINS = {
    "try_blocks": ("try",), "verify_exception": ("verifyException",), "fails": ("fail",), "undeclared_notes": ("//",), "unstable_notes": ("Unstable",), "instance_of": ("instanceof",),
    "for_loops": ("for",), "finally_blocks": ("finally",), "reflection": ("setAccessible", "getDeclared"), "throws_exception": ("throws",),
}
#: Every call of an assertion, with the number that its first argument begins with.
_CALLS = r"\bassert\w+\s*\((?:\s*-?[0-9])?"


def counts(rows: DataFrame, before: str, after: str) -> DataFrame:
    """rows with <pattern>_before and <pattern>_after for every pattern and kind of assertion.

    A text is scanned once for all assertions and once for the patterns of _BEGINS; what is found there is told apart by how it
    begins. The other patterns may overlap those and have scans of their own, left out where a word that they need is missing.
    """
    c = F.col
    n = lambda matches, test: F.size(F.filter(matches, test)).cast("bigint")
    begins = lambda words: lambda x: reduce(operator.or_, (F.startswith(x, F.lit(w)) for w in words))
    equals = lambda kind: lambda x: x == kind
    for side, column in (("before", before), ("after", after)):
        text = F.coalesce(c(column), F.lit(""))
        found = lambda pattern, text=text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        rows = rows.withColumns({"_calls": found(_CALLS), "_words": found("|".join(PATTERNS[k] for k in _BEGINS))})
        rows = rows.withColumn("_kinds", F.transform("_calls", lambda x: F.regexp_extract(x, r"^assert(\w+)", 1)))
        lacking = {"expected": ~F.contains(text, F.lit("expected")), "timeouts": ~F.contains(text, F.lit("timeout")), "non_ascii": F.octet_length(text) == F.char_length(text)}
        out = {"asserts": F.size("_calls").cast("bigint"), "literal_first": n("_calls", lambda x: F.startswith(x, F.lit("assertEquals")) & F.rlike(x, F.lit("^" + PATTERNS["literal_first"])))}
        out |= {k: n("_words", begins(b)) for k, b in _BEGINS.items()}
        out |= {k: F.when(lacking.get(k, F.lit(False)), F.lit(0).cast("bigint")).otherwise(count_of(text, p)) for k, p in PATTERNS.items() if k not in out}
        out |= {f"assert_{a.lower()}": n("_kinds", equals(a)) for a in ASSERTIONS}
        rows = rows.withColumns({f"{k}_{side}": out[k] for k in (*PATTERNS, *(x for x in out if x not in PATTERNS))}).drop("_calls", "_words", "_kinds")
    return rows


def flags(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """rows, with counts, and what happened to each method."""
    c = F.col
    got, lost = lambda n: (c(f"{n}_before") == 0) & (c(f"{n}_after") > 0), lambda n: (c(f"{n}_before") > 0) & (c(f"{n}_after") == 0)
    blank = lambda x: F.regexp_replace(x, r"\s+", "")
    literals = lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(LITERAL), F.lit(0))
    timeout = lambda x: F.regexp_extract(x, r"timeout\s*=\s*([0-9]+)", 1)
    return rows.withColumns({
        "try_to_expected": lost("try_blocks") & got("expected"),
        "try_lost": lost("try_blocks") & (c("expected_after") == 0),
        "value_test": lost("try_blocks") & (c("expected_after") == 0) & (c("asserts_after") > 0) & (F.size(F.array_except(literals(c(after)), literals(c(before)))) > 0),
        "try_kept": (c("try_blocks_before") > 0) & (c("try_blocks_after") > 0),
        "try_gained": got("try_blocks"),
        "more_asserts": c("asserts_after") > c("asserts_before"),
        "fewer_asserts": c("asserts_after") < c("asserts_before"),
        "same_asserts": c("asserts_after") == c("asserts_before"),
        "assert_free_fixed": got("asserts"),
        "assert_free_gained": lost("asserts"),
        "unchecked_after": (c("asserts_after") == 0) & (c("expected_after") == 0) & (c("fails_after") == 0),
        "whitespace_only": (c(before) != c(after)) & (blank(c(before)) == blank(c(after))),
        "state_before_assert": (c("state_calls_after") > c("state_calls_before")) & F.coalesce(F.rlike(c(after), F.lit(rf"(?s){PATTERNS['state_calls']}.*\bassert\w+\s*\(")), F.lit(False)),
        "throws_narrowed": got("throws_exception"),
        "self_comparing": self_comparing(c(after)) > 0,
        "timeout_dropped": lost("timeouts"),
        "timeout_changed": (c("timeouts_before") > 0) & (c("timeouts_after") > 0) & (timeout(c(before)) != timeout(c(after))),
        "expected_type": F.nullif(F.regexp_extract(c(after), r"@Test\s*\([^)]*expected\s*=\s*([\w.]+)\.class", 1), F.lit("")),
        "net_lines": (F.size(F.split(after, "\n")) - F.size(F.split(before, "\n"))).cast("bigint"),
    })


def rollup(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of every count and flag per group, subtotals and total included."""
    names = [n for n, k in rows.dtypes if k == "bigint" and n.endswith(("_before", "_after"))]
    marks = [n for n, k in rows.dtypes if k == "boolean"]
    return rows.rollup(*by).agg(F.count("*").alias("methods"), *(F.sum(n).alias(n) for n in names), *(F.count_if(n).alias(n) for n in marks))
