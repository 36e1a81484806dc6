"""Trees of unified diffs as tables, and back.

Layout: <root>/<id>_<project>/run_<yyyyMMdd_HHmmss>/patches/<project>/<Class>/<test>.diff.
Read once, store as Parquet by project and run, and query that: the files are tiny.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.batches import small_batches

KEY = ("project_id", "run_ts", "class_name", "test_name")
_PATH = r"/(\d+)_([^/]+)/run_(\d{8}_\d{6})/patches/[^/]+/([^/]+)/([^/]+)\.diff$"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
RUN_FORMAT = "yyyyMMdd_HHmmss"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """One row per patch file. The listing is an explicit glob, since a recursive one skips directories that start with _."""
    files = spark.read.text(f"{root}/*/*/patches/*/*/*.diff", wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    return with_keys(files)


def with_keys(files: DataFrame) -> DataFrame:
    """Keys from file_path and, for the source's path and package, from the patch's first line."""
    part = lambda k: F.regexp_extract(F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B"))), _PATH, k)
    source = F.regexp_extract("value", r"^--- a/([^\n]*)", 1)
    folders = F.regexp_extract(source, r"^[^/]+/(?:(.*)/)?[^/]+$", 1)
    return files.select(
        part(1).try_cast("int").alias("project_id"), part(2).alias("project"), F.try_to_timestamp(part(3), F.lit(RUN_FORMAT)).cast("timestamp_ntz").alias("run_ts"),
        part(4).alias("class_name"), part(5).alias("test_name"), F.regexp_extract(part(5), r"(\d+)$", 1).try_cast("int").alias("test_no"),
        source.alias("source_path"), F.replace(folders, F.lit("/"), F.lit(".")).alias("package"), F.col("value").alias("raw"),
    )


def run_stamp(ts: str | Column) -> Column:
    """A run's directory name from its start."""
    return F.concat(F.lit("run_"), F.date_format(ts, RUN_FORMAT))


class Hunk(NamedTuple):
    """Starts and lengths as declared, the header's line number, and lines (op, text, ended): not ended if no newline follows it."""

    old_start: int
    old_len: int
    new_start: int
    new_len: int
    at: int
    lines: list[tuple[str, str, bool]]


def parse_hunks(raw: str | None) -> Iterator[Hunk]:
    """The hunks of a patch.

    Lines are classed by place, inside the lengths that the hunk declares: a removed line may itself begin with a dash. Only \\n
    ends a line. A line that begins with a backslash says that the one before it has no end.
    A null patch, one whose lines do not fill its hunks, or that has others, raises ValueError.
    """
    if raw is None:
        raise ValueError("null")
    lines = raw.split("\n")
    if lines[-1] == "":
        lines.pop()
    if len(lines) < 2 or not lines[0].startswith("--- ") or not lines[1].startswith("+++ "):
        raise ValueError("no header")
    at, hunk = 2, 0
    while at < len(lines):
        m = _HUNK.match(lines[at])
        if not m:
            raise ValueError(f"line {at + 1} is in no hunk")
        sizes = [int(x) if x else 1 for x in m.groups()]
        hunk, at = hunk + 1, at + 1
        out = Hunk(*sizes, at, [])
        _, old_left, _, new_left = sizes
        while old_left or new_left or lines[at : at + 1] and lines[at][:1] == "\\":
            if at >= len(lines) or lines[at][:1] not in (" ", "-", "+", "\\"):
                raise ValueError(f"hunk {hunk} ends early")
            op, text = lines[at][0], lines[at][1:]
            if op == "\\":
                if not out.lines or not out.lines[-1][2]:
                    raise ValueError(f"line {at + 1} follows no line")
                out.lines[-1] = (*out.lines[-1][:2], False)
            else:
                out.lines.append((op, text, True))
                old_left, new_left = old_left - (op != "+"), new_left - (op != "-")
                if old_left < 0 or new_left < 0:
                    raise ValueError(f"hunk {hunk} has more lines than it declares")
            at += 1
        yield out


def parse_lines(raw: str | None) -> Iterator[tuple[int, int, str, int | None, int | None, str, bool]]:
    """(hunk, line, op, old number, new number, text, ended) of a patch; see parse_hunks."""
    for no, h in enumerate(parse_hunks(raw), 1):
        old, new, at = h.old_start, h.new_start, h.at
        for op, text, ended in h.lines:
            is_old, is_new = op != "+", op != "-"
            at += 1
            yield no, at, op, old if is_old else None, new if is_new else None, text, ended
            at += not ended  # the line that says so
            old, new = old + is_old, new + is_new


def fault(raw: str | Column) -> Column:
    """Why a patch cannot be parsed; null if it can. For an output of its own: patches.where(fault("raw").isNotNull())."""

    @F.pandas_udf("string")
    def run(raws: pd.Series) -> pd.Series:
        return pd.Series([_fault(r) for r in raws], dtype=object)

    small_batches(SparkSession.active())
    return run(raw)


def _fault(raw: str | None) -> str | None:
    try:
        for _ in parse_hunks(raw):
            pass
    except ValueError as e:
        return str(e)
    return None


def patch_lines(patches: DataFrame, strict: bool = True) -> DataFrame:
    """One row per line of every hunk: the keys, hunk_no, line_no, op, old_no, new_no, text, ended. Batches go through Python once, without
    a shuffle. A malformed or null patch stops the job; unless strict, it gives no lines (fault() tells which and why)."""
    keys = list(KEY)
    kinds = dict(patches.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            records = [r for r in b.to_dict("records") if strict or _fault(r["raw"]) is None]
            rows = [(*(r[k] for k in keys), *line) for r in records for line in parse_lines(r["raw"])]
            out = pd.DataFrame(rows, columns=[*keys, "hunk_no", "line_no", "op", "old_no", "new_no", "text", "ended"])
            yield out.astype({"old_no": "Int32", "new_no": "Int32"})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", hunk_no int, line_no int, op string, old_no int, new_no int, text string, ended boolean"
    small_batches(patches.sparkSession)
    return patches.select(*keys, "raw").mapInPandas(run, schema)


def hunks(patches: DataFrame) -> DataFrame:
    """The keys with hunk_no, old_start, old_len, new_start, new_len, without Python."""
    found = F.regexp_extract_all("raw", F.lit(r"(?m)^(@@ -\d+,\d+ \+\d+,\d+ @@)"))
    part = lambda k: F.regexp_extract("h", r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@", k).cast("int")
    rows = patches.select(*KEY, F.posexplode(found).alias("hunk_no", "h"))
    return rows.select(*KEY, (F.col("hunk_no") + 1).alias("hunk_no"), *(part(i + 1).alias(n) for i, n in enumerate(("old_start", "old_len", "new_start", "new_len"))))


def sides(lines: DataFrame) -> DataFrame:
    """The keys with the texts before and after, context included, and the changed lines alone."""
    joined = lambda keep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line_no", "op", "text"))), keep), lambda x: x["text"]), "\n")
    return lines.groupBy(*KEY).agg(
        joined(lambda x: x["op"] != "+").alias("before"), joined(lambda x: x["op"] != "-").alias("after"),
        joined(lambda x: x["op"] == "-").alias("removed"), joined(lambda x: x["op"] == "+").alias("added"),
        *(F.count(F.when(F.col("op") == o, 1)).alias(n) for o, n in (("+", "n_added"), ("-", "n_removed"), (" ", "n_context"))),
    )


def write_files(files: DataFrame) -> None:
    """Each row's raw as a file at its path, written by tasks through the file system that Spark's paths name; parents are created.
    A task that runs again writes the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from palimpsest.sources.patch_source import file_system

        n = 0
        for b in batches:
            for path, raw in zip(b["path"], b["raw"], strict=True):
                fs, local = file_system(path)
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(local) as f:
                    f.write(raw.encode())
                n += 1
        yield pd.DataFrame({"files": [n]})

    small_batches(files.sparkSession)
    files.select("path", "raw").mapInPandas(run, "files bigint").agg(F.sum("files")).collect()


def write_tree(patches: DataFrame, path: str) -> None:
    """Patches by project and run; many to a file, unlike the tree that they may come from. A large run is split over tasks by its size, small ones share one."""
    named = patches.withColumn("run", run_stamp("run_ts"))
    named.hint("rebalance", "project", "run").write.mode("overwrite").partitionBy("project", "run").parquet(path)
