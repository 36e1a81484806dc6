"""Audit records as JSON lines: {ts, event, any further fields}.

Records keep null fields and non-ASCII characters as they are. Appends are atomic a
job at a time, and every task writes a file of its own, so writers need no lock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields that are kept in the log but not shown.
HIDDEN_FIELDS = ("prompt", "completion", "diff", "java_source")


def now() -> Column:
    """Seconds since 1970 as a double, one value for a whole query; pass `ts` as data where each record has its own."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def records(rows: DataFrame, event: str | Column, *fields: str) -> DataFrame:
    """ts, event, then the named fields of rows; a field called ts takes the stamp's place. A field called event is refused."""
    if "event" in fields:
        raise TypeError("'event' is given twice")
    stamp = F.col("ts") if "ts" in fields else now()
    return rows.select(stamp.cast("double").alias("ts"), (F.lit(event) if isinstance(event, str) else event).alias("event"), *(f for f in fields if f != "ts"))


def as_lines(recs: DataFrame) -> DataFrame:
    return recs.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def append(recs: DataFrame, path: str) -> None:
    """Appends recs to the log at path, which need not exist."""
    as_lines(recs).write.mode("append").text(path)


def append_batch(recs: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Appends a numbered batch to the log at path exactly once; False if it is there already, then nothing changes.

    The lines are written beside the log and then take their place under writer and batch by one rename: rows and number appear
    together or not at all. A batch that a restarted stream runs again finds its place taken. Numbers are a writer's own.
    """
    from palimpsest.sources.storage import exists, move_new, remove

    target = f"{path}/writer={writer}/batch={batch}"
    if exists(recs.sparkSession, target):
        return False
    fresh = f"{path}/_{uuid.uuid4().hex}"  # readers pass over names that begin with _
    as_lines(recs).write.text(fresh)
    placed = move_new(recs.sparkSession, fresh, target)
    if not placed:  # another run of the same batch was faster
        remove(recs.sparkSession, fresh)
    return placed


def terse(recs: DataFrame) -> DataFrame:
    """recs as shown on a console: without the hidden fields, at the top level only."""
    return recs.drop(*HIDDEN_FIELDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """ts, event and, whatever the record holds, `extras`, of appended records and batches; no inference over the log."""
    return parsed(spark.read.option("recursiveFileLookup", "true").text(path))


def parsed(lines: DataFrame) -> DataFrame:
    record = F.try_parse_json("value")
    return lines.select(F.try_variant_get(record, "$.ts", "double").alias("ts"), F.try_variant_get(record, "$.event", "string").alias("event"), record.alias("extras"))


def field(name: str, kind: str) -> Column:
    """A field of `extras`, null where it is missing or of another type."""
    return F.try_variant_get("extras", f"$.{name}", kind)
