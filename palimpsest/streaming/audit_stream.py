"""The audit log as a stream: new files are read as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.sources.audit import parsed


def read_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return parsed(spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").text(path))


def windowed_counts(records: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per window and kind; a window closes once the watermark has passed it."""
    timed = records.withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event").agg(F.count("*").alias("n"))


def sessions(records: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with no pause over gap."""
    timed = records.withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint"))).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), key).agg(F.count("*").alias("n"))


def running_totals(records: DataFrame, key: str) -> DataFrame:
    """Per key the number of records so far and the last event, kept as state; of events at one time the last by name, whatever came first."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last_ts, last = state.get if state.exists else (0, float("-inf"), "")
        for b in batches:
            n += len(b)
            known = b[b["ts"].notna() & b["event"].notna()]
            last_ts, last = max([(last_ts, last), *zip(known["ts"].astype(float), known["event"], strict=True)])
        state.update((n, last_ts, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last_event": [last]})

    return records.groupBy(key).applyInPandasWithState(update, f"{key} string, n bigint, last_event string", "n bigint, ts double, event string", "update", GroupStateTimeout.NoTimeout)
