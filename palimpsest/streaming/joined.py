"""Two streams joined in time: records and what followed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed(records: DataFrame, others: DataFrame, key: str, id: str, other_id: str, within: str, late: str = "1 hour") -> DataFrame:
    """records with each row of others of the same key at most `within` later (`other_at`, `<other_id>`), or with nulls once none can come any more.

    Both streams have `at` and a watermark of their own; the slower one counts. A record that arrives twice within the watermark
    counts once, by its id. State is bounded by the two watermarks and the time bound: a record is kept until `others` has passed the end of its time.
    """
    left = records.withWatermark("at", late).dropDuplicatesWithinWatermark([id])
    right = others.withWatermark("at", late).dropDuplicatesWithinWatermark([other_id]).select(F.col(key).alias("_key"), F.col("at").alias("other_at"), other_id)
    bound = F.expr(f"{key} = _key AND other_at >= at AND other_at <= at + INTERVAL {within}")
    return left.join(right, bound, "leftOuter").drop("_key")
