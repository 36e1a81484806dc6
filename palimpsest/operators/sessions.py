"""Sessions of a key without a task for a key: rows are sorted by key and time into ranges, sessions are found within each, and only those
that touch a range's border are put together, two rows a range at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.asof import stored


def _numbered(rows: DataFrame, by: list[str], start: str, end: str, order: list[str], gap: Column) -> DataFrame:
    """rows with `session`, a number within each group of `by` that rises where the pause since the latest end before is at least gap."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col(start) - before < gap, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def sessions(rows: DataFrame, key: str, time: str, gap: int, ranges: int | None = None) -> DataFrame:
    """key, first, last, n of each session: rows of a key with pauses under gap, in units of `time`, a whole number. A null key is a key of its
    own; rows without a time are left out."""
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.where(F.col(time).isNotNull()).select(key, F.col(time).cast("bigint").alias("first")).withColumn("last", F.col("first"))
    # Rows of one key and moment that a range would not split are one session anyway, so they are summed up first.
    cut = cut.groupBy(key, "first", "last").agg(F.count("*").alias("n"))
    cut = stored(cut.repartitionByRange(n, key, "first").withColumn("part", F.spark_partition_id()), "sessions")
    sums = (F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    found = _numbered(cut, ["part", key], "first", "last", ["first"], F.lit(gap)).groupBy("part", key, "session").agg(*sums)
    place = F.struct(key, "first")
    ends = cut.groupBy("part").agg(F.min(place).alias("low"), F.max(F.struct(key, "last")).alias("high"))
    found = stored(found.join(F.broadcast(ends), "part").withColumn("border", (place == F.col("low")) | (F.struct(key, "last") == F.col("high"))).drop("low", "high"), "sessions")
    border = _numbered(found.where("border").drop("session"), [key], "first", "last", ["first"], F.lit(gap)).groupBy(key, "session").agg(*sums)
    return found.where("not border").select(key, "first", "last", "n").unionByName(border.select(key, "first", "last", "n"))
