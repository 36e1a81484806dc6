"""Joins on time: the row in force (as-of) and the intervals around a moment.

Neither needs a task to hold a key. The as-of join sorts both sides by key and time into ranges, so that a key of
a third of all rows lies in many of them; within a range the last right row is carried forward, and what a range
inherits from the ones before it comes from a few border rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.shipping import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its rows, and what partition they were in, stay the same from here on."""
    path = f"{shared_folder(df.sparkSession)}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tie: str | None = None, strict: bool = False, ranges: int | None = None) -> DataFrame:
    """left with `found`, the struct of the last row of right that has the same `by` and a time not after left's (before it, if strict);
    null if there is none. Every left row comes back once.

    Of right rows of equal time the one with the largest `tie`, a column of right, is last. Null keys and null times find nothing and are
    not found. Time columns must have one type on both sides.
    """
    spark = left.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*by)
    known = lambda t: sum((F.col(c).isNull().cast("int") for c in (*by, t)), F.lit(0)) == 0
    mine = left.select(key.alias("_key"), F.col(left_time).alias("_at"), F.lit(0 if strict else 2).alias("_side"), F.lit(None).alias("_tie"), F.struct("*").alias("_left"), F.lit(None).alias("_right"), known(left_time).alias("_known"))
    there = right.where(known(right_time)).select(key.alias("_key"), F.col(right_time).alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie") if tie else F.lit(None).alias("_tie"), F.lit(None).alias("_left"), F.struct("*").alias("_right"), F.lit(True).alias("_known"))
    order = ["_key", "_at", "_side", "_tie"]
    rows = mine.unionByName(there).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    rows = stored(rows, "as-of")
    # Within a range: no group is larger than the range.
    w = Window.partitionBy("_part", "_key").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last("_right", ignorenulls=True).over(w))
    # Of each range: its first and last key, and the last right row of the latter. One row a range.
    place = F.struct("_key", "_at", "_side", "_tie")
    last = F.max(F.when(F.col("_side") == 1, F.struct("_key", "_at", "_tie", "_right")))
    ends = rows.groupBy("_part").agg(F.min(place)["_key"].alias("first_key"), F.max(place)["_key"].alias("last_key"), last.alias("last"))
    ends = ends.select("_part", "first_key", "last_key", F.when(F.col("last._key") == F.col("last_key"), F.col("last._right")).alias("last"))
    before = Window.partitionBy("last_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(before))
    # The ranges that end with the key with which another begins; the last of them hands on. Ranges are few, their number is a setting.
    heirs = ends.select(F.col("_part").alias("to"), "first_key")
    handed = heirs.join(carried.select("_part", "last_key", "carried"), (F.col("last_key") == F.col("first_key")) & (F.col("_part") < F.col("to")))
    handed = handed.groupBy("to", "first_key").agg(F.max_by("carried", "_part").alias("carried"))
    handed = handed.select(F.col("to").alias("_part"), F.col("first_key").alias("_key"), "carried")
    out = rows.where("_side <> 1").join(F.broadcast(handed), ["_part", "_key"], "left")
    return out.select("_left.*", F.when(F.col("_known"), F.coalesce("_last", "carried")).alias("found"))


def within(points: DataFrame, intervals: DataFrame, by: list[str], time: str, start: str, end: str) -> DataFrame:
    """points joined with the intervals that hold them, start included and end not: points' columns, `found` the interval's struct.

    `time`, `start` and `end` are whole numbers. An interval lies in one or two cells of the smallest width, a power of two, that is not less
    than its length, so long intervals are not taken apart; a point looks into one cell of each width that occurs, 64 at most.
    Empty intervals and null bounds, keys or times give no rows.
    """
    width = F.col("_end") - F.col("_start")
    level = F.when(width <= 1, 0).otherwise(F.ceil(F.log2(width.cast("double"))).cast("int"))
    # log2 of a double may be off by one at the ends of long intervals; a level too low would leave out cells.
    level = level + F.when(F.call_function("shiftleft", F.lit(1).cast("bigint"), level) < width, 1).otherwise(0)
    spans = intervals.select(*by, F.struct("*").alias("found"), F.col(start).cast("bigint").alias("_start"), F.col(end).cast("bigint").alias("_end")).where("_end > _start")
    spans = spans.withColumn("_level", level)
    cell = lambda t: F.call_function("shiftright", t, F.col("_level"))
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end") - 1))))
    levels = F.broadcast(spans.select("_level").distinct())  # 64 rows at most
    looking = points.select(F.struct("*").alias("_point"), *by, F.col(time).cast("bigint").alias("_at")).join(levels, F.col("_at").isNotNull()).withColumn("_cell", cell(F.col("_at")))
    joined = looking.join(spans, [*by, "_level", "_cell"]).where((F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_end")))
    return joined.select("_point.*", "found")
