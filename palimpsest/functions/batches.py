"""How much Python is handed at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch at most; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by both, so that what a worker holds does not grow with the rows of its task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
