"""Patches as a table function: SELECT * FROM patch_lines(TABLE(patches) PARTITION BY class_name ORDER BY run_ts)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from palimpsest.sources.patches import parse_lines

_LINE = (("hunk_no", IntegerType()), ("line_no", IntegerType()), ("op", StringType()), ("old_no", IntegerType()), ("new_no", IntegerType()), ("text", StringType()), ("ended", BooleanType()))


@udtf
class PatchLines:
    """Every line of every patch: the table's columns but `raw`, which holds the patch, then those of patches.patch_lines. A
    table without a string column raw is refused when the query is analysed; a malformed patch stops the job."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "raw" not in rows.dataType.fieldNames() or not isinstance(rows.dataType["raw"].dataType, StringType):
            raise ValueError("patch_lines takes a table with a string column raw")
        schema = StructType()
        for f in rows.dataType.fields:
            if f.name != "raw":
                schema = schema.add(f.name, f.dataType)
        for name, kind in _LINE:
            schema = schema.add(name, kind)
        return AnalyzeResult(schema)

    def eval(self, row: Row) -> Iterator[tuple]:
        kept = tuple(v for k, v in row.asDict().items() if k != "raw")
        for line in parse_lines(row["raw"]):
            yield (*kept, *line)


def register(spark: SparkSession) -> None:
    spark.udtf.register("patch_lines", PatchLines)
