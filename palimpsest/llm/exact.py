"""Exact deduplication against a persistent index of digests.

The index is a Parquet table of (digest, keep_id, batch), bucketed and sorted by digest. New rows are reduced to one
entry per digest, dealt to the same buckets, anti-joined with the index by a sort-merge join, for which the index
is neither exchanged nor (once compacted) sorted, and what is left is appended. Texts never meet: a row is its 32 bytes of
digest, taken of the UTF-8 text with A-Z lower-cased and nothing else changed.

Of equal texts in one batch the row with the largest doc_id stays; a text that an earlier batch has stays with that batch's row.
A batch has a name. Adding it again appends nothing and gives the same rows, so a job that was lost half-way is simply
run again.

Defined cases: null text is read as empty, and empty texts are equal to each other; a null doc_id is the smallest; of rows equal in
doc_id and text one stays; texts are read whole; an empty table adds nothing; other columns pass through `fresh_rows` and are
otherwise ignored.

A text that a third of all rows repeat is summed up before anything is exchanged, and rows learn what became of their
text through hot_join, which broadcasts the few frequent digests and exchanges no row of them.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import _SCRATCH, _file_system, arrow_map, hot_join, pick, shared_dir, written

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode().translate(_LOWER)).digest()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digest of each row."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "digest": [digest(t) for t in b["text"]]}

    return arrow_map(pick(docs, "doc_id", "text"), run, "doc_id bigint, digest binary")


def numbered(keyed: DataFrame) -> DataFrame:
    """digests() as a table in the shared folder, with a number for each row that stays the same however often it is read."""
    return written(keyed.withColumn("row", F.monotonically_increasing_id()), "digests")


class DigestIndex:
    """The index in the folder `path`, made if it is not there. `buckets` counts for a new one only: one bucket is one task's
    share, so take a bucket for every few million digests to come."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        fs, p = _file_system(spark, self.path)
        there = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        named = {(int(m[2]), int(m[1])): x for x in there if (m := re.fullmatch(r"digests-(\d+)-(\d+)", x.getName()))}
        # A later version counts once it is whole; what a lost compact() left does not.
        whole = [k for k, x in named.items() if k[0] == 0 or fs.exists(_file_system(spark, f"{x.toString()}/_SUCCESS")[1])]
        self.version, self.buckets = max(whole, default=(0, buckets))
        self._open()

    def _open(self) -> None:
        """Makes the files known under a name of this session."""
        self.table = f"palimpsest_digests_{uuid.uuid4().hex}"
        self.location = f"{self.path}/digests-{self.buckets}-{self.version}"
        fs, p = _file_system(self.spark, self.location)
        fs.mkdirs(p)
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{fs.makeQualified(p).toString()}'"
        )

    def rows(self) -> DataFrame:
        """digest, keep_id, batch."""
        return self.spark.table(self.table)

    def missing(self, keyed: DataFrame) -> DataFrame:
        """digest and keep_id of those in keyed that the index has not: an entry each, by bucket."""
        # Written first, or the optimizer would join rows, not entries, and exchange a frequent text's rows to one task.
        entries = written(keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "entries")
        return entries.repartition(self.buckets, "digest").join(self.rows().hint("merge"), "digest", "left_anti")

    def add(self, keyed: DataFrame, batch: str) -> DataFrame:
        """Appends what is new in keyed (doc_id, digest); digest and keep_id of all that the batch has brought."""
        self.missing(keyed).select("digest", "keep_id", F.lit(batch).alias("batch")).sortWithinPartitions("digest").write.insertInto(self.table)
        return self.rows().where(F.col("batch") == batch).select("digest", "keep_id")

    def compact(self) -> None:
        """One sorted file a bucket again, in a new folder beside the old one, which goes when the new one is whole."""
        old_table, old, before = self.table, self.location, self.version
        rows = self.rows()
        self.version = before + 1
        self._open()
        # What an earlier, lost run left in the new folder is overwritten.
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table, overwrite=True)
        self.spark.sql(f"DROP TABLE {old_table}")
        fs, p = _file_system(self.spark, old)
        fs.delete(p, True)


def fresh_rows(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """docs, with their columns, without rows whose text the index or a later doc_id of docs has; adds the batch to the index."""
    brought = index.add(numbered(digests(docs)), batch)
    one = docs.withColumn("_digest", _digest_of("text")).join(brought.select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep")), "_digest")
    # Only rows equal in doc_id and text are left to tell apart; there is one of each but for repeated rows.
    return one.where(F.col("doc_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_digest"]).select(*docs.columns)


def _digest_of(column: str):
    """digest() as an expression."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.unhex(F.sha2(F.translate(F.coalesce(column, F.lit("")), upper, upper.lower()), 256))


def scratch_index(spark: SparkSession, buckets: int) -> DigestIndex:
    """An index that goes when the application ends."""
    path = f"{shared_dir(spark)}/palimpsest/index-{uuid.uuid4().hex}"
    if (around := _SCRATCH.get()) is not None:
        around.append(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return DigestIndex(spark, path, buckets)


def decided(keyed: DataFrame, index: DigestIndex, batches: list[str]) -> DataFrame:
    """What became of each row of keyed, a table made by numbered() whose batches were added to the index: doc_id, keep_id,
    group_size (rows of keyed with the text), kept, text_sha256."""
    groups = keyed.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row"))["row"].alias("last"))
    known = groups.repartition(index.buckets, "digest").join(index.rows().hint("merge"), "digest")
    known = written(known.select("digest", "group_size", "keep_id", F.when(F.col("batch").isin(batches), F.col("last")).alias("last")), "groups")
    kept = F.coalesce(F.col("row") == F.col("last"), F.lit(False))
    return hot_join(keyed, known, ["digest"], "group_size").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_digest(docs: DataFrame, batches: int = 2, buckets: int | None = None) -> DataFrame:
    """The columns that op13 returns. docs go into a fresh index as so many batches, those of the largest ids first, so that each
    later one is checked against what the earlier ones have stored and the row with the largest doc_id stays."""
    spark = docs.sparkSession
    keyed = numbered(digests(docs))
    index = scratch_index(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    low, high = keyed.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    cuts = [low + (high - low + 1) * i // batches for i in range(1, batches)]
    part = sum((F.when(F.coalesce(F.col("doc_id") >= c, F.lit(False)), 1).otherwise(0) for c in cuts), F.lit(0))
    names = [f"part {i}" for i in reversed(range(batches))]
    for i, name in zip(reversed(range(batches)), names, strict=True):
        index.add(keyed.where(part == i), name)
    return decided(keyed, index, names)
