"""What the operators of this folder share: input columns, shared storage, Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.batches import small_batches
from palimpsest.plans.shipping import is_local, shared_folder

#: Columns of the documents table.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, with `text` null read as empty; any other column is ignored."""
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c == "text" else F.col(c) for c in columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in a local session a temporary one where none is named."""
    if spark.sparkContext.getConf().get("spark.checkpoint.dir") or not is_local(spark):
        return shared_folder(spark)
    if not getattr(spark, "_palimpsest_dir", None):
        spark._palimpsest_dir = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, spark._palimpsest_dir, True)
    return spark._palimpsest_dir


def written(df: DataFrame, name: str, kept: bool = False, group_rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs one task.

    kept: also beyond the scratch() around it. group_rows: of a row group at most, for long rows, since a task writes and reads one at a time. The table goes when the application ends. What the finished step exchanged is then
    garbage; collecting it lets Spark delete those files before the next step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    if (around := _SCRATCH.get()) is not None and not kept:
        around.append(path)
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Paths written inside the innermost scratch(); each thread has its own.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; nothing that reads them may be used after it."""
    paths: list[str] = []
    before = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in paths:
            fs, p = _file_system(spark, path)
            fs.delete(p, True)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str, share: int = 1000) -> DataFrame:
    """rows joined with table, a written one that has each key once and as `size` how many rows have it.

    Keys with more than one in `share` of those rows are fewer than `share`, so they are broadcast, and their rows stay
    where they are; the rest is exchanged without any hot key.
    """
    most = (table.agg(F.sum(size)).first()[0] or 0) // share
    hot = F.broadcast(table.where(F.col(size) > most))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(table.where(F.col(size) <= most), keys))


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file to the shared folder and hands it to every executor, present and later; returns the name that they know it by."""
    name = f"{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, f"{shared_dir(spark)}/palimpsest/{name}")
    out = fs.create(p)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(p).toString())
    return name


def arrow_map(df: DataFrame, func: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, object]]], schema: str) -> DataFrame:
    """mapInArrow with batches as dicts of Python lists in; dicts of lists or arrays, or Arrow tables, out."""
    types = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # batches make millions of small objects and no cycles
        try:
            for out in func(b.to_pydict() for b in batches if b.num_rows):
                if isinstance(out, pa.Table):
                    yield from out.cast(types).combine_chunks().to_batches(max_chunksize=100_000)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)
        finally:
            gc.enable()
            _give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def counts_of(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    """n_<kind> for each kind of span in an array column of (kind, start, end)."""
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    return [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in kinds]


def spans_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, by start, then kind as listed, then end, joined by commas."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(rank, s["kind"]), s["end"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def batch_map(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """df through func a batch at a time; the columns stay the same ones, and those that func leaves alone pass untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield func(b)
        _give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def with_column(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    """batch with a column's values replaced, its type kept."""
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))


def _give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task, and others share the executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def sliding(values: np.ndarray, width: int, pick_one=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each window of `width` values, by doubling; len - width + 1 values."""
    out, span = values, 1
    while span * 2 <= width:
        out = pick_one(out[:-span], out[span:])
        span *= 2
    return pick_one(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each bit of x over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LONG = 64  # bytes of a word that are hashed beside other words'; longer words one by one
_BELOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # keeps the first n bytes of eight
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of data, in order, and where the words start; words are runs of bytes other than ASCII white space.

    Eight bytes of all words are taken in at once, as whole numbers, so the work in Python does not grow with the number of words.
    """
    edge = np.flatnonzero(np.diff(_SPACE[np.frombuffer(data, np.uint8)], prepend=True, append=True))
    start, size = edge[::2], edge[1::2] - edge[::2]
    # Aligned numbers, two of which hold the eight bytes from any place on.
    eights = np.frombuffer(data + bytes(16 - len(data) % 8), np.dtype("<u8"))
    out = size.astype(np.uint64) * _STEP
    some = np.arange(len(start))
    for done in range(0, _LONG, 8):
        some = some[size[some] > done]
        if not len(some):
            break
        at = start[some] + done
        shift = ((at & 7) << 3).astype(np.uint64)
        at >>= 3
        part = (eights[at] >> shift) | (eights[at + 1] << (np.uint64(63) - shift) << np.uint64(1))
        h = (out[some] ^ (part & _BELOW[np.minimum(size[some] - done, 8)])) * _STEP
        out[some] = h ^ (h >> np.uint64(32))
    out = mix(out)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return out, start


def in_groups(texts: Iterable[bytes], least: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts in order, so many bytes or little more at once; a longer text adds to no other."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > least:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; sorts, which is faster here than numpy's hashing of them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def kgram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Mixed rolling hash of every k consecutive units, by doubling; len - k + 1 values."""
    base = np.array([0x9E3779B97F4A7C15], np.uint64)
    power = {1: base}
    blocks, span = {1: units.astype(np.uint64) + np.uint64(1)}, 1
    while span * 2 <= k:
        b = blocks[span]
        blocks[span * 2] = b[:-span] * power[span] + b[span:]
        power[span * 2] = power[span] * power[span]
        span *= 2
    n, out, done = len(units) - k + 1, None, 0
    while span:
        if k & span:
            part = blocks[span][done : done + n]
            out = part if out is None else out * power[span] + part
            done += span
        span //= 2
    return mix(out)
