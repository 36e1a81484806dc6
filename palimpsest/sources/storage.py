"""Directories on any file system that Spark reaches: recreate empty, replace by a copy.

Arguments are checked before anything is deleted, and a copy is complete under a
temporary name before it takes the target's place.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = p.getFileSystem(conf)
    return jvm, conf, fs, fs.makeQualified(p)


def ensure_empty_dir(spark: SparkSession, path: str) -> None:
    """path exists and is empty afterwards; missing parents are created."""
    _, _, fs, p = _fs(spark, path)
    if p.isRoot():
        raise ValueError(f"refusing to empty {path}")
    if fs.exists(p):
        fs.delete(p, True)
    fs.mkdirs(p)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A file with these bytes; missing parents are created."""
    _, _, fs, p = _fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(data))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    _, _, fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    _, _, fs, p = _fs(spark, path)
    fs.delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of queries that are over go soon; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def move_new(spark: SparkSession, src: str, dst: str) -> bool:
    """Renames src to dst, which must not be there; whether it did. One step where the file system has it."""
    _, _, fs, s = _fs(spark, src)
    _, _, _, d = _fs(spark, dst)
    fs.mkdirs(d.getParent())
    if fs.exists(d):
        return False
    # A directory that appeared meanwhile would take src into itself.
    return fs.rename(s, d) and not fs.exists(d.suffix(f"/{s.getName()}"))


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, whether it is a directory, length) of what is in a directory, by name."""
    _, _, fs, p = _fs(spark, path)
    return sorted((x.getPath().getName(), x.isDirectory(), x.getLen()) for x in fs.listStatus(p))


def copytree(spark: SparkSession, src: str, dst: str) -> None:
    """dst equals src afterwards, whatever it held. A missing src or one that overlaps dst is refused, and dst stays."""
    jvm, conf, sfs, s = _fs(spark, src)
    _, _, dfs, d = _fs(spark, dst)
    if not sfs.exists(s) or not sfs.getFileStatus(s).isDirectory():
        raise FileNotFoundError(src)
    a, b = s.toString().rstrip("/") + "/", d.toString().rstrip("/") + "/"
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"{src} and {dst} overlap")
    fresh = jvm.org.apache.hadoop.fs.Path(d.getParent(), f".{d.getName()}-{uuid.uuid4().hex}")
    dfs.mkdirs(d.getParent())
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(sfs, s, dfs, fresh, False, True, conf):
        raise OSError(f"copying {src} failed")
    if dfs.exists(d):
        dfs.delete(d, True)
    if not dfs.rename(fresh, d):
        raise OSError(f"{fresh} could not be renamed to {dst}")
