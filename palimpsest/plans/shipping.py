"""Hands the package to executors, which on a cluster have no copy of the repository."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import palimpsest

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session takes the warehouse; elsewhere that might be
    a folder of one machine, so it is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ship_package(spark: SparkSession) -> None:
    """Once for each application: the package as a zip file in the shared folder, added for executors present and later."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(palimpsest.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/palimpsest/palimpsest-{uuid.uuid4().hex}.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    _SHIPPED.add(sc.applicationId)
