"""A patch tree as a data source of its own: spark.read.format("patch_tree").load(root), or .option("files", n) for n files a task.

The columns are those of patches.read_tree. The driver lists directories, not files, and only as far down as a class: filters on
project_id, project, run_ts and class_name drop whole directories before they are listed or read. Class directories are packed
into tasks by the number of their files, a large one is split over several, and a task reads its files one by one.

The tree is reached through the file system that Arrow knows for the path (local, hdfs, s3, ...).
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "project_id int, project string, run_ts timestamp_ntz, class_name string, test_name string, test_no int, source_path string, package string, raw string"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


@dataclass
class Files(InputPartition):
    """Files of class directories: (project_id, project, run_ts, class, paths)."""

    groups: list[tuple] = field(default_factory=list)

    def __init__(self, groups: list[tuple]):
        super().__init__(None)
        self.groups = groups


class PatchTreeReader(DataSourceReader):
    def __init__(self, root: str, files: int):
        self.root, self.files, self.wanted = root, files, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in ("project_id", "project", "run_ts", "class_name") and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f  # Spark applies it

    def _keeps(self, **known) -> bool:
        return all(name not in known or (known[name] is not None and test(known[name], value)) for name, test, value in self.wanted)

    def partitions(self) -> list[Files]:
        fs, root = file_system(self.root)
        out: list[Files] = []
        held: list[tuple] = []
        n = 0
        for project_id, project, run_ts, name, path in self._classes(fs, root):
            paths = sorted(x.path for x in _listed(fs, path) if x.path.endswith(".diff"))
            while paths:
                part, paths = paths[: self.files - n], paths[self.files - n :]
                held.append((project_id, project, run_ts, name, part))
                n += len(part)
                if n == self.files:
                    out.append(Files(held))
                    held, n = [], 0
        return [*out, Files(held)] if held or not out else out

    def _classes(self, fs, root: str) -> Iterator[tuple]:
        for top in sorted(_listed(fs, root), key=lambda x: x.path):
            if not (m := re.fullmatch(r"(\d+)_(.+)", unquote(top.base_name))):
                continue
            project_id, project = int(m[1]), m[2]
            if not self._keeps(project_id=project_id, project=project):
                continue
            for run in sorted(_listed(fs, top.path), key=lambda x: x.path):
                if not (m := re.fullmatch(r"run_(\d{8}_\d{6})", run.base_name)):
                    continue
                run_ts = datetime.datetime.strptime(m[1], "%Y%m%d_%H%M%S")
                if not self._keeps(run_ts=run_ts):
                    continue
                for below in _listed(fs, f"{run.path}/patches"):
                    for c in sorted(_listed(fs, below.path), key=lambda x: x.path):
                        if self._keeps(class_name=c.base_name):
                            yield project_id, project, run_ts, c.base_name, c.path

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = file_system(self.root)
        for project_id, project, run_ts, name, paths in partition.groups:
            for path in paths:
                with fs.open_input_stream(path) as f:
                    raw = f.read().decode("utf-8", "replace")
                test = path.rsplit("/", 1)[-1].removesuffix(".diff")
                source = m[1] if (m := re.match(r"--- a/([^\n]*)", raw)) else ""
                number = re.search(r"([0-9]+)$", test)
                no = int(number[1]) if number and int(number[1]) < 2**31 else None
                yield project_id, project, run_ts, name, test, no, source, ".".join(source.split("/")[1:-1]), raw


class PatchTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "patch_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PatchTreeReader:
        if "path" not in self.options:
            raise ValueError("load() needs the tree's path")
        return PatchTreeReader(self.options["path"], max(1, int(self.options.get("files", 2000))))


def file_system(root: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (LocalFileSystem(), root.rstrip("/"))


def _listed(fs, path: str) -> list:
    from pyarrow.fs import FileSelector

    return fs.get_file_info(FileSelector(path, allow_not_found=True))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, which from then on hands filters to it."""
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(PatchTreeSource)
