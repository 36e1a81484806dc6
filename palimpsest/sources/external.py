"""External build steps: one run by the driver, or one for each row, run by tasks."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

# Fixed value: seconds that a build may take.
TIMEOUT_SEC = 1800


def run_build(project_root: str | Path, targets: Sequence[str], command: str = "ant", timeout_sec: int = TIMEOUT_SEC) -> str:
    """Output, errors included, of `command targets...` in project_root.

    No shell is involved. No targets means the default one. Another exit code than 0 raises RuntimeError with targets and
    output; a missing command and a timeout raise what the standard library raises.
    """
    done = subprocess.run([command, *targets], cwd=project_root, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, timeout=timeout_sec)
    if done.returncode:
        raise RuntimeError(f"{command} {' '.join(targets)} exited with {done.returncode}:\n{done.stdout}")
    return done.stdout


def build_rows(rows: DataFrame, targets: str, root: str | None = None, command: str = "ant", timeout_sec: int = TIMEOUT_SEC, tasks: int | None = None) -> DataFrame:
    """rows with exit_code, output and failure, after `command targets...` was run for each, in the directory that column root names.

    targets is a column of arrays; null means none, null entries are left out. Nothing stops the job: failure is null, `exit`, `timeout` or
    `missing` (no such command or directory), and exit_code is null unless the command ended. Output includes errors; what is no UTF-8 is
    replaced. A task runs its rows' commands one after the other; rows are dealt evenly over `tasks`, by default some for each core, however few
files they come from. A command must bear being run again, since a task may.
    """
    names = rows.columns

    def one(wanted, where) -> tuple[int | None, str | None, str | None]:
        args = [command, *(t for t in (wanted if wanted is not None else ()) if t is not None)]
        try:
            done = subprocess.run(args, cwd=where or ".", stdout=subprocess.PIPE, stderr=subprocess.STDOUT, stdin=subprocess.DEVNULL, timeout=timeout_sec)
        except subprocess.TimeoutExpired as e:
            return None, (e.stdout or b"").decode("utf-8", "replace"), "timeout"
        except (FileNotFoundError, NotADirectoryError):
            return None, None, "missing"
        return done.returncode, done.stdout.decode("utf-8", "replace"), "exit" if done.returncode else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(t, w) for t, w in zip(b[targets], b[root] if root else [None] * len(b), strict=True)]
            out = b.assign(output=[g[1] for g in got], failure=[g[2] for g in got])
            out["exit_code"] = pd.array([g[0] for g in got], "Int32")
            yield out[[*names, "exit_code", "output", "failure"]]

    fields = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    spark = rows.sparkSession
    tasks = tasks or max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks).mapInPandas(run, f"{fields}, exit_code int, output string, failure string")
