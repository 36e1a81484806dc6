"""Patches applied to their sources while they stream in, in the order of event time.

Records of a key wait until the watermark has passed them, then they are applied in the order of (at, sources first, seq): what arrives
out of order, or late by less than the watermark's delay, gives the rows of the batch fold. State of a key: its text and
counts, and the records that wait. Keys are dealt into groups, whose timers tell when the first record falls due. A record that comes `idle` of
event time or more after its key's last finds it forgotten.
"""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.textdiff import fitted

#: The state store that timers and composite state need. The rest is about disk and memory: texts are packed well, the stores of an executor
#: share 200 MB, copies on its disk go within seconds when a stream is over, and the checkpoint keeps the last two versions, from which a stream goes on.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextlib.contextmanager
def composite_state(spark: SparkSession, share: int = 1) -> Iterator[None]:
    """Streams started inside keep their state where this module's operator can use it; the session's settings come back.

    share: that of the session's shuffle partitions which such a stream gets, 1/share, as one of several streams of a table.
    """
    parts = "spark.sql.shuffle.partitions"
    settings = _STATE | ({parts: str(max(spark.sparkContext.defaultParallelism, int(spark.conf.get(parts)) // share))} if share > 1 else {})
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class _Fold(StatefulProcessor):
    """Folds a group of keys: a call to the state is a round trip, so what waits is read and written for all of them at once."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getMapState("now", "key string", "text string, applied bigint, rejected bigint, last_ms bigint")
        self.waiting = handle.getListState("waiting", "key string, at_ms bigint, source boolean, seq bigint, body string")
        self.sweep = handle.getValueState("sweep", "due_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for r in rows:
            # Milliseconds rounded up, so that a timer is never due before its record.
            fresh = [
                (k if isinstance(k, str) else None, -(-int(at.value) // 1_000_000), bool(s), None if pd.isna(q) else int(q), b if isinstance(b, str) else None)
                for k, at, s, q, b in zip(r["fold_key"], r["at"], r["source"], r["seq"], r["body"], strict=True)
            ]
            self.waiting.appendList(fresh)
            first = min(x[1] for x in [*fresh, (None, first)] if x[1] is not None)
        if first is not None:
            self.handle.registerTimer(first)  # the others' time is looked at then
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed, not only what fell due first.
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        ready, rest = defaultdict(list), []
        for x in map(tuple, self.waiting.get()):
            if x[1] <= due:
                ready[x[0]].append(x[1:])
            else:
                rest.append(x)
        if ready:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(x[1] for x in rest))
            else:
                self.waiting.clear()
            done = [row for k, records in ready.items() for row in self._folded(k, records)]
            yield pd.DataFrame(done, columns=["fold_key", "text", "applied", "rejected"])
        self._forget(due)

    def _folded(self, key: str | None, records: list[tuple]) -> Iterator[tuple]:
        """Rows of a key after its records; more than one only where it was forgotten between two of them."""
        records.sort(key=lambda x: (x[0], not x[1], x[2] is not None, x[2] or 0, x[3] or ""))
        text, done, refused, last = self.now.getValue((key,)) or (None, 0, 0, records[0][0])
        fresh = False
        for at, source, _, body in records:
            if at >= last + self.idle_ms:
                if fresh:
                    yield key, text, done, refused
                text, done, refused = None, 0, 0
            if source:
                text = body
            elif (new := fitted(text, body)) is None:
                refused += 1
            else:
                text, done = new, done + 1
            last, fresh = at, True
        self.now.updateValue((key,), (text, done, refused, last))
        yield key, text, done, refused

    def _forget(self, due: int) -> None:
        """Drops the keys that have been idle. The group's keys are looked through at most 16 times in that time."""
        again = self.sweep.get()[0] if self.sweep.exists() else None
        if again is not None and due < again:
            return
        oldest, gone = None, []
        if again is not None:
            for k, state in self.now.iterator():
                if due >= state[3] + self.idle_ms:
                    gone.append(tuple(k))
                elif oldest is None or state[3] < oldest:
                    oldest = state[3]
            for k in gone:
                self.now.removeKey(k)
            if oldest is None:
                self.sweep.clear()
                return
        again = max((due if oldest is None else oldest) + self.idle_ms, due + self.idle_ms // 16)
        self.sweep.update((again,))
        self.handle.registerTimer(again)

    def close(self) -> None:
        pass


def fold_stream(records: DataFrame, key: str, late: str = "1 hour", idle_ms: int = 30 * 86_400_000, groups: int = 1024) -> DataFrame:
    """key, text, applied, rejected each time that patches of a key have been applied, for append mode inside composite_state().

    records: a stream of key, at (timestamp), source (boolean), seq, body: a source's whole text, or a patch. A later
    source replaces the text. A patch that does not fit, or comes before any source, is rejected and the rest goes on. Records
    later than `late` are dropped by the watermark. A stream at rest moves on with the next record of any key.

    State is kept in `groups` groups of keys, by a hash. A task holds what waits in one of them, so some hundred keys to a group are right; a
    stream that goes on from its checkpoint must keep the number.
    """
    kind = dict(records.dtypes)[key]
    text = F.hex(key) if kind == "binary" else F.col(key).cast("string")
    timed = records.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("fold_group"), text.alias("fold_key"), "at", "source", "seq", "body").withWatermark("at", late)
    rows = timed.groupBy("fold_group").transformWithStateInPandas(_Fold(idle_ms), "fold_key string, text string, applied bigint, rejected bigint", "Append", "EventTime")
    back = F.unhex("fold_key") if kind == "binary" else F.col("fold_key").cast(kind)
    return rows.select(back.alias(key), "text", "applied", "rejected")
