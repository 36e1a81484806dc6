"""Removal of repeated strings by a distributed merge sort of suffixes.

Texts are compared as UTF-8 bytes or, with `words`, as words: a word is then the
eight bytes of its hash, so that a span of 400 is 50 words, whatever stands
between them. A byte (word) goes if some string of `span` bytes that covers it also
starts elsewhere, in any document or the same one. Sorting every suffix would need
many times the input in memory and on disk, so a content-chosen subset is sorted:

* Of each window of `span` bytes, the start of its `K`-byte string of least hash
  is an anchor (all of them at ties). Equal windows choose equal anchors, so two
  equal windows always show as two anchors whose suffixes agree to the right and
  whose texts agree to the left, `span` bytes in all.
* An anchor whose `K` bytes occur once in the table cannot be in a repeat. An
  anchor whose whole reach (all windows that may have chosen it) occurs twice is
  repeated throughout: within a document this is settled where the anchors are
  found, so that a text that says one thing over and over sends one row; else by
  counts of hashes, summed before they are exchanged. One anchor of each distinct
  reach stays to be compared.
* These suffixes are sorted into runs. Runs are front-coded (length shared with
  the entry before, then the rest), exchanged, and merged with loser trees that
  carry the shared lengths: known prefixes are never compared again. The merged
  sequence comes with the length each suffix shares with the one before, which
  gives the intervals of suffixes that agree at least so far to the right; within
  an interval neighbours in the order of the reversed left sides agree furthest to
  the left. Where right and left make up `span` bytes, the stretch is repeated.

Runs are cut at ranges of the anchor's hash, `per_task` suffixes a range; a task
merges one range after another, so tasks stay at most `most_tasks` and hold one
range at a time. A `K`-byte string with more than `crowd` different reaches is
split: its suffixes are dealt by the longer strings around them that any repeat
must share, one for each block of left lengths. A longer string that is crowded
itself needs no merging: the `span`-byte strings of its block are counted. So no
task gathers a crowd and no repeat is lost.

Defined cases: null text is read as empty; texts shorter than `span` bytes lose
nothing; texts of any length are handled whole; rows that repeat are repeats of
each other; rows are told apart by doc_id and text, so a null or reused doc_id
does no harm; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, batch_map, hot_join, kgram_hashes, pick, sliding, with_column, word_hashes, written

SPAN, K = 400, 64
#: Bytes of a word where texts are compared as words.
WORD = 8
_CHUNK = 1 << 20
_BLOCK = 16
_FIRST = -(1 << 63)
_PREFIX = 8  # bytes of the group's key before each suffix
_BITS = 32  # a stretch is one number: its start, then so many bits of length
_NOT_SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def encoded(text: str, words: bool = False) -> bytes:
    """What is compared: the text's bytes, or eight bytes for each word."""
    data = text.encode()
    return word_hashes(data)[0].tobytes() if words else data


def anchors(data: bytes, span: int = SPAN, k: int = K, unit: int = 1) -> np.ndarray:
    """Positions of the k-byte strings of least hash in any window of span bytes, ascending; all at multiples of unit (1 or 8)."""
    units = np.frombuffer(data, np.uint8 if unit == 1 else np.uint64)
    span, k = span // unit, k // unit
    n, found = len(units), []
    if n < span:
        return np.zeros(0, np.int64)
    w = span - k + 1
    for a in range(0, n - span + 1, _CHUNK):
        h = kgram_hashes(units[a : a + _CHUNK + span - 1], k)
        pad = np.zeros(w - 1, np.uint64)
        found.append(a + np.flatnonzero(sliding(np.concatenate([pad, sliding(h, w), pad]), w, np.maximum) == h))
    return np.unique(np.concatenate(found)) * unit


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the two keys that tell rows apart; equal rows share them."""
    return pick(docs, "doc_id", "text").withColumns({"k1": F.coalesce("doc_id", F.lit(_FIRST)), "k2": F.xxhash64("text")})


def _united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order of start, joined where they meet."""
    end = np.maximum.accumulate(end)
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > end[:-1]
    return start[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)]


def _anchor_rows(keyed: DataFrame, span: int, k: int, words: bool) -> DataFrame:
    """Each document's anchors: pos, gram (hash of its k bytes), reach (hash of its reach) and n, how many there have both; pos is
    the first. Also, with gram null, what the document itself repeats: from pos to `until`."""

    def run(batches):
        none = np.zeros(0, np.int64)
        for b in batches:
            held: list[tuple] = []
            nulls: list[np.ndarray] = []
            for k1, k2, text in zip(b["k1"], b["k2"], b["text"], strict=True):
                data = encoded(text, words)
                at = anchors(data, span, k, WORD if words else 1)
                if not len(at):
                    continue
                places = at.tolist()
                gram = np.fromiter((xxhash.xxh64_intdigest(data[p : p + k]) for p in places), np.uint64, len(at))
                reach = np.fromiter((xxhash.xxh64_intdigest(data[(a := max(0, p - span + k)) : p + span], p - a) for p in places), np.uint64, len(at))
                _, first, group, n = np.unique(reach, return_index=True, return_inverse=True, return_counts=True)  # which fixes gram
                again = at[n[group] > 1]
                start, end = _united(np.maximum(0, again - (span - k)), np.minimum(again + span, len(data))) if len(again) else (none, none)
                m = len(first) + len(start)
                zero = np.zeros(len(start), np.int64)
                held.append((np.full(m, k1, np.int64), np.full(m, k2, np.int64), np.concatenate([at[first], start]), np.concatenate([gram.view(np.int64)[first], zero]), np.concatenate([reach.view(np.int64)[first], zero]), np.concatenate([n, zero]), np.concatenate([np.zeros(len(first), np.int64), end])))
                nulls.append(np.arange(m) >= len(first))
            if held:
                out = dict(zip(("k1", "k2", "pos", "gram", "reach", "n", "until"), map(np.concatenate, zip(*held, strict=True)), strict=True))
                yield out | {"gram": pa.array(out["gram"], mask=np.concatenate(nulls))}

    return arrow_map(keyed.select("k1", "k2", "text"), run, "k1 bigint, k2 bigint, pos bigint, gram bigint, reach bigint, n bigint, until bigint")


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, known to be at least `at`."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n]) ^ int.from_bytes(b[at:n])
    return n - (x.bit_length() + 7 >> 3)


def front_coded(entries: list[tuple]) -> bytes:
    """Entries (suffix, rest...) sorted and written as (shared length with the one before, remaining bytes, rest)."""
    entries.sort(key=lambda e: e[0])
    out, last = [], b""
    for suffix, *rest in entries:
        n = shared(suffix, last, 0)
        out.append((n, suffix[n:], rest))
        last = suffix
    return pickle.dumps(out, protocol=5)


def unfolded(run: bytes):
    """A front-coded run's entries again: (shared length, suffix, rest)."""
    last = b""
    for n, tail, rest in pickle.loads(run):
        last = last[:n] + tail
        yield n, last, rest


def merged(runs: list):
    """Merges runs of (shared length with the entry before, suffix, rest) by a loser tree.

    Each waiting entry knows how long a prefix it shares with the entry put out last. Of two, the one that shares more is
    the smaller; only at a tie are bytes looked at, from there on, and the loser's shared length becomes that with the
    winner. Yields the same triples for the merged sequence.
    """
    size = 1
    while size < len(runs):
        size *= 2
    sources = [iter(r) for r in runs]
    gone = (-1, b"", None)
    heads = [next(s, gone) for s in sources] + [gone] * (size - len(runs))
    heads = [(0, *h[1:]) if h[0] >= 0 else h for h in heads]
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two sources."""
        x, y = heads[a], heads[b]
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        if x[0] < 0:
            return a, b
        n = shared(x[1], y[1], x[0])
        if x[1][n : n + 1] <= y[1][n : n + 1]:
            heads[b] = (n, *y[1:])
            return a, b
        heads[a] = (n, *x[1:])
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if size > 1 else 0
    while heads[top][0] >= 0:
        yield heads[top]
        heads[top] = next(sources[top], gone) if top < len(sources) else gone
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeats_in_group(rights: list[int], lefts: list[bytes], span: int, unit: int = 1) -> list[list[tuple[int, int]]]:
    """For suffixes in order: rights[i], the length shared with suffix i - 1; lefts, their left sides reversed, a unit's bytes as
    they were or not: lengths count whole units only.

    Per suffix, the (left, right) lengths of repeats of at least span bytes around its anchor. Intervals of suffixes are
    joined from the longest shared length down; in each the best left length comes from neighbours in left order.
    """
    n = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = sorted(range(n), key=lefts.__getitem__)
    near = np.array([shared(lefts[a], lefts[b], 0) for a, b in zip(order, order[1:], strict=False)] + [0], np.int64) // unit * unit
    rights = [x // unit * unit for x in rights]
    if int(near.max(initial=0)) + max(rights[1:], default=0) < span:
        return out
    rank = [0] * n
    for i, j in enumerate(order):
        rank[j] = i
    owner = list(range(n))
    members: dict[int, list[int]] = {i: [rank[i]] for i in range(n)}
    # Shared lengths to the right only fall, so a stretch adds something only if it reaches further left than before.
    furthest = np.full(n, -1, np.int64)

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    cuts = sorted(range(1, n), key=lambda i: -rights[i])
    a = 0
    while a < len(cuts):
        h, touched = rights[cuts[a]], set()
        while a < len(cuts) and rights[cuts[a]] == h:
            x, y = find(cuts[a] - 1), find(cuts[a])
            if len(members[x]) < len(members[y]):
                x, y = y, x
            owner[y] = x
            members[x] += members.pop(y)
            touched.discard(y)
            touched.add(x)
            a += 1
        for root in touched:
            ranks = members[root]
            ranks.sort()
            left = np.minimum.reduceat(near, ranks)
            left[-1] = 0
            best = np.maximum(left, np.concatenate([[0], left[:-1]]))
            at = np.array(ranks)
            new = np.flatnonzero((best + h >= span) & (best > furthest[at]))
            furthest[at[new]] = best[new]
            for i in new.tolist():
                out[order[ranks[i]]].append((int(best[i]), h))
    return out


def _blocks_of(data: bytes, p: int, span: int, k: int) -> Iterator[tuple[int, int]]:
    """Blocks of left lengths of an anchor at p, as (least, most), whose common string lies in the text."""
    for lo in range(0, span - k + 1, _BLOCK):
        hi = min(lo + _BLOCK - 1, span - k)
        if p >= lo and p + span - hi <= len(data):
            yield lo, hi


class _Runs:
    """Suffixes gathered by cell, a range of their keys, and given out as front-coded runs."""

    def __init__(self, cells: int, per_task: int):
        self.cells, self.per_task, self.size = cells, per_task, 0
        self.held: dict[int, list] = {}

    def add(self, key: int, right: bytes, left: bytes, k1: int, k2: int, pos: int) -> None:
        """key: of anchors that may be compared; left: reversed."""
        key &= (1 << 64) - 1
        self.held.setdefault(key * self.cells >> 64, []).append((key.to_bytes(_PREFIX) + right, left, k1, k2, pos))
        self.size += 1

    def full(self) -> bool:
        return self.size >= self.per_task

    def take(self) -> dict[str, list]:
        out = {"cell": list(self.held), "run": [front_coded(e) for e in self.held.values()]}
        self.held, self.size = {}, 0
        return out


_RUN, _CONTEXT = "cell bigint, run binary", "k1 bigint, k2 bigint, pos bigint, at int, context binary"


def _first_runs(chosen: DataFrame, keyed: DataFrame, span: int, k: int, cells: int, per_task: int, words: bool) -> DataFrame:
    """From one exchange of the texts that have chosen anchors (k1, k2, pos, gram, crowded): runs, and for crowded anchors their
    surroundings instead, with the anchor's place in them."""
    wanted = chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "gram", "crowded")).alias("anchors"))
    rows = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"])
    columns = [c.split()[0] for c in f"{_RUN}, {_CONTEXT}".split(", ")]

    def run(batches):
        runs = _Runs(cells, per_task)
        for b in batches:
            around: list[tuple] = []
            for k1, k2, text, found in zip(b["k1"], b["k2"], b["text"], b["anchors"], strict=True):
                data = encoded(text, words)
                for x in found:
                    p = x["pos"]
                    a = max(0, p - span + k)
                    if x["crowded"]:
                        around.append((None, None, k1, k2, p, p - a, data[a : p + span]))
                    else:
                        runs.add(x["gram"], data[p : p + span], data[a:p][::-1], k1, k2, p)
            if around:
                yield dict(zip(columns, map(list, zip(*around, strict=True)), strict=True))
            if runs.full():
                yield padded(runs.take())
        if runs.size:
            yield padded(runs.take())

    def padded(out):
        return {c: out.get(c, [None] * len(out["cell"])) for c in columns}

    return arrow_map(rows, run, f"{_RUN}, {_CONTEXT}")


def _uncrowded(contexts: DataFrame, span: int, k: int, crowd: int, cells: int, per_task: int, words: bool) -> tuple[DataFrame, DataFrame]:
    """Anchors of crowded grams, with their surroundings, dealt by longer strings: runs of those to be merged, and of strings that are
    crowded themselves the repeated stretches (k1, k2, start, end), by counts of span-byte strings."""
    unit = WORD if words else 1

    def long_keys(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("k1", "k2", "pos", "lo", "key")}
            for k1, k2, pos, p, data in zip(b["k1"], b["k2"], b["pos"], b["at"], b["context"], strict=True):
                for lo, hi in _blocks_of(data, p, span, k):
                    key = xxhash.xxh64_intdigest(data[p - lo : p + span - hi], lo + 1)
                    for name, v in zip(out, (k1, k2, pos, lo, key - (key >> 63 << 64)), strict=True):
                        out[name].append(v)
            yield out

    def runs(batches):
        held = _Runs(cells, per_task)
        for b in batches:
            for k1, k2, pos, p, data, found in zip(b["k1"], b["k2"], b["pos"], b["at"], b["context"], b["long"], strict=True):
                for x in found:
                    if x["size"] <= crowd:
                        held.add(x["key"], data[p : p + span], data[:p][::-1], k1, k2, pos)
            if held.full():
                yield held.take()
        if held.size:
            yield held.take()

    def windows(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("k1", "k2", "start", "window")}
            for k1, k2, pos, p, data, found in zip(b["k1"], b["k2"], b["pos"], b["at"], b["context"], b["long"], strict=True):
                starts = {p - left for x in found if x["size"] > crowd for left in range(x["lo"], min(x["lo"] + _BLOCK - 1, span - k) + 1, unit)}
                for s in sorted(starts):
                    if s >= 0 and s + span <= len(data):
                        for name, v in zip(out, (k1, k2, pos - p + s, xxhash.xxh3_128_digest(data[s : s + span])), strict=True):
                            out[name].append(v)
            yield out

    keys = written(arrow_map(contexts, long_keys, "k1 bigint, k2 bigint, pos bigint, lo int, key bigint"), "long")
    # A longer string that stands once is in no repeat.
    counts = written(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "long_counts")
    long = hot_join(keys, counts, ["key"], "size").groupBy("k1", "k2", "pos").agg(F.collect_set(F.struct("lo", "key", "size")).alias("long"))
    dealt = written(contexts.join(long, ["k1", "k2", "pos"]), "crowded_anchors")
    found = written(arrow_map(dealt, windows, "k1 bigint, k2 bigint, start bigint, window binary").distinct(), "windows")
    twice = written(found.groupBy("window").agg(F.count("*").alias("size")).where("size > 1"), "twice")
    repeated = hot_join(found, twice, ["window"], "size").select("k1", "k2", "start", (F.col("start") + span).alias("end"))
    return arrow_map(dealt, runs, _RUN), repeated


def _merged_runs(runs: DataFrame, span: int, cells: int, most_tasks: int, words: bool) -> DataFrame:
    """Of the suffixes in runs, the stretches (k1, k2, start, end) that are repeated around two anchors of one key."""
    unit = WORD if words else 1
    tasks = min(cells, most_tasks)
    dealt = runs.repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell")

    def merge(batches):
        def cell(runs: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {"k1": [], "k2": [], "start": [], "end": []}
            rights: list[int] = []
            group: list[list] = []

            def close():
                if len(group) > 1:
                    for (_, k1, k2, p), found in zip(group, repeats_in_group(rights, [g[0] for g in group], span, unit), strict=True):
                        for left, right in found:
                            for name, v in zip(out, (k1, k2, p - left, p + right), strict=True):
                                out[name].append(v)
                rights.clear()
                group.clear()

            for n_shared, _, rest in merged([unfolded(r) for r in runs]):
                if n_shared < _PREFIX:
                    close()
                rights.append(n_shared - _PREFIX)
                group.append(rest)
            close()
            return out

        waiting, now = [], None
        for b in batches:
            for c, run in zip(b["cell"], b["run"], strict=True):
                if c != now and waiting:
                    yield cell(waiting)
                    waiting = []
                now = c
                waiting.append(run)
        if waiting:
            yield cell(waiting)

    return arrow_map(dealt, merge, "k1 bigint, k2 bigint, start bigint, end bigint")


def repeated_stretches(docs: DataFrame, span: int = SPAN, k: int = K, words: bool = False, crowd: int = 20_000, per_task: int = 10_000, most_tasks: int = 10_000) -> DataFrame:
    """k1, k2 (see _keyed) and stretches: array of start * 2 ** 32 + length, any order, overlapping, end perhaps beyond the text; only rows that have some."""
    keyed = _keyed(docs)
    rows = written(_anchor_rows(keyed, span, k, words), "anchors")
    marks = rows.where("gram is not null").drop("until")
    own = rows.where("gram is null").select("k1", "k2", F.col("pos").alias("start"), F.col("until").alias("end"))
    grams = written(marks.groupBy("gram").agg(F.sum("n").alias("times"), F.count("*").alias("size"), F.min("reach").alias("lo"), F.max("reach").alias("hi")).where("times > 1").drop("times"), "grams")
    several = written(hot_join(marks, grams, ["gram"], "size").select("k1", "k2", "pos", "gram", "reach", "n", (F.col("lo") == F.col("hi")).alias("same")), "repeated")
    mixed = several.where("not same")
    reaches = written(mixed.groupBy("gram", "reach").agg(F.count("*").alias("size"), F.min(F.struct("k1", "k2", "pos")).alias("one")), "reaches")
    crowded = written(reaches.groupBy("gram").agg(F.count("*").alias("size")).where(F.col("size") > crowd), "crowded")
    chosen = reaches.select("one.k1", "one.k2", "one.pos", "gram")
    hot = not crowded.isEmpty()
    if hot:
        chosen = hot_join(chosen, crowded, ["gram"], "size").drop("size").withColumn("crowded", F.lit(True)).unionByName(chosen.join(crowded, "gram", "left_anti").withColumn("crowded", F.lit(False)))
    else:
        chosen = chosen.withColumn("crowded", F.lit(False))
    # What stands twice in one document is settled there.
    again = hot_join(mixed.where("n = 1"), reaches.where("size > 1").select("gram", "reach", "size"), ["gram", "reach"], "size")
    settled = several.where("same and n = 1").select("k1", "k2", "pos").unionByName(again.select("k1", "k2", "pos"))
    whole = settled.select("k1", "k2", F.greatest(F.lit(0), F.col("pos") - (span - k)).alias("start"), (F.col("pos") + span).alias("end"))
    found = whole.unionByName(own)
    cells = max(1, -(-reaches.count() // per_task))
    first = written(_first_runs(chosen, keyed, span, k, cells, per_task, words), "runs")
    runs = first.where("run is not null").select("cell", "run")
    if hot:
        more, counted = _uncrowded(first.where("run is null").drop("cell", "run"), span, k, crowd, cells, per_task, words)
        runs, found = runs.unionByName(more), found.unionByName(counted)
    found = found.unionByName(_merged_runs(runs, span, cells, most_tasks, words))
    # Start and length in one number.
    return found.groupBy("k1", "k2").agg(F.collect_set(F.shiftleft("start", _BITS) + F.col("end") - F.col("start")).alias("stretches"))


def removed_runs(n: int, stretches, span: int) -> np.ndarray:
    """Of n compared bytes, the runs that go, as rows (start, end), from the numbers that repeated_stretches gives."""
    c = np.sort(np.asarray(stretches if stretches is not None else (), np.int64))
    start = c >> _BITS
    end = np.minimum(start + (c & (1 << _BITS) - 1), n)
    whole = end - start >= span
    if not whole.any():
        return np.zeros((0, 2), np.int64)
    return np.stack(_united(start[whole], end[whole]), axis=1)


def kept_parts(n: int, stretches, span: int) -> list[tuple[int, int]]:
    """The parts between the runs that go."""
    edges = [0, *removed_runs(n, stretches, span).ravel().tolist(), n]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def dedup_digest(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The columns that op2 returns, one row per document."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for text, stretches in zip(b["text"], b["stretches"], strict=True):
                data = text.encode()
                rest = b"".join(data[x:y] for x, y in kept_parts(len(data), stretches, span))
                for name, v in zip(list(out)[1:], (len(data), len(data) - len(rest), len(removed_runs(len(data), stretches, span)), hashlib.sha256(rest).hexdigest()), strict=True):
                    out[name].append(v)
            yield out

    rows = _keyed(docs).join(repeated_stretches(docs, span), ["k1", "k2"], "left").select("doc_id", "text", "stretches")
    return arrow_map(rows, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_words(text: str, stretches, span: int) -> str:
    """text without the words in its repeated stretches, nor the space after them."""
    data = text.encode()
    starts = [m.start() for m in _NOT_SPACE.finditer(data)]
    starts.append(len(data))
    n = WORD * (len(starts) - 1)
    parts = [(starts[a // WORD] if a else 0, starts[b // WORD]) for a, b in kept_parts(n, stretches, span)]
    return b"".join(data[a:b] for a, b in parts).decode()


def remove_repeats(docs: DataFrame, span: int = SPAN, words: bool = False) -> DataFrame:
    """docs with repeated stretches of span bytes, or of span // WORD words, cut from `text`; characters cut in two go entirely, null
    stays null. Other columns are kept; n_chars, if there, is counted anew."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for t, s in zip(batch.column("text").to_pylist(), batch.column("_stretches").to_pylist(), strict=True):
            if t is not None and s:
                if words:
                    t = without_words(t, s, span)
                else:
                    data = t.encode()
                    t = "".join(data[a:b].decode("utf-8", "ignore") for a, b in kept_parts(len(data), s, span))
            texts.append(t)
        return with_column(batch, "text", texts)

    found = repeated_stretches(docs, span, words=words).withColumnsRenamed({"k1": "_a", "k2": "_b", "stretches": "_stretches"})
    # One struct holds the row, so no name of its columns can clash.
    keyed = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), F.coalesce("doc_id", F.lit(_FIRST)).alias("_a"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_b"), F.col("text"))
    rows = batch_map(keyed.join(found, ["_a", "_b"], "left").select("row", "text", "_stretches"), cut)
    kept = {"text": F.col("text")} | ({"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(kept.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
