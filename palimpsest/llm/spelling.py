"""Groups of spelling variants: words that differ by one code point, found by merging the subtrees of an errata trie.

The trie is the sorted vocabulary: a node is the interval of the words that share a prefix P. At a node the child with most words
is heavy, the others are light, and so is a word that ends there. Small goes into large: only light words are merged, each
with the character behind P

- replaced: by the heavy child's (and among light words by a wildcard, so that their tails coincide),
- skipped: P + tail, sought anywhere below the node,
- preceded by the heavy child's character (which is that character skipped in the heavy subtree, from the light side).

Where a merged terminal coincides with a word, the two are one edit apart. Each pair comes up exactly once (of a run of one character the
last one is taken as skipped), and since a word is light on at most log2(n) nodes of its path, the work is n log n.

Spark cuts the sorted vocabulary into ranges. A node within one range is merged by the task that has the range. A node that spans
ranges is known from the words at the borders alone: its light words become rows, a merged terminal each, that are joined
with the vocabulary. There the heavy child is the one that most borders run through; any choice gives the same
pairs, it only decides how much is merged.

Defined cases: null and empty texts have no words; a null doc_id is written as `null` when a deletion is drawn; rows with equal doc_id are
counted each; words and texts of any length are handled whole; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, pick, written

LEAST_CHARS, LEAST_COUNT = 5, 3
#: One in so many runs of a document loses a code point.
DELETED = 97
#: Words of a range at most, about; beyond `MOST_RANGES` ranges, whose borders every task knows, they grow with the vocabulary.
RANGE_WORDS, MOST_RANGES = 16_384, 10_000

#: ISO 8859-1 bytes of words as they are, A-Z lower-cased, all others as a space; one byte is one code point.
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of [A-Za-z\\u00C0-\\u00FF] in ISO 8859-1, A-Z lower-cased; what that encoding lacks separates them."""
    return (text or "").encode("latin-1", "replace").translate(_WORD_BYTES).split()


def worn(run: bytes, drawn: int) -> bytes:
    """The run without the code point that drawn, the checksum of `<doc_id>:<run>`, takes, if it takes one."""
    return run if drawn % DELETED else run[: (at := drawn % len(run))] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct results of `least_chars` code points that occur `least_count` times."""

    def run(batches):
        found: Counter[bytes] = Counter()
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                head = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs_of(text)).items():
                    if len(word) >= least_chars:
                        word = worn(word, zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head))
                        if len(word) >= least_chars:
                            found[word] += n
            if len(found) > 500_000:
                yield _counted(found)
                found.clear()
        yield _counted(found)

    words = arrow_map(pick(docs, "doc_id", "text"), run, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(found: Counter[bytes]) -> dict[str, list]:
    return {"word": [w.decode("latin-1") for w in found], "n": list(found.values())}


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def children(words: list[str], low: int, high: int, depth: int) -> Iterator[tuple[int, int]]:
    """Intervals of the children of the node that holds words[low:high], which are longer than depth and agree up to it."""
    while low < high:
        end = bisect_right(words, words[low][depth], low, high, key=lambda w: w[depth])
        yield low, end
        low = end


class Near:
    """Of each word how many others are one edit away, and which of them comes first by count, then by code points."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.rank = words, [(-n, w) for n, w in zip(counts, words, strict=True)]
        self.place = {w: i for i, w in enumerate(words)}
        self.n, self.first = [0] * len(words), [None] * len(words)

    def add(self, i: int, other: int, times: int = 1) -> None:
        self.n[i] += times
        if self.first[i] is None or self.rank[other] < self.first[i]:
            self.first[i] = self.rank[other]

    def pair(self, i: int, word: str) -> None:
        if (j := self.place.get(word)) is not None:
            self.add(i, j)
            self.add(j, i)

    def alike(self, members: list[int]) -> None:
        """Words that differ in one place: all near to each other, without a step for each two."""
        ordered = sorted(members, key=self.rank.__getitem__)[:2]
        for i in members:
            self.add(i, ordered[i == ordered[0]], len(members) - 1)


def merge(near: Near, above: list[int]) -> None:
    """Merges every node within sorted words that lies deeper than `above` says: nodes up to that depth span other ranges, too."""
    words = near.words
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        depth += shared(words[low][depth:], words[high - 1][depth:])
        ends = low + (len(words[low]) == depth)
        below = list(children(words, ends, high, depth))
        stack += [(a, b, depth + 1) for a, b in below]
        if min(above[low], above[high - 1]) >= depth:
            continue  # the whole node does, since its words agree up to there
        a, b = max(below, key=lambda x: x[1] - x[0])
        prefix, heavy = words[low][:depth], words[a][depth]
        if ends > low:
            near.pair(low, prefix + heavy)
        tails: dict[str, list[int]] = defaultdict(list)
        for i in [*range(ends, a), *range(b, high)]:
            own, tail = words[i][depth], words[i][depth + 1 :]
            tails[tail].append(i)
            if tail[:1] != own:
                near.pair(i, prefix + tail)
            near.pair(i, prefix + heavy + words[i][depth:])
        for tail, members in tails.items():
            if (j := near.place.get(prefix + heavy + tail)) is not None:
                members.append(j)
            if len(members) > 1:
                near.alike(members)


class Borders:
    """What is known of the nodes that span ranges, from the prefixes that both words at a border have, sorted."""

    def __init__(self, prefixes: list[str]):
        self.prefixes = sorted(prefixes)
        self.known: dict[str, str | None] = {}

    def heavy(self, node: str) -> str | None:
        """The character of the child that most borders run through; None if all run between the node's children."""
        if node not in self.known:
            low = bisect_left(self.prefixes, node)
            high = bisect_left(self.prefixes, True, low, key=lambda p: p[: len(node)] > node)
            low = bisect_right(self.prefixes, node, low, high)
            child = max(children(self.prefixes, low, high, len(node)), key=lambda x: x[1] - x[0], default=None)
            self.known[node] = None if child is None else self.prefixes[child[0]][len(node)]
        return self.known[node]


def spanning(words: list[str], above: list[int], borders: Borders) -> Iterator[tuple[int, str, int]]:
    """(word, merged terminal, depth or -1) for light words of nodes that span ranges. With a depth: words with equal terminal and
    depth are alike, and so is the word that the terminal is. With -1: the terminal, if it is a word, is near."""
    for i, w in enumerate(words):
        for depth in range(above[i] + 1):
            prefix = w[:depth]
            heavy = borders.heavy(prefix)
            if len(w) == depth:
                if heavy is not None:
                    yield i, prefix + heavy, -1
                continue
            own, tail = w[depth], w[depth + 1 :]
            if own == heavy:
                continue
            # Without a heavy child all are light; any character that is no child's will do to name the class of equal tails.
            yield i, prefix + ("\0" if heavy is None else heavy) + tail, depth
            if tail[:1] != own:
                yield i, prefix + tail, -1
            if heavy is not None:
                yield i, prefix + heavy + w[depth:], -1


_NEAR = "word string, n_near bigint, first struct<n: bigint, word: string>"


def neighbours(words: DataFrame, range_words: int = RANGE_WORDS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """word, n_near, first (count, negative, and word of the near word that comes first); words without a near one have no row.

    words: word, n; each word once, in a table that does not change.
    """
    ranges = max(1, min(most_ranges, -(-words.count() // range_words)))
    ordered = written(words.repartitionByRange(ranges, "word").withColumn("part", F.spark_partition_id()), "ranges")
    ends = sorted((r["low"], r["high"]) for r in ordered.groupBy("part").agg(F.min("word").alias("low"), F.max("word").alias("high")).collect())
    # Each range knows its neighbours' nearest words; all know what the two words at each border share. Two short strings a range.
    cut = [a[1][: shared(a[1], b[0])] for a, b in zip(ends, ends[1:], strict=False)]
    beside = {low: (cut[i - 1] if i else None, cut[i] if i < len(cut) else None) for i, (low, _) in enumerate(ends)}

    def within(group: pa.Table) -> tuple[list[str], list[int], list[int]]:
        rows = sorted(zip(group["word"].to_pylist(), group["n"].to_pylist(), strict=True))
        w = [x for x, _ in rows]
        both = [x for x in beside[w[0]] if x is not None]
        return w, [n for _, n in rows], [max((shared(x, c) for c in both), default=-1) for x in w]

    def inside(group: pa.Table) -> pa.Table:
        w, n, above = within(group)
        near = Near(w, n)
        merge(near, above)
        some = [i for i in range(len(w)) if near.n[i]]
        first = [{"n": near.first[i][0], "word": near.first[i][1]} for i in some]
        return pa.table({"word": [w[i] for i in some], "n_near": [near.n[i] for i in some], "first": first}, pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("first", pa.struct([("n", pa.int64()), ("word", pa.string())]))]))

    def across(group: pa.Table) -> pa.Table:
        w, n, above = within(group)
        found = list(spanning(w, above, Borders(cut)))
        kinds = pa.schema([("word", pa.string()), ("n", pa.int64()), ("key", pa.string()), ("depth", pa.int32())])
        return pa.table({"word": [w[i] for i, _, _ in found], "n": [n[i] for i, _, _ in found], "key": [k for _, k, _ in found], "depth": [d for _, _, d in found]}, kinds)

    grouped = ordered.groupBy("part")
    near = grouped.applyInArrow(inside, _NEAR)
    if cut:
        near = near.unionByName(_joined(written(grouped.applyInArrow(across, "word string, n bigint, key string, depth int"), "merged"), ordered))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("first").alias("first"))


def _joined(merged: DataFrame, words: DataFrame) -> DataFrame:
    """What merged terminals of nodes that span ranges coincide with, counted for each word."""
    ranked = lambda n, w: F.struct((-F.col(n)).alias("n"), F.col(w).alias("word")).alias("first")
    own = words.select(F.col("word").alias("key"), F.col("n").alias("key_n"))
    pairs = merged.where("depth < 0").join(own, "key")
    one = pairs.select("word", F.lit(1).cast("bigint").alias("n_near"), ranked("key_n", "key"))
    other = pairs.select(F.col("key").alias("word"), F.lit(1).cast("bigint").alias("n_near"), ranked("n", "word"))
    light = merged.where("depth >= 0")
    heavy = light.select("key", "depth").distinct().join(own, "key").select(F.col("key").alias("word"), F.col("key_n").alias("n"), "key", "depth")
    # Words of a class differ in one place, so it has no more members than there are letters.
    members = light.unionByName(heavy).groupBy("key", "depth").agg(F.sort_array(F.collect_list(ranked("n", "word"))).alias("m")).where(F.size("m") > 1)
    each = members.select("m", F.size("m").alias("size"), F.explode("m").alias("x"))
    alike = each.select(F.col("x.word").alias("word"), (F.col("size") - 1).cast("bigint").alias("n_near"), F.when(F.col("x.word") == F.col("m")[0]["word"], F.col("m")[1]).otherwise(F.col("m")[0]).alias("first"))
    return one.unionByName(other).unionByName(alike)


def forms(words: DataFrame, near: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: the near word that comes first, if it is at least twice as frequent."""
    rows = words.join(near, "word", "left")
    twice = -F.col("first.n") >= 2 * F.col("n")
    of = lambda c: F.when(twice, c)
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), of(F.col("first.word")).alias("form"), of(-F.col("first.n")).alias("form_n"))


def with_roots(rows: DataFrame) -> DataFrame:
    """rows with `root`: forms followed to the last. Steps double, and a form is twice as frequent as its word, so the rounds are few."""
    leads = written(rows.where("form is not null").select("word", F.col("form").alias("to")), "leads")
    while True:
        # Words without a form are roots and are not joined; `to` is unique on the right.
        on = leads.select(F.col("word").alias("to"), F.col("to").alias("further"))
        if not leads.select("to").join(on, "to", "left_semi").limit(1).count():
            break
        leads = written(leads.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to")), "leads")
    return rows.join(leads, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(docs: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """The columns that op12 returns: every word with its near words' number, its form and its root."""
    words = written(vocabulary(docs), "vocabulary")
    rows = written(forms(words, neighbours(words, range_words)), "forms")
    return with_roots(rows).select("word", "form", "root", "n", "n_near", "form_n")
