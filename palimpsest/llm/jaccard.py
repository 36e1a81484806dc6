"""Similarity join on word n-grams by chosen paths.

A document is the set of its runs of five words. In each of several runs a set is
split recursively: a path is a list of shared tokens, and the path's own hash picks
the next `FANOUT` tokens of the set, so similar sets follow the same paths. After
`DEPTH` tokens the sets of a path form a bucket. A bucket over `limit` sets is
split by further tokens; others are compared by brute force. `runs_for` says how many
runs bring the chance that two sets of similarity 0.8 meet in none below the target
(2 tokens a step: 0.03 a run, so four runs for 1e-5). The target is then measured: one
more run, over all documents, is a probe, and the share of its finds that are links
(by their texts) and that the runs before had missed estimates what they miss. Runs
are repeated, each taking in what it finds, until that share is within the target.

Within a bucket, sets are compared by a sketch of 128 bits (a pair of similarity
0.8 passes but for about 1e-6). Members reached from one another through passing
pairs form a candidate class; classes that share members are joined. Every class
then gets its members' texts, once each, and the exact similarity of all its pairs
decides the links. A class over `block` members is compared block by block in
separate tasks, so none has to hold all of it; as links are counted exactly, that work
grows with the square of the distinct sets of a class (copies cost nothing).

Documents with equal sets are represented by one of them throughout, the one of
least doc_id, so copies cost a row each, never a pair.

Defined cases: words are runs of characters other than ASCII white space; a text of one
to four words is one run of all of them; null text and text without words have no
set and no links; texts are read whole; repeated rows are copies of each other; a
null doc_id is answered but represents nobody with an id; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, distinct, hot_join, in_groups, mix, pick, word_hashes, written

WORDS, LEAST = 5, (4, 5)  # similarity of 4/5 at least
DEPTH, FANOUT, RECALL = 2, 2, 1 - 1e-5
SKETCH_BITS, SKETCH_DIFFERENT = 128, 30
_FIRST = -(1 << 63)
_U = np.uint64

_STEP = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row; of all of them where there are fewer."""
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1 if k else 0, np.uint64)
    for i in range(k):
        out += words[i : i + len(out)] * (_STEP[i % 5] + _U(i // 5 * 2))
    return mix(out)


def shingle_sets(texts: Iterable[str | bytes | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """For each text, or its UTF-8 bytes, the set of hashes of n words in a row, ascending. Short texts are hashed many at once."""
    for group in in_groups(t if isinstance(t, bytes) else (t or "").encode() for t in texts):
        words, start = word_hashes(b" ".join(group))
        grams = _grams(words, n)
        first = 0
        for end in np.searchsorted(start, np.cumsum([len(t) + 1 for t in group])).tolist():
            yield distinct(grams[first : end - n + 1] if end - first >= n else _grams(words[first:end], n))
            first = end


def shingles(text: str | bytes | None, n: int = WORDS) -> np.ndarray:
    return next(shingle_sets([text], n))


_SEEDS = mix(np.arange(1, 256, dtype=np.uint64) * _STEP[0])


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Per row the column numbers of the n least values, which are overwritten."""
    if values.shape[1] <= n:
        return np.tile(np.arange(values.shape[1]), (len(values), 1))
    rows, out = np.arange(len(values)), np.empty((len(values), n), np.int64)
    for i in range(n):
        out[:, i] = values.argmin(axis=1)
        values[rows, out[:, i]] = ~_U(0)
    return out


def extend(tokens: np.ndarray, paths: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """Each path followed by each of the tokens that its hash picks from the set; one row per path."""
    at = _least(mix(tokens[None, :] ^ paths[:, None]), fanout)
    return mix(paths[:, None] * _STEP[1] + tokens[at])


def miss_chance(similarity: float, depth: int = DEPTH, fanout: int = FANOUT) -> float:
    """Chance that two large sets share no path of a run: extinction of the branching process of the tokens that both pick."""

    def shared_picks(a: int, b: int) -> list[float]:
        """Chances of 0, 1, ... further shared picks once the sets have picked a and b; tokens come in order of hash."""
        out = [0.0] * (fanout + 1)
        if fanout in (a, b):
            return [1.0, *out[1:]]
        for chance, more, shift in ((similarity, shared_picks(a + 1, b + 1), 1), ((1 - similarity) / 2, shared_picks(a + 1, b), 0), ((1 - similarity) / 2, shared_picks(a, b + 1), 0)):
            for i, p in enumerate(more[: fanout + 1 - shift]):
                out[i + shift] += chance * p
        return out

    picks, gone = shared_picks(0, 0), 0.0
    for _ in range(depth):
        gone = sum(p * gone**i for i, p in enumerate(picks))
    return gone


def runs_for(recall: float = RECALL, depth: int = DEPTH, fanout: int = FANOUT) -> int:
    """Runs that find a pair of the least similarity with that chance."""
    return max(1, math.ceil(math.log(max(1 - recall, 1e-12)) / math.log(miss_chance(LEAST[0] / LEAST[1], depth, fanout))))


def leaves(tokens: np.ndarray, runs: int, depth: int = DEPTH, first: int = 0) -> np.ndarray:
    """Paths of so many runs, from run number `first` on; one row per run."""
    paths = _SEEDS[first : first + runs]
    for _ in range(depth):
        paths = extend(tokens, paths).ravel()
    return paths.reshape(runs, -1)


def leaf_paths(tokens: np.ndarray, runs: int, depth: int = DEPTH, first: int = 0) -> np.ndarray:
    """The distinct paths of those runs."""
    return distinct(leaves(tokens, runs, depth, first).ravel())


_SKETCH = mix(np.arange(1, SKETCH_BITS + 1, dtype=np.uint64) * _STEP[2]) | _U(1)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One bit of the least token under each of 128 hashes, as two words."""
    least = np.full(SKETCH_BITS, ~_U(0))
    for a in range(0, len(tokens), 128):  # a few at once stay in the cache
        least = np.minimum(least, (((tokens[a : a + 128] >> _U(1))[:, None] ^ _SKETCH) * _STEP[3]).min(axis=0))
    return np.packbits((mix(least) & _U(1)).astype(np.uint8)).view(np.uint64)


def _set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _sets(docs: DataFrame, runs: int, depth: int) -> DataFrame:
    """k1, k2 (which tell rows apart), set key, size, paths, the probe's paths and sketch of every document; no set: null."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("k1", "k2", "set", "n", "paths", "probe", "s1", "s2")}
            for k1, k2, t in zip(b["k1"], b["k2"], shingle_sets(b["text"]), strict=True):
                s = sketch(t).view(np.int64) if len(t) else (0, 0)
                found = leaves(t, runs + 1, depth).view(np.int64) if len(t) else None
                paths, probe = (distinct(found[:-1].ravel()), distinct(found[-1])) if len(t) else (None, None)
                values = (k1, k2, _set_key(t) if len(t) else None, len(t), paths, probe, s[0], s[1])
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
            yield out

    return arrow_map(docs.select("k1", "k2", "text"), run, "k1 bigint, k2 bigint, set binary, n bigint, paths array<bigint>, probe array<bigint>, s1 bigint, s2 bigint")


def linked(s1: np.ndarray, s2: np.ndarray, n: np.ndarray, most: int = SKETCH_DIFFERENT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Classes of members that reach one another through pairs of like sketches and like sizes, each with the member that reached
    it. A member once reached is not compared again."""
    left, out = np.arange(len(s1)), []
    while len(left):
        front, found, by = [left[0]], [left[:1]], [left[:1]]
        left = left[1:]
        while front and len(left):
            i = front.pop()
            ok = np.bitwise_count(s1[left] ^ s1[i]) + np.bitwise_count(s2[left] ^ s2[i]) <= most
            ok &= (5 * n[left] >= 4 * n[i]) & (5 * n[i] >= 4 * n[left])
            if ok.any():
                found.append(left[ok])
                by.append(np.full(len(found[-1]), i))
                front += left[ok].tolist()
                left = left[~ok]
        out.append((np.concatenate(found), np.concatenate(by)))
    return out


def _bucket_edges(members: DataFrame) -> DataFrame:
    """members: bucket, rep, n, s1, s2. (rep, root, partner) for each member of a class of two or more: the class's least member, and the
    one that it was compared with; a row per member, not per pair."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            out: dict[str, list] = {"rep": [], "root": [], "partner": []}
            for row in zip(b["bucket"], b["rep"], b["n"], b["s1"], b["s2"], strict=True):
                if row[0] not in held:
                    _close(held, out)
                    held.clear()
                held.setdefault(row[0], []).append(row[1:])
            yield out
        out = {"rep": [], "root": [], "partner": []}
        _close(held, out)
        yield out

    def _close(held, out):
        for rows in held.values():
            rep, n, s1, s2 = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            for c, by in linked(s1.view(np.uint64), s2.view(np.uint64), n):
                if len(c) > 1:
                    out["rep"] += rep[c].tolist()
                    out["root"] += [int(rep[c].min())] * len(c)
                    out["partner"] += rep[by].tolist()

    return arrow_map(members, run, "rep bigint, root bigint, partner bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of `edges` (a, b) is connected to.

    Alternates between linking each node's larger and its smaller neighbours to the least one, until every node hangs on
    its root; each round's edges are written. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = written(edges.where("a != b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == seen or not now["n"]:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        seen = now
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b a", "m b").where("a != b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").selectExpr("b a", "m b").unionByName(m.selectExpr("a", "m b")).where("a != b").distinct()
        edges = written(small, "edges")


def _exact_links(texts: DataFrame) -> DataFrame:
    """texts: task, x, y, side, rep, copies, z (compressed text), sorted by task and rep. Of blocks x and y of a class, per rep: (rep, links,
    root) with links counted in documents and root the least rep reached within the task."""

    def close(rows, out):
        if not rows:
            return
        x, y = rows[0][1], rows[0][2]
        rep = np.array([r[4] for r in rows], np.int64)
        copies = np.array([r[5] for r in rows], np.int64)
        side = np.array([r[3] for r in rows])
        unpack = zstandard.ZstdDecompressor()
        sets = list(shingle_sets(unpack.decompress(r[6]) for r in rows))
        size = np.array([len(s) for s in sets])
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        first = np.concatenate([[True], token[1:] != token[:-1]])
        # Only tokens of two members or more count; they are numbered in order.
        several = np.repeat(np.diff(np.append(np.flatnonzero(first), len(token))) > 1, np.diff(np.append(np.flatnonzero(first), len(token))))
        owner, number = owner[several], np.cumsum(first[several]) - 1
        total = int(number[-1]) + 1 if len(number) else 0
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if x == y else 1))
        both = np.zeros((len(a), len(b)), np.int32)
        step = max(1, (1 << 22) // len(rows))
        for c in range(0, total, step):
            i, j = np.searchsorted(number, [c, c + step])
            m = np.zeros((len(rows), step), np.float32)
            m[owner[i:j], number[i:j] - c] = 1
            np.add(both, m[a] @ m[b].T, out=both, casting="unsafe")  # exact: a step is far below 2 ** 24
        p, q = LEAST
        # |both| / (|a| + |b| - |both|) >= p / q, in whole numbers
        like = np.empty(both.shape, bool)
        for i in range(0, len(a), 256):  # few rows at once, for the sake of memory
            like[i : i + 256] = (p + q) * both[i : i + 256].astype(np.int64) >= p * (size[a][i : i + 256, None] + size[b][None, :])
        if x == y:
            np.fill_diagonal(like, False)
        links = np.zeros(len(rows), np.int64)
        links[a] += like @ copies[b]
        if x != y:
            links[b] += like.T @ copies[a]
        near = np.zeros((len(rows), len(rows)), bool)
        near[np.ix_(a, b)] = like
        near |= near.T
        root = np.full(len(rows), -1, np.int64)
        for i in range(len(rows)):  # ascending, so the first to reach a row is its least
            front = np.array([i])
            while root[i] < 0 or len(front):
                root[front] = rep[i] if root[i] < 0 else root[i]
                front = np.flatnonzero(near[front].any(axis=0) & (root < 0)) if len(front) else front
        for i in np.flatnonzero((links > 0) | (root != rep)).tolist():
            for name, v in zip(out, (int(rep[i]), int(links[i]), int(root[i])), strict=True):
                out[name].append(v)

    def run(batches):
        rows, task = [], None
        for b in batches:
            out: dict[str, list] = {"rep": [], "links": [], "root": []}
            for r in zip(*(b[c] for c in ("task", "x", "y", "side", "rep", "copies", "z")), strict=True):
                if r[0] != task:
                    close(rows, out)
                    rows, task = [], r[0]
                if not rows or rows[-1][4] != r[4]:  # equal rows bring a text twice
                    rows.append(r)
            yield out
        out = {"rep": [], "links": [], "root": []}
        close(rows, out)
        yield out

    return arrow_map(texts, run, "rep bigint, links bigint, root bigint")


def _texts(keyed: DataFrame, reps: DataFrame) -> DataFrame:
    """reps (rep, k1, k2 and more) with their texts; where rows are equal a rep comes more than once."""
    return keyed.select("k1", "k2", "text").join(reps, ["k1", "k2"])


def _split(keyed: DataFrame, reps: DataFrame, members: DataFrame, limit: int, most: int) -> DataFrame:
    """members (bucket, rep, n, s1, s2) with no bucket over limit: larger ones follow further tokens, up to `most` times; what
    is then still too large is dealt into blocks, each pair of which makes a bucket."""

    def follow(batches):
        for b in batches:
            out: dict[str, list] = {"bucket": [], "rep": [], "n": [], "s1": [], "s2": []}
            for rep, n, s1, s2, buckets, tokens in zip(*(b[c] for c in ("rep", "n", "s1", "s2", "buckets")), shingle_sets(b["text"]), strict=True):
                paths = np.unique(extend(tokens, np.array(buckets, np.int64).view(np.uint64))).view(np.int64).tolist()
                for name, v in zip(out, (paths, *([x] * len(paths) for x in (rep, n, s1, s2))), strict=True):
                    out[name] += v
            yield out

    columns = ["bucket", "rep", "n", "s1", "s2"]
    small = None
    for left in range(most, -1, -1):
        size = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        members = written(members.select(*columns).join(size, "bucket"), "members")
        fit = members.where(F.col("size") <= limit).select(*columns)
        small = fit if small is None else small.unionByName(fit)
        members = members.where(F.col("size") > limit)
        if members.isEmpty():
            return small
        if left:
            each = members.groupBy("rep", "n", "s1", "s2").agg(F.collect_set("bucket").alias("buckets")).join(reps.select("rep", "k1", "k2"), "rep")
            rows = _texts(keyed, each).select("rep", "n", "s1", "s2", "buckets", "text")
            members = arrow_map(rows, follow, "bucket bigint, rep bigint, n bigint, s1 bigint, s2 bigint").distinct()
    blocks = F.ceil(2 * F.col("size") / limit).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.xxhash64("bucket", F.least(own, k), F.greatest(own, k)))
    return small.unionByName(members.select(F.explode(pairs).alias("bucket"), "rep", "n", "s1", "s2"))


def _bucket_links(keyed: DataFrame, reps: DataFrame, paths: DataFrame, limit: int, extra_depth: int, name: str) -> DataFrame:
    """(rep, root, partner) of the classes within the buckets of paths (rep, n, s1, s2, bucket); see _bucket_edges."""
    sizes = paths.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("w1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("w2")).where("size > 1")
    # Buckets of the same members need one comparison.
    chosen = written(sizes.groupBy("size", "w1", "w2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "buckets")
    members = paths.join(chosen, "bucket")
    most, total = chosen.agg(F.max("size"), F.sum("size")).first()
    if (most or 0) > limit:
        members = _split(keyed, reps, members, limit, extra_depth)
    parts = _parts(keyed, (total or 0) // 500_000)
    dealt = members.select("bucket", "rep", "n", "s1", "s2").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return written(_bucket_edges(dealt), name)


def _parts(df: DataFrame, wanted: int) -> int:
    """Tasks for an exchange: as many as the session asks for, or as the data does."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, 100_000))


def _run_paths(keyed: DataFrame, reps: DataFrame, run: int, depth: int) -> DataFrame:
    """rep, n, s1, s2, bucket of one further run, from the texts."""

    def paths(batches):
        for b in batches:
            yield {**{c: b[c] for c in ("rep", "n", "s1", "s2")}, "paths": [leaf_paths(t, 1, depth, run).view(np.int64) for t in shingle_sets(b["text"])]}

    rows = _texts(keyed, reps.select("rep", "n", "s1", "s2", "k1", "k2")).select("rep", "n", "s1", "s2", "text")
    found = arrow_map(rows, paths, "rep bigint, n bigint, s1 bigint, s2 bigint, paths array<bigint>").select("rep", "n", "s1", "s2", F.explode("paths").alias("bucket"))
    return found.distinct()  # equal rows bring a text twice


def _true_links(keyed: DataFrame, reps: DataFrame, pairs: DataFrame) -> int:
    """How many of the pairs (rep, partner) are links, by their texts."""
    ends = pairs.select(F.xxhash64("rep", "partner").alias("class"), F.explode(F.array("rep", "partner")).alias("rep"), F.lit(1).alias("blocks")).join(reps.select("rep", "copies", "k1", "k2"), "rep")
    texts = _compressed(_texts(keyed, written(ends, "ends"))).selectExpr("class task", "0 x", "0 y", "0 side", "rep", "copies", "z")
    exact = _exact_links(texts.repartition(_parts(keyed, 0), "task").sortWithinPartitions("task", "rep"))
    return exact.where("links > 0").count() // 2


def _classes(keyed: DataFrame, reps: DataFrame, runs: int, depth: int, limit: int, extra_depth: int, recall: float) -> DataFrame:
    """(node, root) of the candidate classes: those of the first runs, and of further ones until one finds next to no new link."""
    of = lambda paths: reps.select("rep", "n", "s1", "s2", F.explode(paths).alias("bucket"))
    classes = written(components(_bucket_links(keyed, reps, of("paths"), limit, extra_depth, "linked").selectExpr("rep a", "root b")), "classes")
    paths = of("probe")
    for run in range(runs, len(_SEEDS)):
        found = _bucket_links(keyed, reps, paths, limit, extra_depth, "probe")
        root = lambda c: classes.selectExpr(f"node {c}", f"root {c}_root")  # noqa: E731, B023
        seen = found.join(root("rep"), "rep", "left").join(root("partner"), "partner", "left").select("rep", "root", "partner", F.coalesce("rep_root", "rep").alias("a"), F.coalesce("partner_root", "partner").alias("b"))
        new = written(seen.where("a != b").distinct(), "missed")
        if new.isEmpty():
            break
        # Sketches also pass pairs below the least similarity; only links count as missed.
        missed, n = _true_links(keyed, reps, new.select("rep", "partner").distinct()), found.where("rep != partner").count()
        classes = written(components(classes.selectExpr("node a", "root b").unionByName(new.select("a", "b"))), "classes")
        if missed <= (1 - recall) * n:
            break
        if run + 1 == len(_SEEDS):
            raise RuntimeError(f"after {run + 1} runs {missed} of {n} links of the last one were new, more than {1 - recall:g}")
        paths = written(_run_paths(keyed, reps, run + 1, depth), "paths")
    return classes


def similar(docs: DataFrame, recall: float = RECALL, runs: int | None = None, depth: int = DEPTH, limit: int = 50_000, extra_depth: int = 6, block: int = 3000, block_shingles: int = 2_000_000) -> DataFrame:
    """One row per document: k1, k2 (doc_id, null as the least number, and hash of its text), class_k1 (of the documents with
    an equal set, the least k1), group_k1 and group_k2 (the first document of those connected by links), n_links (other
    documents of similarity 0.8 or more). A document without a set is alone. runs: those before the first probe, by default as recall asks for."""
    runs = runs or runs_for(recall, depth)
    keyed = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(_FIRST)).alias("k1"), F.xxhash64("text").alias("k2"), "text")
    rows = written(_sets(keyed, runs, depth), "sets")
    same = [F.any_value(c).alias(c) for c in ("n", "s1", "s2", "paths", "probe")]
    reps = rows.where("set is not null").groupBy("set").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2")).alias("one"), *same)
    reps = written(reps.select("set", "copies", "one.*", "n", "s1", "s2", "paths", "probe").withColumn("rep", F.monotonically_increasing_id()), "reps")
    classes = _classes(keyed, reps, runs, depth, limit, extra_depth, recall)
    in_class = classes.selectExpr("node rep", "root class").unionByName(classes.selectExpr("root rep", "root class").distinct())
    in_class = written(in_class.join(reps.select("rep", "copies", "n", "k1", "k2"), "rep"), "in_class")
    # Texts of the members, each once; blocks of large classes meet in pairs.
    counted = in_class.groupBy("class").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    counted = written(counted.join(in_class.groupBy("class").agg(F.sum("n").alias("shingles"), F.count("*").alias("size")), "class"), "counted")
    texts = _compressed(_texts(keyed, hot_join(in_class, counted, ["class"], "size").select("rep", "copies", "k1", "k2", "class", "blocks")))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y"), (k < own).cast("int").alias("side")))
    dealt = texts.select("rep", "copies", "z", "class", F.explode(meets).alias("m")).select(F.xxhash64("class", "m.x", "m.y").alias("task"), "class", "m.x", "m.y", "m.side", "rep", "copies", "z")
    parts = _parts(keyed, (counted.agg(F.sum(F.col("blocks") * F.col("shingles"))).first()[0] or 0) // block_shingles)
    exact = written(_exact_links(dealt.repartition(parts, "task").sortWithinPartitions("task", "class", "rep").drop("class")), "links")
    total = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    group = written(components(exact.where("rep != root").selectExpr("rep a", "root b")), "groups").selectExpr("node rep", "root")
    known = reps.select("set", "rep", "k1", "k2", "copies").join(total, "rep", "left").join(group, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    head = known.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("head"))
    per_set = known.join(head, "root").select("set", F.col("k1").alias("class_k1"), F.col("head.k1").alias("group_k1"), F.col("head.k2").alias("group_k2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("k1", "k2", "set").join(per_set, "set", "left")
    return out.select("k1", "k2", F.coalesce("class_k1", "k1").alias("class_k1"), F.coalesce("group_k1", "k1").alias("group_k1"), F.coalesce("group_k2", "k2").alias("group_k2"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("set").isNotNull().alias("has_set"))


def _compressed(texts: DataFrame) -> DataFrame:
    """texts (rep, copies, class, blocks, text) with z for text."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield {**{c: b[c] for c in ("rep", "copies", "class", "blocks")}, "z": [pack.compress(t.encode()) for t in b["text"]]}

    return arrow_map(texts.select("rep", "copies", "class", "blocks", "text"), run, "rep bigint, copies bigint, class bigint, blocks int, z binary")


def similar_digest(docs: DataFrame, **how) -> DataFrame:
    """The columns that op5 returns, one row per document: doc_id, class_id, group_id, n_links."""
    back = lambda c: F.when(F.col(c) != _FIRST, F.col(c))
    return similar(docs, **how).select(back("k1").alias("doc_id"), back("class_k1").alias("class_id"), back("group_k1").alias("group_id"), "n_links")


def one_of_each_group(docs: DataFrame, **how) -> DataFrame:
    """docs without those that links connect with an earlier one; documents without a set all stay. Columns as they were."""
    found = similar(docs, **how)
    stay = found.where("not has_set or (k1 = group_k1 and k2 = group_k2)").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "has_set").distinct()
    row = F.struct(*docs.columns).alias("row")  # so no name of its columns can clash
    keyed = docs.select(row, F.coalesce("doc_id", F.lit(_FIRST)).alias("_k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k2"))
    kept = keyed.join(stay, ["_k1", "_k2"])
    # Equal rows are copies, too.
    once = kept.where("has_set").dropDuplicates(["_k1", "_k2"]).unionByName(kept.where("not has_set"))
    return once.select("row.*")
