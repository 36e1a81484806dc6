"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters, four at a time, one for each language. It is counted on
every document that the labels trust, none left out, so the counts grow with the
corpus. Discounts, continuation counts and back-off weights are aggregations and
joins of count tables.

Scoring joins counts by shards: documents are dealt into blocks of bounded size, rows of a frequent id (or of
none) into several;
each block asks once for each of its distinct n-grams; these requests meet the
model's shards in a join on the n-gram; the answers go back to the block, where
every character of its documents is looked up. No task holds the whole model.

A document is kept if its perplexity is at most the `quantile` of what trusted documents
of its language have under a model that was not counted on them: they are dealt by their text
into folds, copies together, and each fold has a model of the other folds beside the whole one.

Defined cases: a character outside the 16-bit range counts as one of a kind; null
and empty text have no perplexity and are not kept; a language (null is one of its
own) without trusted text has no model, so its documents have no perplexity and are
kept; one whose trusted texts share a fold takes the quantile of their own perplexity; texts are read whole; repeated rows are answered once each and count each
time; labels that repeat count once; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, pick, written

ORDER = 4
_BITS, _START, _OTHER = np.uint64(16), 2, 0xFFFF
_SLICE = 1 << 20
#: Bytes of text in a block.
BLOCK_BYTES = 32 << 20
#: Trusted documents are judged by a model of the other folds, whose key is the language's plus _HELD for each fold up to the one left out.
FOLDS, _HELD = 2, 1 << 40
#: Of 30 bits for a language's key; the n-gram's length is added.
_LANG = "cast(crc32(cast(coalesce(concat('=', lang), '') as binary)) * 8 as bigint)"


def codes(text: str) -> np.ndarray:
    """The text's four-character n-grams, one ending at each character, as 64-bit numbers; the text's start is marked."""
    u = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), _OTHER).astype(np.uint64)
    u = np.concatenate([np.full(ORDER - 1, _START, np.uint64), u])
    return u[:-3] << np.uint64(48) | u[1:-2] << np.uint64(32) | u[2:-1] << _BITS | u[3:]


def fold_of(text: bytes) -> int:
    """The fold of a trusted text; copies share it."""
    return zlib.crc32(text) % FOLDS


def without(m: int, fold: int) -> int:
    """Key of the language's model that leaves a fold out."""
    return m + _HELD * (fold + 1)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, m (the language's key), h (a hash of the text) and z (compressed text): what is exchanged instead of texts."""

    def run(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield {**{x: b[x] for x in b if x != "text"}, "z": [c.compress(t.encode()) for t in b["text"]]}

    rows = pick(docs, "doc_id", "lang", "text").select("doc_id", F.expr(_LANG).alias("m"), F.xxhash64("text").alias("h"), "text")
    return arrow_map(rows, run, "doc_id bigint, m bigint, h bigint, z binary")


class _Counts:
    """Distinct codes and their numbers for each language, gathered a slice at a time."""

    def __init__(self):
        self.waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        self.size: dict[int, int] = defaultdict(int)
        self.done: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, m: int, c: np.ndarray) -> None:
        self.waiting[m].append(c)
        self.size[m] += len(c)
        if self.size[m] >= _SLICE:
            self.settle(m)

    def settle(self, m: int) -> None:
        c, n = np.unique(np.concatenate(self.waiting[m]), return_counts=True)
        if m in self.done:
            old, times = self.done[m]
            c, back = np.unique(np.concatenate([old, c]), return_inverse=True)
            n = np.bincount(back, np.concatenate([times, n])).astype(np.int64)
        self.done[m] = c, n
        self.waiting[m], self.size[m] = [], 0

    def all(self):
        for m in list(self.waiting):
            if self.waiting[m]:
                self.settle(m)
        return self.done.items()


@dataclass
class Dealing:
    """How rows are dealt into blocks: by doc_id, and rows of an id that would fill several blocks (null is one) by their text as well."""

    blocks: int
    hot: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> Dealing:
        """Ids that are split have more than 4 blocks' rows and 1 in 100,000 of all, so they are few, whatever the data."""
        size, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        blocks = max(1, -(-(size or 0) // block_bytes))
        rows = max(1, n // blocks)
        hot = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > max(4 * rows, n // 100_000))
        return cls(blocks, written(hot.select(F.col("doc_id").alias("hot_id"), F.ceil(F.col("c") / rows).cast("int").alias("parts")), "hot"))

    def _block(self, part: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id", part), F.lit(self.blocks)).cast("int").alias("block")

    def _with_parts(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.hot), F.col("doc_id").eqNullSafe(F.col("hot_id")), "left")

    def rows(self, docs: DataFrame, *columns: str) -> DataFrame:
        """docs (doc_id, h, a hash of the text, and columns) with their block."""
        part = F.pmod("h", F.coalesce("parts", F.lit(1)).cast("bigint")).cast("int")
        return self._with_parts(docs).select(self._block(part), "doc_id", *columns)

    def ids(self, ids: DataFrame, *columns: Column) -> DataFrame:
        """ids (doc_id), each in every block that has rows of it."""
        each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        return self._with_parts(ids).select("doc_id", each.alias("part")).select(self._block(F.col("part")), "doc_id", *columns)


def block_grams(docs: DataFrame, good: DataFrame, dealing: Dealing) -> DataFrame:
    """block, m (model's key plus length), g, c: each n-gram that scoring a block looks at, once, and how often it ends in
    the block's trusted documents (full length only, else 0); in block -1, what models count but no document of the block
    looks at. One exchange by block brings documents and trusted ids together."""
    none = F.lit(None)
    ids = dealing.ids(good, F.lit(0).alias("kind"), none.cast("bigint").alias("m"), none.cast("binary").alias("z"))
    texts = dealing.rows(packed(docs).withColumn("kind", F.lit(1)), "kind", "m", "z")
    rows = ids.unionByName(texts).repartitionById(dealing.blocks, F.col("block")).sortWithinPartitions("doc_id", "kind")

    def run(batches):
        z, seen, learnt = zstandard.ZstdDecompressor(), _Counts(), _Counts()
        trusted = block = None
        for b in batches:
            for block, doc_id, kind, m, t in zip(b["block"], b["doc_id"], b["kind"], b["m"], b["z"], strict=True):  # noqa: B007
                if kind == 0:
                    trusted = doc_id
                elif text := z.decompress(t):
                    c = codes(text.decode())
                    seen.add(m, c)
                    if doc_id is not None and doc_id == trusted:
                        learnt.add(m, c)
                        mine = fold_of(text)
                        seen.add(without(m, mine), c)
                        for k in range(FOLDS):
                            if k != mine:
                                learnt.add(without(m, k), c)
        counts = dict(learnt.all())
        for m, (c, _) in seen.all():
            times = np.zeros(len(c), np.int64)
            if m in counts:
                own, n = counts[m]
                at = np.minimum(np.searchsorted(c, own), len(c) - 1)
                hit = c[at] == own
                times[at[hit]] = n[hit]
                counts[m] = own[~hit], n[~hit]
            yield _gram_rows(block, m + ORDER, c, times)
            for n, g in _shorter(c).items():
                yield _gram_rows(block, m + n, g, np.zeros(len(g), np.int64))
        for m, (own, n) in counts.items():
            if len(own):
                yield _gram_rows(-1, m + ORDER, own, n)

    return arrow_map(rows, run, "block int, m bigint, g bigint, c bigint")


def _gram_rows(block: int, m: int, g: np.ndarray, c: np.ndarray) -> dict[str, object]:
    return {"block": np.full(len(g), block, np.int32), "m": np.full(len(g), m, np.int64), "g": g.view(np.int64), "c": c}


def _shorter(c: np.ndarray) -> dict[int, np.ndarray]:
    """The shorter n-grams that backing off from the codes c looks at: all ends, and all that precede an end's last character; the empty one, too."""
    out = {0: np.zeros(1, np.uint64)}
    for n in range(1, ORDER):
        mask = np.uint64((1 << 16 * n) - 1)
        out[n] = np.unique(np.concatenate([c & mask, (c >> _BITS) & mask]))
    return out


def _suffix(n: int):
    """The last n characters of a code."""
    return F.col("g").bitwiseAND(F.lit((1 << 16 * n) - 1 if n < 4 else -1))


def _context(g="g"):
    return F.shiftrightunsigned(g, 16)


def train(counts: DataFrame) -> DataFrame:
    """m (language's key plus length), g, logp, bow from counts of full-length n-grams: log probability of the n-gram's last
    character, and log weight of what follows the n-gram unseen. Either may be null. Length 0 has the uniform distribution."""
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = written(tables[n + 1].groupBy("m", _suffix(n).alias("g")).agg(F.count("*").alias("c")), "counts")
    out, below = None, None
    for n in range(1, ORDER + 1):
        t = tables[n]
        seen = t.groupBy("m").agg(*(F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
        discount = [F.when(F.col(f"n{k}") > 0, F.least(F.lit(float(k)), F.greatest(F.lit(0.1), k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1))))).otherwise(F.lit(0.5)).alias(f"d{k}") for k in (1, 2, 3)]
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = t.join(F.broadcast(seen.select("m", *discount)), "m").select("m", "g", "c", d.alias("d"), _context().alias("ctx"))
        context = cut.groupBy("m", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        rows = cut.join(context, ["m", "ctx"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        if n == 1:
            # One more than the characters seen: any other character has an equal share.
            rows = rows.join(F.broadcast(t.groupBy("m").agg((1 / (F.count("*") + 1)).alias("under"))), "m")
            flat = rows.groupBy("m").agg(F.first("under").alias("u"), F.first("gamma").alias("w")).select("m", F.lit(0).cast("bigint").alias("g"), F.log("u").alias("logp"), F.log("w").alias("bow"))
            out = flat
        else:
            rows = rows.withColumn("s", _suffix(n - 1)).join(below.select("m", F.col("g").alias("s"), F.exp("logp").alias("under")), ["m", "s"])
        probability = written(rows.select("m", "g", F.log(own + F.col("gamma") * F.col("under")).alias("logp")), "probabilities")
        weight = context.select("m", F.col("ctx").alias("g"), F.log("gamma").alias("bow")).where(F.lit(n > 1))
        below, weights = probability, weight
        # Weights belong to the n-grams one shorter.
        out = out.unionByName(probability.select((F.col("m") + n).alias("m"), "g", "logp", F.lit(None).cast("double").alias("bow")))
        out = out.unionByName(weights.select((F.col("m") + n - 1).alias("m"), "g", F.lit(None).cast("double").alias("logp"), "bow"))
    return written(out.groupBy("m", "g").agg(F.max("logp").cast("float").alias("logp"), F.max("bow").cast("float").alias("bow")), "model")


class _Block:
    """A block's answers: log probability of any four characters in its documents, by back-off once for each, then by table."""

    def __init__(self, answers: dict[int, list]):
        self.tables = {}
        for m, rows in answers.items():
            g, logp, bow = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(g)
            self.tables[m] = g[order], logp[order], bow[order]
        self.slots: dict[int, list] = {}

    def _of(self, m: int, g: np.ndarray, column: int) -> np.ndarray:
        if m not in self.tables:
            return np.full(len(g), np.nan)
        keys = self.tables[m][0]
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        return np.where(keys[at] == g, self.tables[m][column][at], np.nan)

    def backed_off(self, m: int, c: np.ndarray) -> np.ndarray:
        zero = np.zeros(len(c), np.uint64)
        value = self._of(m, zero, 1) + self._of(m, zero, 2)  # a character never seen
        for n in range(1, ORDER + 1):
            g = c & np.uint64((1 << 16 * n) - 1)
            if n > 1:
                weight = self._of(m + n - 1, g >> _BITS, 2)
                value = value + np.where(np.isnan(weight), 0, weight)
            own = self._of(m + n, g, 1)
            value = np.where(np.isnan(own), value, own)
        return value

    def learn(self, m: int, c: np.ndarray) -> None:
        """Places distinct codes in hash tables of growing multipliers; what collides goes to the next."""
        value, self.slots[m] = self.backed_off(m, c).astype(np.float32), []
        bits = max(10, int(len(c) * 8).bit_length())
        multiplier = 0x9E3779B97F4A7C15
        while len(c):
            at = (c * np.uint64(multiplier)) >> np.uint64(64 - bits)
            keys, values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
            keys[at], values[at] = c, value
            self.slots[m].append((multiplier, bits, keys, values))
            rest = keys[at] != c
            c, value = c[rest], value[rest]
            multiplier = (multiplier * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1

    def logps(self, m: int, c: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(c), np.float32), None
        for multiplier, bits, keys, values in self.slots.get(m, ()):
            mine = c if left is None else c[left]
            at = (mine * np.uint64(multiplier)) >> np.uint64(64 - bits)
            hit = keys[at] == mine
            if left is None:
                out = np.where(hit, values[at], 0)
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = values[at[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out


def score(docs: DataFrame, grams: DataFrame, model: DataFrame, dealing: Dealing, good: DataFrame | None = None) -> DataFrame:
    """doc_id, m, chars, logp, held_out: the language's key, number of characters and mean log probability of one (null: no model,
    or no character), under the whole model and, for ids in good, under the model without the text's fold.

    grams: of block_grams, with the same documents and dealing."""
    none = F.lit(None)
    answers = grams.where("block >= 0").join(model, ["m", "g"]).select("block", F.lit(0).alias("kind"), "m", "g", "logp", "bow", none.cast("bigint").alias("doc_id"), none.cast("binary").alias("z"))
    texts = dealing.rows(packed(docs), F.lit(2).alias("kind"), "m", none.cast("bigint").alias("g"), none.cast("float").alias("logp"), none.cast("float").alias("bow"), "z")
    both = answers.unionByName(texts)
    if good is not None:
        both = both.unionByName(dealing.ids(good, F.lit(1).alias("kind")), allowMissingColumns=True)

    def run(batches):
        z, answers, block, trusted = zstandard.ZstdDecompressor(), defaultdict(list), None, set()
        for b in batches:
            kind = np.array(b["kind"])
            first, texts = np.searchsorted(kind, [1, 2]).tolist()
            trusted.update(b["doc_id"][first:texts])
            if first:
                ms = np.array(b["m"][:first], np.int64)
                g = np.array(b["g"][:first], np.int64).view(np.uint64)
                logp, bow = (np.array([np.nan if v is None else v for v in b[c][:first]]) for c in ("logp", "bow"))
                for m in np.unique(ms).tolist():
                    mine = ms == m
                    answers[m].append((g[mine], logp[mine], bow[mine]))
            if texts < len(kind):
                if block is None:
                    block, answers = _Block(answers), None
                yield _scored(block, z, b, texts, trusted)

    def _scored(block, z, b, first, trusted):
        raw = [z.decompress(t) for t in b["z"][first:]]
        texts, ids, keys = [t.decode() for t in raw], b["doc_id"][first:], b["m"][first:]
        held = [without(m, fold_of(t)) if i in trusted else None for i, m, t in zip(ids, keys, raw, strict=True)]
        return {"doc_id": ids, "m": keys, "chars": [len(t) for t in texts], "logp": _means(block, texts, keys), "held_out": _means(block, texts, held)}

    def _means(block, texts, keys):
        by_key, mean = defaultdict(list), [None] * len(texts)
        for i, m in enumerate(keys):
            if texts[i] and m in block.tables:
                by_key[m].append(i)
        for m, those in by_key.items():
            group, size = [], 0
            for i in [*those, None]:
                if group and (i is None or size + len(texts[i]) > _SLICE):
                    c = np.concatenate([codes(texts[j]) for j in group])
                    if m not in block.slots:
                        t = block.tables.get(m + ORDER)
                        block.learn(m, t[0] if t else np.zeros(0, np.uint64))
                    value = block.logps(m, c)
                    unknown = value == 0  # no four characters that the model has: back off one by one
                    if unknown.any():
                        u, back = np.unique(c[unknown], return_inverse=True)
                        value[unknown] = block.backed_off(m, u)[back]
                    ends = np.cumsum([len(texts[j]) for j in group])
                    sums = np.diff(np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)[ends - 1]]))
                    for j, s in zip(group, sums.tolist(), strict=True):
                        mean[j] = s / len(texts[j])
                    group, size = [], 0
                if i is not None:
                    group.append(i)
                    size += len(texts[i])
        return mean

    rows = both.repartitionById(dealing.blocks, F.col("block")).sortWithinPartitions("kind").drop("block")
    return arrow_map(rows, run, "doc_id bigint, m bigint, chars bigint, logp double, held_out double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good and harmless."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """doc_id, n_chars, perplexity, threshold, kept; one row per document."""
    good = trusted_ids(labels)
    dealing = Dealing.of(docs)
    grams = written(block_grams(docs, good, dealing), "grams")
    counts = grams.where("c > 0").groupBy((F.col("m") - ORDER).alias("m"), "g").agg(F.sum("c").alias("c"))
    model = train(written(counts, "counts"))
    scored = written(score(docs, grams.drop("c"), model, dealing, good), "scores").withColumn("perplexity", F.exp(-F.col("logp")))
    unseen, own = (F.percentile_approx(p, quantile, 10_000) for p in (F.exp(-F.col("held_out")), F.col("perplexity")))
    limits = scored.join(good, "doc_id", "left_semi").groupBy("m").agg(F.coalesce(unseen, own).alias("threshold"))
    rows = scored.join(F.broadcast(limits), "m", "left")
    kept = F.when(F.col("chars") == 0, F.lit(False)).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return rows.select("doc_id", F.col("chars").alias("n_chars"), "perplexity", "threshold", kept.alias("kept"))
