"""Document fingerprints by winnowing.

Every run of `k` code points is hashed; of each `window` consecutive hashes the
least is kept, the rightmost one at ties, with its position. Two texts that share
`k + window - 1` code points in a row are sure to share a kept hash, wherever
the stretch lies. A text of fewer than `8 * window` hashes has a window of an eighth
of them, so that short texts keep several; what a longer window keeps, a shorter one
keeps as well, so the guarantee stands.

Defined cases: null text is read as empty and has an empty fingerprint; a text
shorter than `k` is hashed whole, one with fewer hashes than a window keeps the
least of them; equal texts have equal fingerprints. Two empty fingerprints are
alike (1), an empty and another one are not (0). Texts are read whole. Rows with
equal doc_id follow each other by a hash of their text, a null doc_id comes first.
Other columns are ignored.

The next document's text has to meet this one's, so texts are exchanged once, by
ranges of (doc_id, hash of text): rows of one id, or without any, are split as well.
A task reads its sorted range as a stream, two texts at a time; beyond
`_MOST_PARTS` ranges they grow with the data, its memory does not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from palimpsest.llm.common import arrow_map, kgram_hashes, pick, sliding

K, WINDOW = 24, 64
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, in order of position."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(text) < k:
        return np.array([xxhash.xxh64_intdigest(text)], np.uint64), np.zeros(1, np.uint64)
    h = kgram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    # Upper half: hash. Lower half: smaller the further right, so that the least value is the rightmost least hash.
    order = (h & _HIGH) | (_LOW - np.arange(len(h), dtype=np.uint64))
    at = _LOW - (sliding(order, max(1, min(window, len(h) // 8))) & _LOW)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return h[at], at


def rendered(hashes: np.ndarray, at: np.ndarray) -> str:
    """Each kept hash in hexadecimal with its position."""
    return " ".join(f"{h:016x}@{p}" for h, p in zip(hashes.tolist(), at.tolist(), strict=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes, positions; one row per document."""

    def run(batches):
        for b in batches:
            found = [winnow(t, k, window) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "hashes": [h.view(np.int64) for h, _ in found], "positions": [p.view(np.int64) for _, p in found]}

    return arrow_map(pick(docs, "doc_id", "text"), run, "doc_id bigint, hashes array<bigint>, positions array<bigint>")


_FIRST = -(1 << 63)
#: Partitions at most; beyond, each is larger and its sort spills.
_MOST_PARTS = 20_000


def in_order(docs: DataFrame, partition_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, text, tail: partitions of consecutive documents, sorted; after each partition's own rows those that follow its last one (`tail`).

    The cuts are quantiles of doc_id, so a recomputed task gets the same rows. Only the cuts and the first key of each
    partition, a few numbers each, reach the driver.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_FIRST)).alias("k"), F.xxhash64("text").alias("h"))
    size = keyed.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    n = max(1, min(size["n"], _MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // partition_bytes))))
    cuts = sorted(keyed.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("c")).first()["c"]) if n > 1 else []
    keyed = keyed.withColumn("part", _rank(cuts) if cuts else F.lit(0))
    first = sorted((r["part"], *r["at"]) for r in keyed.groupBy("part").agg(F.min(F.struct("k", "h")).alias("at")).collect())
    follows = spark.createDataFrame([(*first[(i + 1) % len(first)][1:], p) for i, (p, _, _) in enumerate(first)], "k bigint, h bigint, before int")
    follows = follows.groupBy("k", "h").agg(F.collect_list("before").alias("before"))
    own = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")))
    tails = F.transform(F.coalesce("before", F.array().cast("array<int>")), lambda p: F.struct(p.alias("part"), F.lit(True).alias("tail")))
    rows = keyed.join(F.broadcast(follows), ["k", "h"], "left").select("doc_id", "text", "k", "h", F.explode(F.concat(own, tails)).alias("x")).select("doc_id", "text", "k", "h", "x.part", "x.tail")
    return rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("tail", "k", "h", "text").select("doc_id", "text", "tail")


def _rank(cuts: list[int]):
    """The range of a row (k, h) between sorted cuts of k; a cut that stands r times has r ranges by h, which spreads evenly."""
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf(IntegerType())
    def rank(k: pd.Series, h: pd.Series) -> pd.Series:
        below, upto = (np.searchsorted(bounds, k.to_numpy(), side).astype(np.uint64) for side in ("left", "right"))
        high = (h.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        inside = (high * (upto - below) >> np.uint64(32)) + np.uint64(1)
        return pd.Series((below + np.where(upto > below, inside, np.uint64(0))).astype(np.int32))

    return rank("k", "h")


def with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """The columns that op9 returns: fingerprints of each text and of its edited text, and their likeness."""

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(b["doc_id"], b["text"], b["tail"], strict=True)

        held, out = None, []
        for doc_id, text, tail in rows():
            fp = winnow(text, k, window)
            if held:
                out.append(_compared(*held, text, fp[0], k, window))
                if len(out) >= 500:
                    yield _columns(out)
                    out = []
            held = None if tail else (doc_id, text, fp)
            if tail:
                for _ in rows():  # rows of equal id beyond the one that follows
                    pass
                break
        if out:
            yield _columns(out)

    names = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(in_order(pick(docs, "doc_id", "text")), run, names)


_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _columns(rows: list[tuple]) -> dict[str, list]:
    return dict(zip(_NAMES, map(list, zip(*rows, strict=True)), strict=True))


def _compared(doc_id, text: str, fp, following: str, following_hashes, k: int, window: int) -> tuple:
    n = len(text)
    edited = text[: n - n // 4] + following[: n // 4]
    efp = winnow(edited, k, window)
    return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), rendered(*fp), rendered(*efp), likeness(fp[0], efp[0]), likeness(fp[0], following_hashes))
