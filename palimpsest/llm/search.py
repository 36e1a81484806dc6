"""Ranked lexical search over document shards.

The index is a table with a row per shard of some thousand documents: its terms, sorted, and for each term its documents
(CSR postings: starts, documents) with a precomputed integer impact. Queries go to the shards, not postings to queries: a
task takes a shard, adds weight x impact term by term into one dense accumulator a query, picks the shard's best by
argpartition, ties included, and Spark merges the shards' best. What a term weighs depends on how many documents hold
it, so that number is summed over the shards first, for the queries' terms only; an impact depends on the document
and on the totals N and L alone, so it is stored.

Terms are the maximal runs of ASCII letters, ASCII digits and code points beyond ASCII; only A-Z is lower-cased. All numbers but
the logarithm are integers.

Defined cases: null and empty texts have no terms, are no documents for N, and are never found; an item without terms finds
nothing; rows with equal item_id are one item with the terms of all of them (a null id is an id); repeated documents are found
each; of equal scores the smaller doc_id comes first, a null one last; texts are read whole; other columns are ignored.

Memory: a task holds the shards of one Arrow batch, which is bounded in bytes, one row group of some shards, and an accumulator for the
documents of one shard, however much of the index it reads. Queries are taken in blocks of at most `block_terms` (item, term) pairs, each in one pass over the index, so neither
the driver nor a task holds more than a block of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, pick, written

TOP = 10
#: Text of a shard in bytes, and documents at most; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 4 << 20, 8192
#: Shards that are written and read at once.
GROUP_SHARDS = 4
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms as they are, A-Z lower-cased, any other ASCII as a space. Bytes of characters beyond ASCII are all over 0x7F.
_TERM_BYTES = bytes(c if c > 0x7F or bytes([c]).isdigit() or c in _LETTERS else c + 32 if c + 32 in _LETTERS and c < 0x60 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The text's terms in UTF-8, in order, repeats included."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def impact(tf, m):
    """What a document whose length counts as m gives for a term that occurs tf times."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def totals(docs: DataFrame) -> tuple[int, int]:
    """N, documents with a term, and L, all terms."""

    def run(batches):
        for b in batches:
            n = [len(terms_of(t)) for t in b["text"]]
            yield {"documents": [sum(map(bool, n))], "terms": [sum(n)]}

    got = arrow_map(pick(docs, "text"), run, "documents bigint, terms bigint").agg(F.sum("documents"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


_INDEX = "documents bigint, ids binary, no_id binary, terms array<binary>, starts binary, docs binary, impacts binary"


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, int]:
    """The index as a table in the shared folder, and N."""
    n_docs, n_terms = totals(docs)

    def run(batches):
        ids: list[int | None] = []
        found: list[list[bytes]] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                if terms := terms_of(text):
                    ids.append(doc_id)
                    found.append(terms)
                    size += len(text)
                if size >= shard_bytes or len(ids) >= shard_docs:
                    yield _shard(ids, found, n_docs, n_terms)
                    ids, found, size = [], [], 0
        if ids:
            yield _shard(ids, found, n_docs, n_terms)

    return written(arrow_map(pick(docs, "doc_id", "text"), run, _INDEX), "postings", group_rows=GROUP_SHARDS), n_docs


def _shard(ids: list[int | None], found: list[list[bytes]], n_docs: int, n_terms: int) -> dict[str, list]:
    sizes = np.array([len(x) for x in found], np.int64)
    # Python's integers, since the product may pass 64 bits.
    lengths = np.array([10 + 90 * int(n) * n_docs // n_terms for n in sizes], np.int64)
    coded = pa.array([t for x in found for t in x], pa.binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key, tf = np.unique(place[coded.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, doc = np.divmod(key, len(ids))
    starts = np.searchsorted(term, np.arange(len(order) + 1))
    raw = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    return {
        "documents": [len(ids)], "ids": [raw([x or 0 for x in ids], np.int64)], "no_id": [raw([i for i, x in enumerate(ids) if x is None], np.int32)],
        "terms": [coded.dictionary.take(pa.array(order)).to_pylist()], "starts": [raw(starts, np.int64)], "docs": [raw(doc, np.int32)], "impacts": [raw(impact(tf.astype(np.int64), lengths[doc]), np.int32)],
    }


def _places(shard: list[bytes], wanted: pa.Array) -> np.ndarray:
    """Of each wanted term its place among a shard's terms, or -1."""
    return pc.index_in(wanted, value_set=pa.array(shard, pa.binary())).fill_null(-1).to_numpy()


def document_counts(index: DataFrame, terms: list[bytes]) -> dict[int, int]:
    """How many documents hold each of the terms, by its number; reads the index's terms and starts only."""

    def run(batches):
        wanted, df = pa.array(terms, pa.binary()), np.zeros(len(terms), np.int64)
        for b in batches:
            for own, starts in zip(b["terms"], b["starts"], strict=True):
                at, s = _places(own, wanted), np.frombuffer(starts, np.int64)
                here = np.flatnonzero(at >= 0)
                df[here] += s[at[here] + 1] - s[at[here]]
        some = np.flatnonzero(df)
        yield {"term": some.astype(np.int32), "df": df[some]}

    counted = arrow_map(index.select("terms", "starts"), run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}  # the terms of one block of queries at most


def best(scores: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, all of them if fewer; of equal scores those of lowest rank."""
    over = np.flatnonzero(scores > 0)
    if len(over) > k:
        own = scores[over]
        least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
        over = over[own >= least]  # with every tie of the last place
    return over[np.lexsort((rank[over], -scores[over]))][:k]


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = TOP, block_terms: int = 200_000) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    out = None
    for block in _blocks(items, block_terms):
        part = _searched(index, n_docs, block, k)
        out = part if out is None else out.unionByName(part)
    merged = out if out is not None else index.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))  # limited before the exchange, too
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The distinct (item, term) pairs, all of an item's in one block."""

    def run(batches):
        for b in batches:
            pairs = {(i, t) for i, text in zip(b["item_id"], b["text"], strict=True) for t in terms_of(text)}
            yield {"item_id": [i for i, _ in pairs], "term": [t for _, t in pairs]}

    pairs = written(arrow_map(pick(items, "item_id", "text"), run, "item_id bigint, term binary").distinct(), "query-terms")
    n = max(1, -(-pairs.count() // block_terms))
    for i in range(n):
        yield [(r["item_id"], r["term"]) for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()]


def _searched(index: DataFrame, n_docs: int, pairs: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    """Each shard's best documents for a block of queries."""
    terms = sorted({t for _, t in pairs})
    number = {t: i for i, t in enumerate(terms)}
    df = document_counts(index, terms)
    weights = np.array([weight(df.get(i, 0), n_docs) if i in df else 0 for i in range(len(terms))], np.int64)
    asked: dict[int | None, list[int]] = {}
    for item, t in pairs:
        asked.setdefault(item, []).append(number[t])

    def run(batches: Iterable[dict[str, list]]):
        wanted = pa.array(terms, pa.binary())
        queries = [(item, np.array(t)) for item, t in asked.items()]
        for b in batches:
            for row in zip(*(b[c] for c in ("ids", "no_id", "terms", "starts", "docs", "impacts")), strict=True):
                yield scored(queries, _places(row[2], wanted), *(np.frombuffer(x, t) for x, t in zip((row[0], row[1], *row[3:]), (np.int64, np.int32, np.int64, np.int32, np.int32), strict=True)))

    def scored(queries, at, ids, no_id, starts, docs, impacts) -> dict[str, list]:
        named = np.ones(len(ids), bool)
        named[no_id] = False
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, ~named))] = np.arange(len(ids))
        total = np.zeros(len(ids), np.int64)
        out: dict[str, list] = {"item_id": [], "doc_id": [], "score": []}
        for item, t in queries:
            total[:] = 0
            for i in t[at[t] >= 0]:
                s, e = starts[at[i]], starts[at[i] + 1]
                total[docs[s:e]] += weights[i] * impacts[s:e]
            top = best(total, rank, k)
            out["item_id"] += [item] * len(top)
            out["doc_id"] += [int(ids[j]) if named[j] else None for j in top]
            out["score"] += total[top].tolist()
        return out

    return arrow_map(index, run, "item_id bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The columns that op11 returns."""
    index, n_docs = build(docs)
    return search(index, n_docs, items, k)
