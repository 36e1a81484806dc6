"""Language identification by character trigrams in bit-sliced Bloom filters.

All languages share one filter: a slot holds a bit for each language, in as many
words as there are languages for. Three slots belong to a trigram; the bitwise AND of
their words names every language that (perhaps) has the trigram. A document's set
bits are summed for each language, each sum is corrected for that language's rate of
false positives, and the largest share of the document's trigrams decides.

Fitting uses about `docs_per_language` labelled documents of each language, picked
by a hash of doc_id and text (all of them if there are fewer); their whole texts
count. A language's trigrams are those that make up `least_share` of its sample or
more, so they are at most 1 / least_share; the filter has twelve slots for each
trigram of the richest language.

Defined cases: null text and text without letters give `und`, score 0; so does
everything if there is nothing to learn from; at a tie the first language in
alphabetical order wins; texts are read whole; repeated rows are answered once
each and learnt from once; rows of null doc_id are picked by their text; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, batch_map, mix, pick, written

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SLICE = 1 << 18  # characters handled at once


def letters(text: str) -> str:
    """Lower-case words between single spaces; empty if text has no letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def trigram_hashes(chars: str) -> np.ndarray:
    u = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return mix((u[:-2] << np.uint64(42)) ^ (u[1:-1] << np.uint64(21)) ^ u[2:])


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # rows of words: language i is bit i % (bits of a word) of row i // (bits of a word)
    false_rates: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, list[str]], bits: int | None = None) -> Filters:
        """grams: the trigrams of each language."""
        languages = sorted(grams)
        most = max((len(g) for g in grams.values()), default=0)
        bits = min(21, max(16, (12 * most - 1).bit_length())) if bits is None else bits
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        width = 8 * kind().itemsize
        slots = np.zeros((max(1, -(-len(languages) // width)), 1 << bits), kind)
        filled = []
        for i, lang in enumerate(languages):
            row, bit = slots[i // width], kind(1 << i % width)
            for at in cls._places(np.concatenate([trigram_hashes(g) for g in grams[lang]] or [np.zeros(0, np.uint64)]), bits):
                row[at] |= bit
            filled.append(np.count_nonzero(row & bit) / len(row))
        return cls(languages, slots, np.array(filled) ** 3)

    @staticmethod
    def _places(h: np.ndarray, bits: int):
        mask = np.uint64((1 << bits) - 1)
        return (h & mask, (h >> np.uint64(21)) & mask, (h >> np.uint64(42)) & mask)

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For texts that letters() returned, none empty: the corrected share of trigrams in each language."""
        sizes = np.array([len(t) - 2 for t in texts])
        h = trigram_hashes("".join(texts))
        a, b, c = self._places(h, self.slots.shape[1].bit_length() - 1)
        starts = np.cumsum([0, *(sizes[:-1] + 2)])  # the two trigrams that span a border are cut off below
        kind, out = self.slots.dtype.type, np.zeros((len(texts), len(self.languages)))
        width = 8 * kind().itemsize
        for first, row in zip(range(0, len(self.languages), width), self.slots, strict=True):
            words = row[a] & row[b] & row[c]
            for i in range(first, min(first + width, len(self.languages))):
                run = np.concatenate([[0], np.cumsum((words >> kind(i - first)) & kind(1), dtype=np.int64)])
                hits = run[starts + sizes] - run[starts]
                out[:, i] = np.clip((hits / sizes - self.false_rates[i]) / (1 - self.false_rates[i]), 0, 1)
        return out, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        cleaned = [letters(t) for t in texts]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        group: list[int] = []
        size = 0
        for i, t in enumerate([*cleaned, None]):
            if group and (t is None or size + len(t) > _SLICE):
                shares, _ = self.shares([cleaned[j] for j in group])
                for j, row in zip(group, shares, strict=True):
                    best = int(row.argmax())
                    langs[j], scores[j] = self.languages[best], float(row[best])
                group, size = [], 0
            if t:
                group.append(i)
                size += len(t)
        return langs, scores


def sample(docs: DataFrame, share: DataFrame) -> DataFrame:
    """lang and text of labelled rows, picked by a hash of doc_id and text as share (lang, share) says; equal rows once."""
    picked = docs.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1e6 < F.col("share"))
    return picked.select("lang", "doc_id", "text").distinct().select("lang", "text")


def fit(docs: DataFrame, docs_per_language: int = 2000, least_share: float = 1 / 20_000) -> Filters:
    """Learns from text and lang of docs; rows without either are passed over. Only the languages and their trigrams leave the executors."""
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    share = labelled.groupBy("lang").agg((docs_per_language / F.count("*")).alias("share"))

    def count(batches):
        found: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                t = letters(text)
                found[lang].update(map("".join, zip(t, t[1:], t[2:], strict=False)))
        for lang, c in found.items():
            yield {"lang": [lang] * len(c), "gram": list(c), "n": list(c.values())}

    total = arrow_map(sample(labelled, share), count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = written(total, "trigrams")
    seen = total.groupBy("lang").agg(F.sum("n").alias("seen"))
    kept = total.join(F.broadcast(seen), "lang").where(F.col("n") >= least_share * F.col("seen"))
    # A language whose sample has no trigram still is one that was seen.
    grams: dict[str, list[str]] = {r["lang"]: [] for r in share.collect()}
    for r in kept.select("lang", "gram").collect():
        grams[r["lang"]].append(r["gram"])
    return Filters.build(grams)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score; one row per document."""

    def run(batches):
        for b in batches:
            langs, scores = filters.predict(b["text"])
            yield {"doc_id": b["doc_id"], "lang_pred": langs, "score": scores}

    return arrow_map(pick(docs, "doc_id", "text"), run, "doc_id bigint, lang_pred string, score double")


def held_out(column: str = "doc_id"):
    """Whether a document is kept out of learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_languages(docs: DataFrame, filters: Filters, least_score: float = 0.3) -> DataFrame:
    """docs without those in no learned language (`und`, or too few trigrams of any); columns as they were."""

    def known(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = filters.predict([t or "" for t in batch.column("text").to_pylist()])
        return batch.filter(pa.array([la != "und" and s >= least_score for la, s in zip(langs, scores, strict=True)], pa.bool_()))

    return batch_map(docs, known)
