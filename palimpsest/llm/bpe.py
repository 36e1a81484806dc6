"""Byte-level BPE with a minimal acyclic transducer as its lexicon.

The most frequent words of the corpus, with their ids, are compiled into one
automaton whose equal suffixes are shared. Walking a word through it adds up how
many words lie before it; that number is the word's index, and the index leads to
its ids. The automaton is a flat array file that every executor fetches and maps
into memory. A word that it lacks is merged by the vocabulary's ranks, exactly.

Defined cases: null text is read as empty and has no ids; texts of any length are
encoded whole; a special token's string in a text becomes its id, as the
tokenizers library does by default; repeated rows are answered once each; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, pick, shared_file, written

WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Outside these ranges character classes depend on the Unicode version; there the library itself splits the text.
_UNSURE = regex.compile(r"[^\x00-\u0557\u2000-\u206f\u20a0-\u20bf\u3000-\u303f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")
#: Text of these characters alone, nearly all that is written in Latin letters, splits alike by a pattern of plain ranges, in half the time.
_NOT_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u02c1\u2010-\u2027\u20ac]")
_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02c1"
_PLAIN_WORDS = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: The same split of text without two white space characters in a row; without look-ahead it needs no backtracking.
_SINGLE_SPACED = WORDS.pattern.removesuffix(r"|\s+(?!\S)|\s+") + r"|\s"
_TWO_SPACES = re.compile(r"\s\s")
#: Looked for from the start of a stretch only, and where every 50th character leaves it possible.
_LONG = regex.compile(r"(?<!\s)\s{500}|(?<!\S)\S{20000}")
_PERHAPS_LONG = regex.compile(r"\s{10}|\S{400}")
#: Words remembered: some 150 MB a worker at most.
_CACHED = 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank[self.id_of[a], self.id_of[b]] = (n, self.id_of[a + b])
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._splitter = None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word: again and again the neighbours of least rank, the leftmost ones at ties, become one."""
        ids = [self.single[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = min(((self.rank.get(p, (1 << 30, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False))))
            if best == 1 << 30:
                break
            ids[at : at + 2] = [self.rank[ids[at], ids[at + 1]][1]]
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        live, heap = [True] * n, []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (r := self.rank.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (r[0], i, ids[i], ids[after[i]], r[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return tuple(ids[i] for i in range(n) if live[i])

    def words(self, text: str) -> list[str]:
        if not _NOT_PLAIN.search(text):
            return _PLAIN_WORDS.findall(text)
        if not _UNSURE.search(text):
            return WORDS.findall(text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]


class Lexicon:
    """A minimal acyclic automaton over words' bytes, flat; index(words) gives each word's number, -1 for others."""

    FIELDS = ("keys", "target", "skip", "final", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.target, self.skip, self.final, self.start, self.ids = (arrays[f] for f in self.FIELDS)

    @staticmethod
    def compile(words: dict[bytes, tuple[int, ...]]) -> dict[str, np.ndarray]:
        """words with their ids. Words are added in order; a state is frozen, or replaced by an equal one, once no later word can change it."""
        register: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple]] = []
        path: list[tuple[list, list]] = [([False], [])]  # of the word added last: [final], [(byte, state)]

        def freeze(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                state = (final[0], tuple(arcs))
                if state not in register:
                    register[state] = len(frozen)
                    frozen.append(state)
                path[-1][1][-1] = (path[-1][1][-1][0], register[state])

        ordered, last = sorted(words), b""
        for w in ordered:
            same = len(os.path.commonprefix([w, last]))
            freeze(same)
            for b in w[same:]:
                path[-1][1].append((b, None))
                path.append(([False], []))
            path[-1][0][0], last = True, w
        freeze(0)
        frozen.append((path[0][0][0], tuple(path[0][1])))
        below = [0] * len(frozen)
        keys, target, skip = [], [], []
        for s, (final, arcs) in enumerate(frozen):
            seen = int(final)
            for b, t in arcs:
                keys.append(s << 8 | b)
                target.append(t)
                skip.append(seen)
                seen += below[t]
            below[s] = seen
        sizes = [len(words[w]) for w in ordered]
        return {
            "keys": np.array(keys, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64), "final": np.array([f for f, _ in frozen], np.int64),
            "start": np.cumsum([0, *sizes], dtype=np.int64), "ids": np.array([i for w in ordered for i in words[w]], np.int64),
        }

    @classmethod
    def flat(cls, arrays: dict[str, np.ndarray]) -> np.ndarray:
        """The file's content: six lengths, then the arrays."""
        return np.concatenate([np.array([len(arrays[f]) for f in cls.FIELDS], np.int64), *(arrays[f] for f in cls.FIELDS)])

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        flat = np.memmap(path, np.int64, "r")
        ends = 6 + np.cumsum(flat[:6])
        return cls({f: flat[b - n : b] for f, b, n in zip(cls.FIELDS, ends, flat[:6], strict=True)})

    def index(self, words: list[bytes]) -> np.ndarray:
        """All words walk at once, one byte a step."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        length = np.array([len(w) for w in words])
        order = np.argsort(-length, kind="stable")
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        first = np.cumsum(length) - length
        state, number, alive = np.full(len(words), len(self.final) - 1, np.int64), np.zeros(len(words), np.int64), order
        for step in range(int(length.max(initial=0))):
            alive = alive[length[alive] > step]
            if not len(alive):
                break
            key = state[alive] << 8 | flat[first[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            state[alive[~known]] = -1
            alive, at = alive[known], at[known]
            number[alive] += self.skip[at]
            state[alive] = self.target[at]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] == 1
        out[ok] = number[ok]
        return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Text to ids and back; words seen before are remembered, up to a fixed number.

    The words of a batch are numbered in one step, so each distinct one is looked up once, and ids are put together from
    one flat store.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.v, self.lexicon = vocabulary, lexicon
        self.merger = Merger(vocabulary)
        size = max(vocabulary.bytes_of) + 1
        tokens = [vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.token_length = np.array([len(t) for t in tokens])
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        # Special tokens are words that no pattern yields.
        self.place: dict[str, int] = {t: n for n, t in enumerate(self.v.special)}
        self.flat = np.array(list(self.v.special.values()), np.int32)
        self.start, self.length = np.arange(len(self.flat)), np.ones(len(self.flat), np.int64)

    def _learn(self, words: list[str]) -> None:
        """Adds words, none of them known, to the store: from the lexicon, else by merging."""
        raw = [w.encode() for w in words]
        found = self.lexicon.index(raw) if self.lexicon is not None else np.full(len(raw), -1)
        known, unseen = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        length = np.zeros(len(raw), np.int64)
        parts = [self.flat]
        start, at = np.zeros(len(raw), np.int64), len(self.flat)
        if len(known):
            begin = np.asarray(self.lexicon.start[found[known]])
            length[known] = np.asarray(self.lexicon.start[found[known] + 1]) - begin
            parts.append(np.asarray(self.lexicon.ids[ragged(begin, length[known])], np.int32))
            start[known] = at + np.cumsum(length[known]) - length[known]
            at += len(parts[-1])
        ids, length[unseen] = self.merger.merge_all([raw[i] for i in unseen.tolist()])
        start[unseen] = at + np.cumsum(length[unseen]) - length[unseen]
        n = len(self.start)
        self.flat = np.concatenate([*parts, ids])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's end."""
        cut = [self.words(t) for t in texts]
        numbered = pa.array(list(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.place]
        if new:
            if len(self.place) + len(new) > _CACHED:
                self._forget()
                new = [w for w in distinct if w not in self.place]
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[numbered.indices.to_numpy()]
        length = self.length[place]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum([len(c) for c in cut], dtype=np.int64)]
        return self.flat[ragged(self.start[place], length)], ends

    def batches(self, texts: list[str], size: int = 4_000_000):
        """Ids of each text as an array; texts go in groups of about `size` characters."""
        a = 0
        while a < len(texts):
            b, chars = a, 0
            while b < len(texts) and (b == a or chars + len(texts[b]) <= size):
                chars += len(texts[b])
                b += 1
            ids, ends = self.encode_flat(texts[a:b])
            yield from np.split(ids, ends[:-1])
            a = b

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [i.tolist() for i in self.batches(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def words(self, text: str) -> list[str]:
        """The text's words, special tokens among them."""
        if self.v.stops is None or not any(s in text for s in self.v.special):
            return self.v.words(text)
        out, last = [], 0
        for m in self.v.stops.finditer(text):
            out += [*self.v.words(text[last : m.start()]), m[0]]
            last = m.end()
        return out + self.v.words(text[last:])

    def decode(self, ids) -> str:
        return self.bytes_of(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ragged(self.token_start[ids], self.token_length[ids])].tobytes()


class Merger:
    """Merges many words at once, exactly as Vocabulary.merge does each: in every round each word's pair of least rank, the leftmost at ties, becomes one."""

    NONE = np.int32(1 << 30)

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.single = np.array(vocabulary.single, np.int32)
        pair = np.array([a << 32 | b for a, b in vocabulary.rank], np.uint64)
        rank = np.array([n for n, _ in vocabulary.rank.values()], np.int32)
        self.made = np.zeros(len(rank) + 1, np.int32)
        self.made[rank] = [m for _, m in vocabulary.rank.values()]
        # Tables that hold a pair's rank at a hashed place; pairs that collide go to the next table.
        self.tables, multiplier = [], 0x9E3779B97F4A7C15
        while len(pair):
            bits = max(4, int(4 * len(pair)).bit_length())
            at = (pair * np.uint64(multiplier)) >> np.uint64(64 - bits)
            keys, ranks = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, self.NONE)
            keys[at], ranks[at] = pair, rank
            self.tables.append((np.uint64(multiplier), np.uint64(64 - bits), keys, ranks))
            rest = keys[at] != pair
            pair, rank = pair[rest], rank[rest]
            multiplier = (multiplier * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1
        every = np.arange(256)
        self.byte_rank = self.ranks(*(self.single[x] for x in np.meshgrid(every, every, indexing="ij")))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = np.full(pair.shape, self.NONE)
        for multiplier, shift, keys, ranks in self.tables:
            at = (pair * multiplier) >> shift
            hit = keys[at] == pair
            out[hit] = ranks[at[hit]]
        return out

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, one word after the other, and how many each has."""
        length = np.zeros(len(words), np.int64)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_width.setdefault((len(w) + 3) & ~3 if len(w) <= 48 else 0, []).append(i)
        parts, order = [np.zeros(0, np.int32)], []
        for width, those in by_width.items():
            for a in range(0, len(those), 20_000):
                some = those[a : a + 20_000]
                if width:
                    ids, length[some] = self._rounds([words[i] for i in some], width)
                else:
                    merged = [self.v.merge(words[i]) for i in some]
                    ids, length[some] = np.array(list(chain.from_iterable(merged)), np.int32), [len(m) for m in merged]
                parts.append(ids)
                order += some
        start = np.zeros(len(words), np.int64)
        if order:
            done = length[order]
            start[order] = np.cumsum(done) - done
        return np.concatenate(parts)[ragged(start, length)], length

    def _rounds(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids, rank = self.single[raw], self.byte_rank[raw[:, :-1], raw[:, 1:]]
        place = np.arange(width)
        rank[place[None, 1:] >= length[:, None]] = self.NONE
        live = np.arange(n)
        while len(live):
            r = rank[live]
            at = r.argmin(axis=1)
            best = r[np.arange(len(live)), at]
            go = best < self.NONE
            live, at, best = live[go], at[go], best[go]
            if not len(live):
                break
            k = np.arange(len(live))
            # Everything right of the pair moves one place to the left.
            source = np.minimum(place[None, :] + (place[None, :] > at[:, None]), width - 1)
            row = np.take_along_axis(ids[live], source, axis=1)
            row[k, at] = self.made[best]
            r = np.take_along_axis(rank[live], np.minimum(source[:, :-1], width - 2), axis=1)
            length[live] -= 1
            end = length[live]
            left, right = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            new = np.where((at > 0), self.ranks(row[k, left], row[k, at]), self.NONE)
            r[k, np.minimum(left, width - 2)] = np.where(at > 0, new, r[k, np.minimum(left, width - 2)])
            inside = at < width - 1
            r[k[inside], at[inside]] = np.where(at[inside] + 1 < end[inside], self.ranks(row[k[inside], at[inside]], row[k[inside], right[inside]]), self.NONE)
            r[place[None, 1:] >= end[:, None]] = self.NONE
            ids[live], rank[live] = row, r
        return ids[place[None, :] < length[:, None]], length


_LOADED: dict[tuple, object] = {}


def encoder(path: str, lexicon_file: str | None = None) -> Encoder:
    """The worker's encoder, made once."""
    key = (path, lexicon_file)
    if key not in _LOADED:
        v = next((e.v for (p, _), e in _LOADED.items() if p == path and isinstance(e, Encoder)), None) or Vocabulary(path)
        _LOADED.clear()  # words remembered for an earlier query go
        _LOADED[key] = Encoder(v, Lexicon.mapped(SparkFiles.get(lexicon_file)) if lexicon_file else None)
    return _LOADED[key]


def fast_ids(path: str):
    """text -> ids as an array, through a library with the same ranks where it is sure to agree, else by the worker's encoder."""
    own = encoder(path)
    v = own.v
    if any(n + 256 != i for n, i in v.rank.values()) or sorted(v.single) != list(range(256)):
        return lambda text: np.array(own.encode(text), np.uint32)
    import tiktoken

    def library(pattern: str) -> tiktoken.Encoding:
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=v.id_of, special_tokens=v.special)
        return _LOADED[path, pattern]

    def ids(text: str) -> np.ndarray:
        if _UNSURE.search(text):
            return np.array(own.encode(text), np.uint32)
        if not _TWO_SPACES.search(text):
            return library(_SINGLE_SPACED).encode_to_numpy(text, allowed_special="all")
        # Long stretches of white space or of one word outgrow that library's regex stack, which look-ahead needs.
        if _PERHAPS_LONG.search(text[::50]) and _LONG.search(text):
            return np.array(own.encode(text), np.uint32)
        return library(WORDS.pattern).encode_to_numpy(text, allowed_special="all")

    return ids


def frequent_words(docs: DataFrame, path: str, n: int) -> list[str]:
    """The most frequent words of all texts, n at most and all of a count or none; words of a task are counted before they are sent on."""

    def count(batches):
        e, held, size = encoder(path), [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}) if len(held) > 1 else held[0]

        for b in batches:
            words = pa.array(list(chain.from_iterable(map(e.words, b["text"]))), pa.large_string()).value_counts()
            held.append(pa.table({"word": words.field("values"), "n": words.field("counts")}))
            size += len(words)
            if size > _CACHED:
                held = [summed()]
                size = len(held[0])
                if size > _CACHED // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield summed()

    counted = arrow_map(pick(docs, "text"), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    # The least count that at most n words reach, from a histogram of a few hundred steps: only those words are sent to the driver.
    counted = written(counted.withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "words")
    least, seen = None, 0
    for r in counted.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        seen += r["words"]
        if seen > n:
            break
        least = r["step"]
    return [] if least is None else [r["word"] for r in counted.where(F.col("step") >= least).select("word").collect()]


def ship_lexicon(spark: SparkSession, words: list[str], path: str) -> str:
    """Compiles words and hands the file to every executor, present and later; returns its name."""
    v = Vocabulary(path)
    arrays = Lexicon.compile({w.encode(): v.merge(w.encode()) for w in words if w})
    return shared_file(spark, "lexicon", Lexicon.flat(arrays).tobytes())


def encode(docs: DataFrame, path: str, lexicon_file: str | None = None) -> DataFrame:
    """doc_id, ids; one row per document."""

    def run(batches):
        e = encoder(path, lexicon_file)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": list(e.batches(b["text"]))}

    return arrow_map(pick(docs, "doc_id", "text"), run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; invalid bytes become U+FFFD."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            yield {"doc_id": b["doc_id"], "text": [e.decode(i or []) for i in b["ids"]]}

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, frequent: int = 200_000) -> DataFrame:
    """The columns that op7 returns: encodes each text with a lexicon of the corpus' frequent words and decodes the ids."""
    docs = pick(docs, "doc_id", "text")
    lexicon_file = ship_lexicon(docs.sparkSession, frequent_words(docs, path, frequent), path)

    def run(batches):
        e = encoder(path, lexicon_file)
        numeral = {i: str(i) for i in e.v.bytes_of}
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in e.batches(b["text"]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(numeral.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            yield {"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return arrow_map(docs, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
