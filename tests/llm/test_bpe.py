import hashlib
import random
import time

import numpy as np
import pytest

from palimpsest.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    r = random.Random(1)
    parts = [*"abcABC  \n\t'sdl.,!?0123é ß", "<|endoftext|>", "  ", "'re", "漢字", "\xa0", "​", "😀", "²", "𐍈", "\r\n", "\x1c", "՘", "ǅ"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(3000)]
    return [*texts, "", "a" * 5000, " " * 3000, "ab " * 1000 + "  x", "\n" * 700 + "a", "x ", " x", *("x" * n for n in range(70))]


def test_encodes_and_decodes_as_the_library(library):
    texts = odd_texts()
    v = bpe.Vocabulary(PATH)
    words = {w for t in texts[:1000] for w in v.words(t)}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile({w.encode(): v.merge(w.encode()) for w in list(words)[::2]}))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for e in (bpe.Encoder(v), bpe.Encoder(v, lexicon)):
        assert e.encode_all(texts) == want
        assert [e.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]
    ids = bpe.fast_ids(PATH)
    assert [ids(t).tolist() for t in texts] == want


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): (i, i + 1) for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é"])}
    arrays = bpe.Lexicon.compile(words)
    lexicon = bpe.Lexicon(arrays)
    found = lexicon.index([*words, b"ta", b"", b"tapss", b"zzz"]).tolist()
    assert sorted(found[: len(words)]) == list(range(len(words))) and found[len(words) :] == [-1] * 4
    assert [tuple(lexicon.ids[lexicon.start[i] : lexicon.start[i + 1]].tolist()) for i in found[: len(words)]] == list(words.values())
    # The start; after s, st, t, (t)a|o, p; é's first byte; the end, also of each plural: equal suffixes are one state.
    assert len(arrays["final"]) == 8
    assert bpe.Lexicon(bpe.Lexicon.compile({})).index([b"x"]).tolist() == [-1]


def test_vector_merges_equal_scalar_ones():
    v = bpe.Vocabulary(PATH)
    r = random.Random(2)
    words = [bytes(r.choices(b"thenraisgou \xc3\xa9", k=r.randint(1, 60))) for _ in range(3000)]
    ids, length = bpe.Merger(v).merge_all(words)
    assert [tuple(x.tolist()) for x in np.split(ids, np.cumsum(length)[:-1])] == [v.merge(w) for w in words]
    assert [v._merge_long([v.single[b] for b in w]) for w in words] == [v.merge(w) for w in words]


def test_round_trip_query(spark, library):
    rows = [(1, "Hello there world", 1), (2, None, 1), (3, "", 1), (1, "Hello there world", 1), (None, "wörd " * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((tuple(r) for r in bpe.round_trip(docs, PATH, 10).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r["text"] for r in back), key=len) == sorted((t or "" for _, t, _ in rows), key=len)


def test_plain_pattern_splits_as_the_library(library):
    """Every character that the plain pattern may see, in several places."""
    pre = library.pre_tokenizer
    for c in [*range(0x2D0), *range(0x2000, 0x2030), 0x20AC]:
        if not bpe._NOT_PLAIN.search(chr(c)):
            s = f"a{chr(c)}1{chr(c)} {chr(c)}.'s {chr(c)}{chr(c)} 've'll "
            assert [x for _, x in pre.pre_tokenize_str(s)] == [m.span() for m in bpe._PLAIN_WORDS.finditer(s)], hex(c)


def test_single_spaced_pattern_splits_as_the_library(library):
    """Every white space character between, before and after words, marks, numbers and special tokens, and pairs of them beside it."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    ids = bpe.fast_ids(PATH)
    for s in spaces:
        for text in (s, f"a{s}b{s}1{s}.{s}'s{s}<|endoftext|>{s}é{s}", f"{s}don't{s}we'll{s}!?{s}23", f"a{s}{s}b", f"a {s}b{s} c\n{s}"):
            assert ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(s))


def test_ids_of_prose_take_little_more_than_the_look_ups():
    import tiktoken

    r = random.Random(4)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 9))) for _ in range(20_000)]
    texts = [" ".join(r.choices(words, k=400)) + ".\n" for _ in range(500)]
    v = bpe.Vocabulary(PATH)
    plain = tiktoken.Encoding("plain", pat_str=bpe.WORDS.pattern, mergeable_ranks=v.id_of, special_tokens=v.special)

    def least(encode):
        took = []
        for _ in range(5):
            began = time.thread_time()
            for t in texts:
                encode(t)
            took.append(time.thread_time() - began)
        return min(took)

    ids = bpe.fast_ids(PATH)
    assert all(np.array_equal(ids(t), plain.encode_to_numpy(t, allowed_special="all")) for t in texts)
    assert least(ids) < 1.1 * least(lambda t: plain.encode_to_numpy(t, allowed_special="all"))


def test_words_just_short_of_long_take_linear_time(library):
    text = ("ab" * 9999 + "  ") * 10
    began = time.thread_time()
    found = bpe.fast_ids(PATH)(text)
    took = time.thread_time() - began
    assert found.tolist() == library.encode(text, add_special_tokens=False).ids
    assert took < 5  # 28 s where each place of a word begins a search to its end
    for n in (499, 500, 501, 1000):
        for text in ("a" + " " * n + "b  c", "a  " + "\n" * n, " " * n + "a", "a  " + "b" * (40 * n) + "  c"):
            assert bool(bpe._LONG.search(text)) == bool(bpe.regex.search(r"\s{500}|\S{20000}", text)) == bool(bpe._PERHAPS_LONG.search(text[::50]) and bpe._LONG.search(text))
