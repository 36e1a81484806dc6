import hashlib
import random
import re
from collections import defaultdict

import pytest

from palimpsest.llm import suffixes


def brute(texts, span):
    data = [(t or "").encode() for t in texts]
    at = defaultdict(list)
    for i, d in enumerate(data):
        for p in range(len(d) - span + 1):
            at[d[p : p + span]].append((i, p))
    gone = [[False] * len(d) for d in data]
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + span] = [True] * span
    out = []
    for d, g in zip(data, gone, strict=True):
        kept = bytes(b for b, x in zip(d, g, strict=True) if not x)
        runs = sum(x and (i == 0 or not g[i - 1]) for i, x in enumerate(g))
        out.append((len(d), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["tha", "ner", "éa", "ion", "st", "ü", "sch"]
    text = lambda n: " ".join("".join(r.choices(words, k=r.randint(1, 4))) for _ in range(n))
    passages = [text(r.randint(60, 140)) for _ in range(4)]
    docs = [None, "", "short", "a" * 900, "ab" * 500, text(300)]
    docs += [docs[-1], docs[-1] + " end", "x" + docs[-1]]
    for _ in range(25):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 30) if r.random() < 0.5 else 0
            parts += [p[a : len(p) - (r.randint(0, 30) if r.random() < 0.5 else 0)], text(r.randint(0, 40))]
        docs.append("".join(parts))
    return docs


@pytest.mark.parametrize("seed,crowd,most_tasks", [(1, 20_000, 10_000), (2, 20_000, 2), (3, 2, 10_000), (4, 0, 3)])
def test_matches_brute_force(spark, seed, crowd, most_tasks, monkeypatch):
    texts = corpus(seed)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[10], "x", 1), (3, "other text", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k1 string, n_chars bigint")
    whole = suffixes.repeated_stretches
    monkeypatch.setattr(suffixes, "repeated_stretches", lambda d, span: whole(d, span, crowd=crowd, per_task=30, most_tasks=most_tasks))
    got = sorted(map(tuple, suffixes.dedup_digest(docs, 400).collect()), key=str)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 400), strict=True)), key=str)
    assert got == want
    assert sum(r[2] for r in got) > 5000


def brute_words(texts, n):
    """Each text without the words of any run of n words that stands elsewhere, too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "") for t in texts]
    at = defaultdict(list)
    for i, w in enumerate(split):
        for p in range(len(w) - n + 1):
            at[tuple(x.rstrip("\x20\x09\x0a\x0b\x0c\x0d") for x in w[p : p + n])].append((i, p))
    gone = {(i, p + j) for places in at.values() if len(places) > 1 for i, p in places for j in range(n)}
    return [t if t is None else re.match(r"[\x20\x09-\x0D]*", t)[0] * ((i, 0) not in gone) + "".join(x for p, x in enumerate(w) if (i, p) not in gone) for i, (t, w) in enumerate(zip(texts, split, strict=True))]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_words_match_brute_force(spark, crowd, monkeypatch):
    """Passages of 51 to 60 words, short ones and long ones, in otherwise unlike documents, with other space between their words."""
    r = random.Random(9)
    word = lambda a, b: "".join(r.choices("abcdeéü", k=r.randint(a, b)))
    passages = [[word(*size) for _ in range(r.randint(51, 60))] for size in ((1, 2), (1, 3), (3, 9), (8, 14))] + [["and"] * 55, [word(2, 4) for _ in range(49)]]
    texts = [None, "", " one", "\n".join(passages[0]), "x " * 300, "  " + " ".join(passages[1] * 2)]
    for i in range(60):
        w = [word(2, 7) for _ in range(r.randint(0, 150))]
        if i % 2:
            p = passages[i // 2 % 6]
            at = r.randint(0, len(w))
            w[at:at] = p
        texts.append(r.choice([" ", "\n", "  "]).join(w) + r.choice(["", "\n"]))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars int")
    whole = suffixes.repeated_stretches
    monkeypatch.setattr(suffixes, "repeated_stretches", lambda d, span, words: whole(d, span, words=words, crowd=crowd, per_task=30))
    got = {x["doc_id"]: x for x in suffixes.remove_repeats(docs, 50 * suffixes.WORD, words=True).collect()}
    want = brute_words(texts, 50)
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in got.values())
    for p in passages[:5]:
        assert not any(" ".join(p) in " ".join((t or "").split()) for t in want)
    assert all(got[i]["text"] == texts[i] for i in range(6, len(texts), 2)) and any(passages[5][0] in (t or "").split() for t in want)


def test_a_text_beyond_one_chunk(spark, monkeypatch):
    r = random.Random(2)
    data = bytes(r.choices(b"abcdefgh ", k=60_000))
    whole = suffixes.anchors(data)
    monkeypatch.setattr(suffixes, "_CHUNK", 1000)
    assert suffixes.anchors(data).tolist() == whole.tolist()
    monkeypatch.undo()
    text = "".join(r.choices("abcdefgh ", k=1_200_000))
    text = text + text[500_000:500_700]
    (row,) = suffixes.dedup_digest(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    rest = text[:500_000] + text[500_700:1_200_000]
    assert len(text) > suffixes._CHUNK and row["n_removed"] in range(1400, 1410) and row["n_spans"] == 2 and row["kept_sha256"] == hashlib.sha256(rest[: 1_199_300].encode()).hexdigest()


def test_a_phrase_said_over_and_over_sends_few_rows(spark):
    docs = spark.createDataFrame([(i, "the same thing again and again, " * 400) for i in range(20)], "doc_id bigint, text string")
    rows = suffixes._anchor_rows(suffixes._keyed(docs), suffixes.SPAN, suffixes.K, False)
    assert rows.count() < 20 * 60
    assert all(r["n_removed"] == r["n_bytes"] for r in suffixes.dedup_digest(docs).collect())


def test_loser_tree_merges_like_sorting():
    r = random.Random(5)
    for runs in (0, 1, 2, 3, 7):
        data = [[(bytes(r.choices(b"ab", k=r.randint(0, 12))), i, j) for j in range(r.randint(0, 20))] for i in range(runs)]
        out = list(suffixes.merged([suffixes.unfolded(suffixes.front_coded(list(d))) for d in data]))
        assert [x[1] for x in out] == sorted(s for d in data for s, *_ in d)
        for a, b in zip(out, out[1:], strict=False):
            assert b[0] == suffixes.shared(a[1], b[1], 0)


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffixes.dedup_digest(docs).collect() == []


def test_remove_repeats_keeps_columns(spark):
    long = "wörd " * 200
    docs = spark.createDataFrame([(1, "a" + long, "en"), (2, "b" + long, "de"), (3, None, None), (4, "kept", "fr")], "doc_id bigint, text string, _k1 string")
    out = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    assert docs.columns == ["doc_id", "text", "_k1"]
    assert len(out[1]["text"]) < 10 and out[3]["text"] is None and out[4]["text"] == "kept"
