import random
import re
import zlib
from collections import Counter

from palimpsest.llm import spelling

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def near_words(words):
    known, out = set(words), {w: set() for w in words}
    letters = {c for w in words for c in w}
    for w in words:
        for i in range(len(w)):
            if (short := w[:i] + w[i + 1 :]) in known:
                out[w].add(short)
                out[short].add(w)
            out[w] |= {x for c in letters if c != w[i] and (x := w[:i] + c + w[i + 1 :]) in known}
    return out


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 5
    count = {w: n for w, n in count.items() if n >= 3}
    near = near_words(list(count))
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count.get(form[w])))
    return sorted(out, key=str)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id bigint, text string, n int, word string")


def test_merging_gives_every_pair_once():
    r = random.Random(1)
    for _ in range(1500):
        words = sorted({"".join(r.choices("abcd"[: r.randint(1, 4)], k=r.randint(1, 7))) for _ in range(r.randint(0, 70))})
        counts = [r.randint(1, 9) for _ in words]
        near = spelling.Near(words, counts)
        spelling.merge(near, [-1] * len(words))
        want, n = near_words(words), dict(zip(words, counts, strict=True))
        assert near.n == [len(want[w]) for w in words]
        assert near.first == [min(((-n[x], x) for x in want[w]), default=None) for w in words]


def test_ranges_change_nothing(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choices("abé", k=r.randint(1, 7))) for _ in range(250)} | {"a" * i for i in range(1, 40)} | {"b" * 3000, "b" * 3001})
    counts = [r.randint(1, 30) for _ in words]
    df = spelling.written(spark.createDataFrame(list(zip(words, counts, strict=True)), "word string, n bigint"), "w")
    want, n = near_words(words), dict(zip(words, counts, strict=True))
    expected = sorted((w, len(x), *min((-n[y], y) for y in x)) for w, x in want.items() if x)
    for size in (10_000, 40):
        got = spelling.neighbours(df, range_words=size).collect()
        assert sorted((x["word"], x["n_near"], x["first"]["n"], x["first"]["word"]) for x in got) == expected


def test_against_brute_force(spark):
    r = random.Random(5)
    stems = ["letters", "lettres", "leters", "letter", "Lettérs", "abcdef", "abcdeg", "abcdefg", "xxxxx", "xxxxxx", "xxxxxxx", "naïveté", "naiveté"]
    weights = [40, 3, 4, 20, 2, 9, 4, 1, 30, 10, 3, 8, 2]
    rows = [(i, " ".join(r.choices(stems, weights, k=r.choice([0, 2, 60])))) for i in range(80)]
    rows += [(None, "Letters×letters÷LETTERS letters"), (3, None), (4, ""), (5, "ab1cdefgh_ijklm–nopqrſtuvwxŸyz"), (rows[9][0], rows[9][1]), (6, ("q" * 1500 + " ") * 3), (6, "日本letters日本")]
    df = docs_of(spark, rows)
    want = brute(rows)
    assert any(x[1] for x in want) and any(x[2] not in (x[0], x[1]) for x in want)
    assert sorted(map(tuple, spelling.variants(df).collect()), key=str) == want
    assert sorted(map(tuple, spelling.variants(df, range_words=3).collect()), key=str) == want
    assert spelling.variants(docs_of(spark, [])).collect() == [] and spelling.variants(docs_of(spark, [(1, None)])).collect() == []


def test_very_long_words(spark):
    long = "q" * 200_000
    rows = [(i, f"{long} {long}r") for i in range(4)]
    assert 97 not in {zlib.crc32(f"{i}:{x}".encode()) % 97 or 97 for i, _ in rows for x in (long, long + "r")}
    got = sorted(tuple(r) for r in spelling.variants(docs_of(spark, rows)).collect())
    assert got == [(long, None, long, 4, 1, None), (long + "r", None, long + "r", 4, 1, None)]


def test_long_chains_of_forms(spark):
    rows = [("a" * 5 + "b" * i, 2**i, "a" * 5 + "b" * (i + 1) if i < 20 else None) for i in range(21)]
    df = spark.createDataFrame([(*x, 0, None) for x in rows], "word string, n bigint, form string, n_near int, form_n int")
    assert {r["root"] for r in spelling.with_roots(df).collect()} == {"aaaaa" + "b" * 20}


def test_runs_are_those_of_the_pattern():
    text = "".join(map(chr, range(1, 0x300))) + " Ab×CıD"
    assert [x.decode("latin-1") for x in spelling.runs_of(text)] == [x.translate(UPPER) for x in RUN.findall(text)]
