import random

import pytest

from palimpsest.llm import jaccard
from palimpsest.llm.common import word_hashes


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    n = len(rows)
    link = [[i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    group = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if link[i][j] and group[j] < group[i]:
                    group[i], changed = group[j], True
    ids = [r[0] for r in rows]
    out = []
    for i in range(n):
        same = [ids[j] for j in range(n) if sets[i] and sets[j] == sets[i]] or [ids[i]]
        out.append((ids[i], min(same), min(ids[j] for j in range(n) if group[j] == group[i]), sum(link[i])))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = r.choices(vocabulary, k=40)
    texts = [None, "", " \n ", "one", "one", "one two", "one two three four five", "two one"]
    for _ in range(30):
        base = r.choices(vocabulary, k=r.randint(20, 150))
        if r.random() < 0.4:
            base = base[:30] + shared + base[30:]
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
    texts += texts[-3:]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("how", [{}, {"limit": 4, "extra_depth": 2, "block": 3}, {"runs": 1, "block_shingles": 300}, {"limit": 2, "extra_depth": 6}])
def test_matches_brute_force(spark, how):
    rows = corpus(7)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, k1 int")
    got = sorted(tuple(r) for r in jaccard.similar_digest(docs, **how).collect())
    assert got == sorted(brute(rows))
    assert sum(r[3] for r in got) > 30


def test_runs_follow_from_the_target():
    assert abs(jaccard.miss_chance(0.8) - 0.0325) < 1e-3 and jaccard.runs_for(1 - 1e-5) == 4
    assert jaccard.runs_for(0.9) == 1 and jaccard.runs_for(1 - 1e-9) > 4 and jaccard.miss_chance(1.0) == 0
    # Against pairs of sets of just that similarity.
    r = random.Random(5)
    met = [0, 0]
    for i in range(1500):
        t = jaccard.np.array(r.sample(range(1 << 60), 220), jaccard.np.uint64)
        a, b = jaccard.np.sort(t[:200]), jaccard.np.sort(t[20:])
        met[0] += not set(jaccard.leaf_paths(a, 1, 2, i % 50).tolist()) & set(jaccard.leaf_paths(b, 1, 2, i % 50).tolist())
        # What a bucket that is too large does: six further tokens.
        long = [set(jaccard.leaf_paths(x, 1, 8, i % 50).tolist()) for x in (a, b)]
        met[1] += not long[0] & long[1]
    want = [jaccard.miss_chance(180 / 220, depth) for depth in (2, 8)]
    assert abs(met[0] / 1500 - want[0]) < 0.015 and abs(met[1] / 1500 - want[1]) < 0.02
    assert want[1] ** jaccard.runs_for() < 2e-5


def test_runs_are_repeated_until_one_finds_nothing_new(spark, monkeypatch):
    """Starting from one run that sees nothing, further runs still bring all links."""
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = []
    links = jaccard._bucket_links

    def counted(keyed, reps, paths, limit, extra_depth, name):
        made.append(name)
        return links(keyed, reps, paths.where("false") if name == "linked" else paths, limit, extra_depth, name)

    monkeypatch.setattr(jaccard, "_bucket_links", counted)
    got = sorted(tuple(r) for r in jaccard.similar_digest(docs, runs=1).collect())
    assert got == sorted(brute(rows)) and len(made) >= 3


def test_very_long_texts(spark):
    """Sets of more shingles than a sketch takes at once, and classes that are split by shingles."""
    r = random.Random(13)
    base = [f"w{r.randrange(10**9)}" for _ in range(30_000)]
    copy, part = list(base), base[:24_500]
    for i in r.sample(range(30_000), 300):
        copy[i] = "x"
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(part)), (4, " ".join(base[:20_000])), (5, "short one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(1, 1, 1, 2), (2, 2, 1, 1), (3, 3, 1, 2), (4, 4, 1, 1), (5, 5, 5, 0)]
    assert sorted(tuple(x) for x in jaccard.similar_digest(docs).collect()) == want == sorted(brute(rows))
    assert sorted(tuple(x) for x in jaccard.similar_digest(docs, block_shingles=30_000).collect()) == want


def test_a_chain_becomes_one_component(spark):
    n = 40
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n)} | {101: 100}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(5, text, "x"), (3, text, "x"), (3, text, "x"), (9, text + " more", "x"), (1, "other words here", "x"), (2, None, "x"), (4, "", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, set string")
    out = jaccard.one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.similar_digest(docs).collect() == []
    assert jaccard.one_of_each_group(docs).collect() == []


def test_words_are_hashed_alike_wherever_they_stand():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab \n\t\x00\xff\x1c\x85") for _ in range(rng.randrange(50))) for _ in range(2000)]
    texts += [b"", b" ", b" ".join(b"x" * n for n in range(1, 200)), b"\n".join(b"x" * n for n in range(199, 0, -1))]
    known: dict[bytes, int] = {}
    for t in texts:
        hashes, start = word_hashes(t)
        assert len(hashes) == len(t.split()) and all(t[p:].startswith(w) for p, w in zip(start.tolist(), t.split(), strict=True))
        assert all(known.setdefault(w, h) == h for w, h in zip(t.split(), hashes.tolist(), strict=True))
    assert len(set(known.values())) == len(known)


def test_sets_do_not_depend_on_what_is_hashed_beside_them():
    texts = [None, "", "one two three four", "a b c d e f g", " a  b c d e f g ", "w " * 600_000, "a b c d e", "x" * 2_000_000, "b c d e f g"]
    sets = [s.tolist() for s in jaccard.shingle_sets(texts)]
    assert sets == [jaccard.shingles(t).tolist() for t in texts]
    assert [len(s) for s in sets] == [0, 0, 1, 3, 3, 1, 1, 1, 2] and sets[3] == sets[4] and set(sets[8]) < set(sets[3]) and sets[6][0] in sets[3]
    assert len(jaccard.shingles(" ".join(map(str, range(30))), 7)) == 24
