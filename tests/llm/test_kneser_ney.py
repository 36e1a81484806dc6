import math
import random
from collections import Counter, defaultdict

from palimpsest.llm import kneser_ney as kn


def brute_model(texts):
    """Interpolated modified Kneser-Ney over strings; returns a function of four characters."""
    start = chr(2) * 3
    c = {4: Counter(g for t in texts for s in [start + t] for g in (s[i : i + 4] for i in range(len(s) - 3)))}
    for n in (3, 2, 1):
        c[n] = Counter(g[1:] for g in c[n + 1])
    d, total, gamma = {}, {}, {}
    for n in c:
        k = Counter(c[n].values())
        y = k[1] / max(1, k[1] + 2 * k[2])
        d[n] = [0.5 if not k[j] else min(float(j), max(0.1, j - (j + 1) * y * k[j + 1] / k[j])) for j in (1, 2, 3)]
        total[n], cut = defaultdict(int), defaultdict(float)
        for g, v in c[n].items():
            total[n][g[:-1]] += v
            cut[g[:-1]] += d[n][min(v, 3) - 1]
        gamma[n] = {x: cut[x] / total[n][x] for x in total[n]}
    uniform = 1 / (len(c[1]) + 1)

    def p(g, n=4):
        g = g[-n:]
        below = uniform if n == 1 else p(g, n - 1)
        x = g[:-1]
        if x not in total[n]:
            return below
        v = c[n].get(g, 0)
        return (v - d[n][min(v, 3) - 1] if v else 0) / total[n][x] + gamma[n][x] * below

    return p, c


def corpus():
    r = random.Random(2)
    text = lambda parts: " ".join("".join(r.choices(parts, k=3)) for _ in range(r.randint(1, 40)))
    docs = [(i, text(["th", "in", "ou", "er"]), "en") for i in range(40)] + [(100 + i, text(["sch", "ung", "ß"]), "de") for i in range(30)]
    docs += [(200, None, "en"), (201, "", "en"), (202, "no model here", "xx"), (203, "zq😀zq ZZ", "en"), (204, "the null one", None), (5, "twice 5", "en")]
    labels = [(i, int(i % 4 > 0), int(i % 7 == 0)) for i in [*range(40), *range(100, 130)]] + [(1, 1, 0), (5, 1, 0), (None, 1, 0)]
    return docs, labels


def test_perplexity_matches_brute_force(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, lang string, kind int")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = [(r["doc_id"], r["n_chars"], r["perplexity"], r["kept"]) for r in kn.classify(df, lab).collect()]
    assert len(got) == len(docs)
    good = {i for i, q, t in labels if q == 1 and t == 0}
    models = {la: brute_model([t for i, t, x in docs if x == la and i in good and t])[0] for la in ("en", "de")}
    for i, t, la in docs:
        mine = [g for g in got if g[0] == i and g[1] == len(t or "")]
        assert mine
        if not t or la not in models:
            assert mine[0][2] is None and mine[0][3] == bool(t)
            continue
        # A character beyond 16 bits is one code unit of a kind.
        s = chr(2) * 3 + "".join(c if ord(c) < 0xFFFF else "￿" for c in t)
        want = math.exp(-sum(math.log(models[la](s[j : j + 4])) for j in range(len(t))) / len(t))
        assert abs(mine[0][2] - want) < 1e-4 * want, (i, mine[0][2], want)


def test_probabilities_sum_to_one():
    p, c = brute_model(["then the thin", "thou thine"])
    chars = [g for g in c[1]]
    assert abs(sum(p("the" + x) for x in chars) + p("the\x00") - 1) < 1e-9


def test_many_blocks_agree_with_one(spark, monkeypatch):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    good = kn.trusted_ids(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    out = []
    # A third of the rows share an id that is trusted, another third have none.
    trusted = {r["doc_id"] for r in good.collect()}
    one = next(d for d in docs if d[0] in trusted and d[1])
    more = [(one[0], f"{one[1]} {i}", "en") for i in range(60)] + [(None, f"{one[1]} {i}", "de") for i in range(60)]
    df = df.unionByName(spark.createDataFrame(more, df.schema))
    for size in (1 << 25, 900):
        dealing = kn.Dealing.of(df, size)
        assert {r["hot_id"] for r in dealing.hot.collect()} == (set() if size > 900 else {one[0], None})
        most = dealing.rows(kn.packed(df)).groupBy("block").count().agg({"count": "max"}).first()[0]
        assert size > 900 or most < 30
        grams = kn.block_grams(df, good, dealing).cache()
        counts = grams.where("c > 0").groupBy((grams.m - kn.ORDER).alias("m"), "g").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c")
        rows = kn.score(df, grams.drop("c"), kn.train(counts), dealing).collect()
        out.append(sorted((str(r["doc_id"]), r["chars"], round(r["logp"] or 0, 3)) for r in rows))
    assert out[0] == out[1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert kn.classify(df, lab).collect() == []
    one = spark.createDataFrame([(1, "x", "en")], "doc_id bigint, text string, lang string")
    assert [(r["perplexity"], r["kept"]) for r in kn.classify(one, lab).collect()] == [(None, True)]


def held_out_corpus():
    r = random.Random(7)
    words = ["".join(r.choices(["th", "in", "ou", "er", "and", "re"], k=r.randint(1, 3))) for _ in range(60)]
    odd = ["".join(r.choices(["zug", "kwa", "plof"], k=2)) for _ in range(8)]
    text = lambda share: " ".join(r.choice(odd if r.random() < share else words) for _ in range(r.randint(60, 120)))
    kinds = [(0, 200, 0.0, 1, 0), (1000, 50, 0.08, 1, 1), (2000, 50, 0.5, 0, 0)]
    docs = [(first + i, text(share), "en") for first, n, share, _, _ in kinds for i in range(n)]
    labels = [(first + i, quality, toxic) for first, n, _, quality, toxic in kinds for i in range(n)]
    return docs + [(5000, docs[0][1], "en")], labels + [(5000, 1, 0)]


def test_threshold_is_the_quantile_of_held_out_documents(spark):
    docs, labels = held_out_corpus()
    got = kn.classify(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    trusted = {i for i, q, t in labels if q == 1 and t == 0}
    folds = [[t for i, t, _ in docs if i in trusted and kn.fold_of(t.encode()) == k] for k in range(kn.FOLDS)]
    assert all(folds)
    held = []
    for k, mine in enumerate(folds):
        p, _ = brute_model([t for j, f in enumerate(folds) if j != k for t in f])
        held += [math.exp(-sum(math.log(p((chr(2) * 3 + t)[j : j + 4])) for j in range(len(t))) / len(t)) for t in mine]
    want = sorted(held)[math.ceil(0.995 * len(held)) - 1]
    assert {abs(r["threshold"] - want) < 1e-4 * want for r in got} == {True}
    kept = {r["doc_id"]: r["kept"] for r in got}
    share = lambda quality, toxic: sum(kept[i] for i, q, t in labels if (q, t) == (quality, toxic)) / sum((q, t) == (quality, toxic) for _, q, t in labels)
    assert share(1, 0) >= 0.98 and share(1, 1) <= 0.1 and share(0, 0) == 0
