import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from palimpsest.llm import language, queries

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    rows = queries.op8_language_id(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in truth if crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_filters_name_every_language_of_a_gram():
    grams = {"a": ["abc", "xyz"], "b": ["xyz"], "c": []}
    f = language.Filters.build(grams)
    shares, sizes = f.shares([" abcxyz ", "abc", "qqq"])
    assert sizes.tolist() == [6, 1, 1]
    assert np.allclose(shares[1], [1, 0, 0]) and np.allclose(shares[2], 0) and shares[0][0] > shares[0][1] > 0
    many = language.Filters.build({f"l{i:02}": [chr(97 + i % 26) * 3 + "x"[: i // 26]] for i in range(30)})
    assert many.slots.dtype == np.uint64


def test_false_positives_are_taken_out():
    r = np.random.default_rng(1)
    gram = lambda: "".join(map(chr, r.integers(97, 123, 3)))
    f = language.Filters.build({"a": [gram() for _ in range(3000)], "b": [gram() for _ in range(50)]}, bits=12)
    other = "".join(chr(c) for c in r.integers(0x4E00, 0x9F00, 4000))
    shares, _ = f.shares([other])
    assert f.false_rates[0] > 0.3 and shares[0][0] < 0.1


def test_edge_cases(spark):
    f = language.Filters.build({"de": [" un", "und", "nd "], "en": [" an", "and", "nd "]})
    rows = [(1, "und", 1), (2, None, 1), (3, "", 1), (4, "123 !?", 1), (5, "AND and", 1), (5, "AND and", 1), (None, "x" * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"] > 0) for r in language.identify(docs, f).collect()), key=str)
    assert got == sorted([(1, "de", True), (2, "und", False), (3, "und", False), (4, "und", False), (5, "en", True), (5, "en", True), (None, "de", False)], key=str)
    kept = language.keep_languages(docs, f)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 5]
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    none = language.fit(empty)
    assert none.predict(["und"]) == (["und"], [0.0]) and language.identify(empty, none).collect() == []


def test_learning_uses_only_its_documents(spark):
    rows = [(i, "abc abd " * 5, "en") for i in range(20)] + [(50 + i, "xyz xyw " * 5, "fr") for i in range(20)] + [(90, None, "en"), (91, "text", None)]
    f = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert f.languages == ["en", "fr"] and f.predict(["abc", "xyw"])[0] == ["en", "fr"]


def test_eighty_languages_in_two_words(spark):
    """More languages than a word has bits, each told from the others; the last ones too."""
    r = random.Random(3)
    names = [f"l{i:02}" for i in range(80)]
    alphabets = {n: [chr(0x4E00 + 40 * i + j) for j in range(40)] for i, n in enumerate(names)}
    text = lambda n: "".join(r.choices(alphabets[n], k=60)) + " " + "".join(r.choices("abcdefgh ", k=30))
    rows = [(None if i % 2 else i, text(n), n) for i, n in enumerate(names * 30)]
    f = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert f.languages == names and f.slots.shape[0] == 2
    # Texts of trigrams that were learnt, so that every language has a right answer.
    found = f.predict([rows[i][1] for i in range(80)])
    assert found[0] == names and min(found[1]) > 0.5


def test_sampling_does_not_hang_on_doc_id(spark):
    """Rows without an id are picked by text, about as many as asked for, and repeated rows are learnt from once."""
    rows = [(None, f"text number {i}", "en") for i in range(4000)] + [(7, "said again", "en")] * 4000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    share = lambda x: spark.createDataFrame([("en", x)], "lang string, share double")
    assert 330 < language.sample(docs, share(0.1)).where("text != 'said again'").count() < 470
    assert language.sample(docs, share(1.0)).count() == 4001
    assert language.fit(docs, docs_per_language=400).languages == ["en"]


def brute_fit(rows, least_share=1 / 20_000):
    counts = defaultdict(Counter)
    for _, text, lang in {r for r in rows if r[1] is not None and r[2] is not None}:
        t = language.letters(text)
        counts[lang].update(t[i : i + 3] for i in range(len(t) - 2))
    return {lang: {g for g, n in c.items() if n >= least_share * c.total()} for lang, c in counts.items()}


def brute_predict(text, grams, bits):
    """Each language's set of slots, one trigram at a time."""
    mask = (1 << bits) - 1
    places = lambda g: [(h := int(language.trigram_hashes(g)[0])) & mask, (h >> 21) & mask, (h >> 42) & mask]
    slots = {lang: {p for g in own for p in places(g)} for lang, own in grams.items()}
    t = language.letters(text or "")
    if not t:
        return "und", 0.0
    best = ("", -1.0)
    for lang in sorted(slots):
        rate = (len(slots[lang]) / (mask + 1)) ** 3
        hits = sum(all(p in slots[lang] for p in places(t[i : i + 3])) for i in range(len(t) - 2))
        share = min(1, max(0, (hits / (len(t) - 2) - rate) / (1 - rate)))
        if share > best[1]:
            best = (lang, share)
    return best


def test_the_query_matches_a_brute_force_predictor(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    learnt = brute_fit([d for d in docs if crc32(str(d[0]).encode()) % 4 != 2])
    bits = max(16, (12 * max(map(len, learnt.values())) - 1).bit_length())
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op8_language_id(spark, SF).collect()}
    short = sorted(docs, key=lambda d: len(d[1] or ""))[:60]
    for i, text, _ in short:
        want = brute_predict(text, learnt, bits)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-9, i
