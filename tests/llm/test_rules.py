import random
import re

from palimpsest.llm import rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    return (*counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])


def texts():
    r = random.Random(3)
    out = [None, "", " \n\t", "one", "a " * 40, "\x0b\x0c\r\n", "#a *b\n#a *b\n", " a b", "é\x85ü   x"]
    for _ in range(300):
        w = r.choices(["the", "thing", "éa", "x#", "|", "y\nz", "\n", "  "], k=r.randint(0, 120))
        if r.random() < 0.5:
            a = r.randint(0, max(0, len(w) - 12))
            w = w[: a + 12] * r.randint(1, 3) + w[a:]
        out.append(r.choice([" ", "\n", "\t"]).join(w))
    return out


def test_counts_match_brute_force_and_no_python_runs(spark):
    rows = [(i, t, r, "s", 0) for i, (t, r) in enumerate(zip(texts(), ["en", "de", None] * 200, strict=False))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words int")
    out = rules.judged(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), t
        assert not (r["base_failed"] and r["kept"])
    assert "Python" not in rules.measured(docs)._jdf.queryExecution().executedPlan().toString()


def test_a_very_long_text(spark):
    r = random.Random(12)
    w = ["".join(r.choices("abcdefgh#", k=r.randint(1, 6))) for _ in range(60_000)]
    text = " ".join(w + w[100:400]) + "\n" + "again\n" * 500
    (x,) = rules.judged(spark.createDataFrame([(1, text, "en", "s")], "doc_id bigint, text string, lang string, source string")).collect()
    assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute(text)


def six(v):
    cleared = max(0, v.bit_length() - 6)
    return v >> cleared << cleared


def test_shares_are_rounded_to_one_part_in_32(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 65, 127, 128, 1000, 999_999, 1_000_000]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", rules._rounded(rules.F.col("v")).alias("r")).collect()
    assert all(x["r"] == six(x["v"]) and x["v"] - x["v"] / 32 <= x["r"] <= x["v"] for x in rows)


def test_bounds_follow_exact_quantiles(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["en", "de", None]), r.choice(["a", "b", None]), {m: r.randint(0, 200) * (r.random() < 0.4) for m in rules.MEASURES}) for i in range(2000)]
    df = spark.createDataFrame([(i, la, s, *m.values()) for i, la, s, m in rows], "doc_id int, lang string, source string, " + ", ".join(f"{m} bigint" for m in rules.MEASURES))
    sketch = rules.sketches(df)
    assert sketch.count() <= 9 * 201 * len(rules.MEASURES)
    found = rules.bounds(sketch).collect()
    assert len(found) == 9 + 3 + 1
    for f in found:
        for m in rules.MEASURES:
            v = sorted(x[3][m] for x in rows if f["level"] == 2 or x[1] == f["lang"] and (f["level"] == 1 or x[2] == f["source"]))
            z = [x for x in v if x > 0]
            at = lambda q, v=v: v[-(-len(v) * q // 100) - 1]
            fence = max(at(99), at(75, z) + 3 * (at(75, z) - at(25, z)))
            high = {"m_word": at(75) + 4 * max(1, at(75) - at(25)), "m_symbols": max(2 * at(90), at(50, z) // 8), "m_lines": fence, "m_repeated": fence}
            assert (f["docs"], f[f"high_{m}"]) == (len(v), high[m])
            assert m not in rules.BOTH_ENDS or f[f"low_{m}"] == at(25) - 4 * max(1, at(75) - at(25))


def test_a_measure_that_is_mostly_zero_still_has_thresholds_of_its_own(spark):
    """Quartiles of zero in both sources; in one of them 4 % have symbols, in the other 20 % and some have many more."""
    r = random.Random(8)
    text = lambda n: " ".join([*("".join(r.choices("abcdefgh", k=5)) for _ in range(100 - n)), *("#" + "".join(r.choices("abcdefgh", k=4)) for _ in range(n))])
    rows = [(i, text(20 if i < 4 else 0), "en", "s1") for i in range(100)]
    rows += [(200 + i, text(90 if i < 8 else 20 if i < 20 else 0), "en", "s2") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {x["doc_id"]: x["failed_rule"] for x in rules.judged(docs).collect()}
    failed = {i for i, rule in got.items() if rule == "m_symbols"}
    assert failed == {0, 1, 2, 3, *range(200, 208)}  # 20 symbols are too many in s1, but not in s2
    high = {x["g_source"]: x["high_m_symbols"] for x in rules.limits(rules.sketches(rules.measured(docs))).collect()}
    assert 0 < high["s1"] < high["s2"]


def test_a_small_group_takes_the_languages_thresholds(spark):
    r = random.Random(8)
    text = lambda n: " ".join([*("".join(r.choices("abcdefgh", k=5)) for _ in range(100 - n)), *("#" + "".join(r.choices("abcdefgh", k=4)) for _ in range(n))])
    rows = [(i, text(0), "en", "s1") for i in range(60)] + [(100 + i, text(20), "en", "tiny") for i in range(3)] + [(200, text(20), "xx", "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {x["doc_id"]: x["failed_rule"] for x in rules.judged(docs).collect()}
    assert [got[i] for i in (0, 100, 101, 102, 200)] == [None, "m_symbols", "m_symbols", "m_symbols", "m_symbols"]


def test_thresholds_adapt_to_language_and_source(spark):
    r = random.Random(1)
    plain = lambda k, p: " ".join("".join(r.choices(["th", "in", "ou", "er"], k=r.choice([1, k, 3]))) + p for _ in range(r.randint(60, 100)))
    rows = [(i, plain(2, ""), "en", "s1") for i in range(60)] + [(100 + i, plain(2, "#"), "en", "s2") for i in range(60)] + [(500, plain(2, "#"), "en", "s1"), (501, plain(2, ""), "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {x["doc_id"]: x for x in rules.judged(docs).collect()}
    assert all(got[i]["kept"] for i in range(60)) and all(got[100 + i]["kept"] for i in range(60))
    assert got[500]["failed_rule"] in ("m_word", "m_symbols") and got[501]["kept"]


def test_sound_documents_with_a_few_symbols_stay(spark):
    """A clean table, in which 30 % of the texts name a price: under 1 % may go."""
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.choice([2, 3, 3, 4, 5, 6, 8]))) for _ in range(2000)]
    text = lambda i: " ".join([*r.choices(words, k=r.randint(40, 400)), *(["costs $ 5 & more"] if i % 10 < 3 else [])])
    docs = spark.createDataFrame([(i, text(i), "en", f"s{i % 5}") for i in range(1500)], "doc_id bigint, text string, lang string, source string")
    assert rules.judged(docs).where("not kept").count() < 15


def test_repeats_of_documents_that_fail_the_fixed_limits_do_not_widen_the_others_bounds(spark):
    r = random.Random(22)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    text = lambda again: "\n".join([*(f"{word()} {word()} {word()}" for _ in range(100 - again)), *["once more this"] * again])
    rows = [(i, text(3 if i < 30 else 0), "en", "s1") for i in range(200)] + [(500, text(25), "en", "s1")]
    rows += [(600 + i, "the same words come over and over again " * 30, "en", "s1") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {x["doc_id"]: x["failed_rule"] for x in rules.judged(docs).collect()}
    assert {i for i, rule in got.items() if rule not in (None, "base")} == {500} and all(got[600 + i] == "base" for i in range(50))


def test_empty_table(spark):
    assert rules.judged(spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")).collect() == []
