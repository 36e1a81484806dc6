import hashlib
import random

from palimpsest.llm import exact

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and how many rows of each text stay."""
    norm = [(i, (t or "").translate(UPPER)) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    first = lambda ids: max(ids, key=lambda i: (i is not None, i or 0))
    return sorted(((i, first(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str), len(groups)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, digest string, row string")


def check(got, rows):
    want, groups = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_against_brute_force(spark):
    r = random.Random(1)
    texts = ["", None, "Same", "sAME", "ÄB", "äb", "É", "é", "x" * 400_000, "X" * 400_000, "İ", "ſ"]
    rows = [(i, r.choice(texts)) for i in r.sample(range(10_000), 300)] + [(20_000 + i, f"single {i}") for i in range(50)]
    rows += [(7, "tie"), (7, "TIE"), (7, "tie"), (None, "no id"), (None, "no id"), (None, "Same"), (rows[0][0], "other text")]
    check(exact.dedup_digest(docs_of(spark, rows)).collect(), rows)
    check(exact.dedup_digest(docs_of(spark, rows), batches=5, buckets=3).collect(), rows)


def test_hot_text_and_all_null_ids(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    check(exact.dedup_digest(docs_of(spark, rows)).collect(), rows)
    rows = [(None, "a"), (None, "A"), (None, None)]
    check(exact.dedup_digest(docs_of(spark, rows)).collect(), rows)
    assert exact.dedup_digest(docs_of(spark, [])).collect() == []


def test_index_is_kept_and_batches_are_added_once(spark, tmp_path):
    path = str(tmp_path / "index")
    index = exact.DigestIndex(spark, path, buckets=4)
    first = docs_of(spark, [(1, "a"), (2, "A"), (3, "b"), (9, "b"), (9, "b"), (None, "c")])
    got = exact.fresh_rows(first, index, "one")
    assert got.columns == first.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(2, "A"), (9, "b"), (None, "c")], key=str)
    again = exact.DigestIndex(spark, path, buckets=16)  # opened as it is stored
    assert again.buckets == 4
    second = docs_of(spark, [(50, "B"), (51, "d"), (52, "D"), (53, "C")])
    for _ in range(2):  # a batch that runs again changes nothing
        assert [(r["doc_id"], r["text"]) for r in exact.fresh_rows(second, again, "two").collect()] == [(52, "D")]
    assert again.rows().count() == 4
    again.compact()
    whole = exact.DigestIndex(spark, path)
    assert whole.version == 1 and whole.rows().count() == 4 and whole.rows().where("batch = 'two'").first()["keep_id"] == 52
    assert exact.fresh_rows(docs_of(spark, [(99, "a"), (100, "e")]), whole, "three").select("doc_id").collect() == [(100,)]


def test_the_index_is_not_exchanged(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(exact.digests(docs_of(spark, [(i, str(i)) for i in range(100)])), "one")
    df = index.missing(exact.digests(docs_of(spark, [(i, str(i)) for i in range(90, 110)])))
    assert df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    # One exchange, that of the new entries; rows are summed up before, not within.
    assert "SortMergeJoin" in final and "LeftAnti" in final and "Bucketed: true" in final and final.count("Exchange hashpartitioning") == 1 and "Aggregate" not in final


def test_digest_lowers_only_a_to_z(spark):
    df = spark.createDataFrame([("AbÄ",), (None,), ("é" * 3 + "Z",)], "text string")
    assert [bytes(r[0]) for r in df.select(exact._digest_of("text")).collect()] == [exact.digest(x) for x in ("AbÄ", None, "éééZ")]
    assert exact.digest("ABÄ") == exact.digest("abÄ") != exact.digest("abä")
