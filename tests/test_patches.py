import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import features
from palimpsest.operators import linediff, lineage, textdiff
from palimpsest.sources import patches

TWO_HUNKS = """--- a/tests/org/x/Room_T.java
+++ b/tests/org/x/Room_T.java
@@ -1,4 +1,4 @@
 a
 b
-- dash
+c
 d
@@ -9,3 +9,5 @@
 e
+++ plus
+f
 g
 h
"""
REPAIR = """--- a/tests/Calc_T.java
+++ b/tests/Calc_T.java
@@ -5,9 +5,6 @@
 }
 
-@Test(timeout = 4000)
+@Test(expected = NullPointerException.class)
 public void test03() throws Throwable {
-  try { run(null);
-  fail("x");
-  // Undeclared exception!
-  } catch (E e) { verifyException("A", e); }
+  run(null);
 }
"""


@pytest.fixture()
def tree(tmp_path):
    for project, run, cls, test, text in (
        ("7_room", "run_20260127_102943", "_Room", "test00", TWO_HUNKS),
        ("7_room", "run_20260127_102943", "_Room", "test1", REPAIR),
        ("12_c-d", "run_20260128_000001", "Calc", "test03", REPAIR),
    ):
        d = tmp_path / project / run / "patches" / project.split("_")[1] / cls
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{test}.diff").write_text(text)
    return tmp_path


def test_tree_with_hidden_names_and_keys(spark, tree):
    rows = {(r["project_id"], r["test_name"]): r for r in patches.read_tree(spark, str(tree)).collect()}
    assert set(rows) == {(7, "test00"), (7, "test1"), (12, "test03")}
    r = rows[7, "test00"]
    assert (r["project"], str(r["run_ts"]), r["class_name"], r["test_no"], r["source_path"], r["package"]) == ("room", "2026-01-27 10:29:43", "_Room", 0, "tests/org/x/Room_T.java", "org.x")
    assert rows[12, "test03"]["project"] == "c-d" and rows[12, "test03"]["package"] == ""
    stamped = patches.read_tree(spark, str(tree)).select(patches.run_stamp("run_ts").alias("s")).distinct().collect()
    assert {x["s"] for x in stamped} == {"run_20260127_102943", "run_20260128_000001"}


def test_lines_are_classed_by_place(spark, tree):
    df = patches.read_tree(spark, str(tree))
    lines = patches.patch_lines(df)
    got = [tuple(r) for r in lines.where("test_name = 'test00'").orderBy("line_no").select("hunk_no", "line_no", "op", "old_no", "new_no", "text").collect()]
    assert got == [
        (1, 4, " ", 1, 1, "a"), (1, 5, " ", 2, 2, "b"), (1, 6, "-", 3, None, "- dash"), (1, 7, "+", None, 3, "c"), (1, 8, " ", 4, 4, "d"),
        (2, 10, " ", 9, 9, "e"), (2, 11, "+", None, 10, "++ plus"), (2, 12, "+", None, 11, "f"), (2, 13, " ", 10, 12, "g"), (2, 14, " ", 11, 13, "h"),
    ]
    assert [tuple(r)[4:] for r in patches.hunks(df).where("test_name = 'test00'").orderBy("hunk_no").collect()] == [(1, 1, 4, 1, 4), (2, 9, 3, 9, 5)]
    both = patches.sides(lines).where("test_name = 'test00'").first()
    assert both["before"] == "a\nb\n- dash\nd\ne\ng\nh" and both["added"] == "c\n++ plus\nf" and (both["n_added"], both["n_removed"], both["n_context"]) == (3, 1, 6)


@pytest.mark.parametrize("bad", ["", "x", TWO_HUNKS + " extra\n", TWO_HUNKS[:-4], TWO_HUNKS.replace("@@ -9,3", "@@ -9,4")])
def test_bad_patches_are_refused(bad):
    with pytest.raises(ValueError):
        list(patches.parse_lines(bad))


def test_written_tree_is_partitioned(spark, tree, tmp_path):
    df = patches.read_tree(spark, str(tree))
    patches.write_tree(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3 and back.where("project = 'room' and run = 'run_20260127_102943'").count() == 2


def test_features_and_flags(spark, tree):
    rows = features.flags(features.counts(patches.sides(patches.patch_lines(patches.read_tree(spark, str(tree)))), "before", "after"))
    r = rows.where("test_name = 'test03'").first()
    assert (r["try_blocks_before"], r["try_blocks_after"], r["expected_after"], r["verify_exception_before"], r["undeclared_notes_before"]) == (1, 0, 1, 1, 1)
    assert r["try_to_expected"] and not r["try_lost"] and r["timeout_dropped"] and r["expected_type"] == "NullPointerException" and r["net_lines"] == -3
    total = features.rollup(rows, "project_id").where("project_id is null").first()
    assert total["methods"] == 3 and total["try_to_expected"] == 2


def test_shared_scans_count_what_each_pattern_counts(spark):
    r = random.Random(5)
    bits = ["assertEquals(-3, x)", "assertEquals ( 4", "assertEquals(x", "assertTrue(", "assertFoo (\n", "assert(", "try {", "try{", "tryy {", "finally  {", "for (int", "fail(\"x\")", "verifyException (", "a.setAccessible(true)", "getDeclaredField(",
        "throws Exception ", "throws  Exception", "// Undeclared exception!", "Unstable assertion", "x instanceof Y", "@Test(timeout = 4000, expected = E.class)", "@Test ( expected", "timeout", ".set(", ". add (", ".putAll(", "é", "日本", "\n", " ", "\"", "assertThrows(fail("]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ";\n"]) for _ in range(r.randint(0, 30))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(t, t and t[::2]) for t in texts], "b string, a string")
    wanted = features.PATTERNS | {f"assert_{a.lower()}": rf"\bassert{a}\s*\(" for a in features.ASSERTIONS}
    rows = features.counts(df, "b", "a")
    assert set(rows.columns) == {"a", "b"} | {f"{k}_{s}" for k in wanted for s in ("before", "after")}
    bad = [k for k, p in wanted.items() if rows.where((F.col(f"{k}_before") != features.count_of("b", p)) | (F.col(f"{k}_after") != features.count_of("a", p))).count()]
    assert bad == []


lines_of = st.lists(st.sampled_from(["a", "b", "-- x", "+++ y", "@@ -1,1 +1,1 @@", "", " z"]), max_size=30)


@given(lines_of, lines_of)
@settings(max_examples=200, deadline=None)
def test_diff_then_apply_gives_the_new_text(before, after):
    a, b = ("".join(x + "\n" for x in y) for y in (before, after))
    d = textdiff.unified(a, b, "p")
    assert textdiff.applied(a, d) == b
    n = [op for _, _, op, *_ in patches.parse_lines(d)] if d else []
    assert n.count("+") - n.count("-") == len(after) - len(before)


ANY_TEXT = st.text(st.sampled_from("ab\n\r\x0b\x0c\x1c\x85\u2028 -+@\\"), max_size=40)


@given(ANY_TEXT, ANY_TEXT)
@settings(max_examples=500, deadline=None)
def test_any_line_ends_come_back(before, after):
    d = textdiff.unified(before, after, "p")
    assert textdiff.applied(before, d) == after and (d == "") == (before == after)
    if d and before:
        assert textdiff.fitted(before + "\nmore" * 3 + before, d) != after


def test_missing_newline_is_marked_as_usual():
    d = textdiff.unified("a\nc", "a\nc\n", "p")
    assert d == "--- a/p\n+++ b/p\n@@ -1,2 +1,2 @@\n a\n-c\n\\ No newline at end of file\n+c\n"
    assert [(x[1], x[2], x[6]) for x in patches.parse_lines(d)] == [(4, " ", True), (5, "-", False), (7, "+", True)]
    assert textdiff.unified("", "x", "p").splitlines()[2] == "@@ -0,0 +1,1 @@" and textdiff.applied("q\nr\n", "--- a/p\n+++ b/p\n@@ -1,0 +2 @@\n+new\n") == "q\nnew\nr\n"
    for bad in ("--- a\n+++ b\n@@ -1 +1 @@\n\\ x\n-a\n+b\n", "--- a\n+++ b\n@@ -1,1 +1,0 @@\n+a\n"):
        with pytest.raises(ValueError):
            textdiff.applied("a\n", bad)
    with pytest.raises(ValueError, match="no end"):
        textdiff.applied("a\nb\n", "--- a\n+++ b\n@@ -1 +1 @@\n-a\n+c\n\\ No newline at end of file\n")


def test_diff_of_many_lines():
    r = random.Random(1)
    for line in (lambda i: f"line {i}", lambda i: "}" if i % 2 else f"x{r.randint(0, 50)}", lambda i: "}"):
        a = [line(i) for i in range(100_000)]
        b = [x for x in a if r.random() > 0.01]
        for _ in range(500):
            b.insert(r.randrange(len(b)), r.choice(["new", "}", "x3"]))
        began = time.time()
        d = textdiff.unified("\n".join(a), "\n".join(b), "p")
        assert textdiff.applied("\n".join(a), d) == "\n".join(b) and time.time() - began < 30


def test_matching_is_in_order_and_longest_in_small_gaps(monkeypatch):
    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        return t[0][0]

    r = random.Random(2)
    anchors = linediff._anchors
    for costly, even in ((1000, True), (1000, False), (1, True), (1, False)):
        monkeypatch.setattr(linediff, "COSTLY", costly)
        monkeypatch.setattr(linediff, "_anchors", anchors if even else lambda a, b, box, even: [] if even else anchors(a, b, box, even))
        for _ in range(500):
            a, b = ([r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 14))] for _ in "ab")
            i = j = 0
            for x, y, n in linediff.matching(a, b):
                assert x >= i and y >= j and n and a[x : x + n] == b[y : y + n]
                i, j = x + n, y + n
            if costly > 1 and not even:
                assert sum(n for *_, n in linediff.matching(a, b)) == longest(a, b)


def test_increasing_run():
    r = random.Random(3)
    for _ in range(200):
        js = [r.randint(0, 20) for _ in range(r.randint(0, 15))]
        got = linediff.increasing(list(enumerate(js)))
        best = [1] * len(js)
        for i in range(len(js)):
            best[i] = 1 + max((best[k] for k in range(i) if js[k] < js[i]), default=0)
        assert len(got) == max(best, default=0) and all(x[1] < y[1] and x[0] < y[0] for x, y in zip(got, got[1:], strict=False))


SOURCE = '''class T {
  @Test(timeout = 4000)
  public void test1() throws Throwable {
    String s = "}"; // }
    char c = '}'; /* } */ if (true) { run(); }
  }

  public void test10() { }
}
'''


def test_method_replacement():
    a, b = textdiff.method_slice(SOURCE, "test1")
    assert SOURCE[a:b].lstrip().startswith("@Test") and SOURCE[a:b].endswith("run(); }\n  }")
    out = textdiff.replaced_method(SOURCE, "test1", "\n@Test\n  public void test1() { }\n\n")
    assert "\n@Test\n  public void test1() { }\n" in out and "run()" not in out and "test10" in out
    assert textdiff.replaced_method(SOURCE, "none", "x") is None


def test_method_without_a_body_and_text_blocks():
    source = 'interface I {\n  // void t() {\n  String s = "void t() {";\n  void t();\n\n  void u() { String s = """\n } " } \\""" {\n """; }\n  @A("x;y")\n  void v(int a);\n}\n'
    assert textdiff.replaced_method(source, "t", "void t() { }") == source.replace("  void t();", "void t() { }\n")
    assert textdiff.replaced_method(source, "u", "void u();") == source[: source.index("  void u")] + "void u();\n" + source[source.index('\n  @A("x') :]
    a, b = textdiff.method_slice(source, "v")
    assert source[a:b] == '  @A("x;y")\n  void v(int a);'
    assert textdiff.method_slice("// void t() { }\n/* void t() { } */", "t") is None and textdiff.method_slice("void t() {", "t") is None


def test_fold_rejects_what_has_no_source(spark):
    add = "--- a/p\n+++ b/p\n@@ -0,0 +1,1 @@\n+x\n"
    sources = spark.createDataFrame([("empty", ""), ("null", None)], "key string, text string")
    rows = spark.createDataFrame([("empty", 1, add), ("empty", 2, None), ("null", 1, add), ("none", 1, add)], "key string, seq int, raw string")
    got = {tuple(r) for r in textdiff.fold_patches(sources, rows, "key").collect()}
    assert got == {("empty", "x\n", 1, 1), ("null", None, 0, 1), ("none", None, 0, 1)}


def test_fold_applies_in_the_order_of_the_data(spark):
    one, two, three = "a\nb\nc\n", "a\nB\nc\n", "a\nB\nC\n"
    rows = [("k", 2, textdiff.unified(two, three, "p")), ("k", 1, textdiff.unified(one, two, "p")), ("k", 3, textdiff.unified(one, two, "p"))]
    got = textdiff.fold_patches(spark.createDataFrame([("k", one), ("other", "x\n")], "key string, text string"), spark.createDataFrame(rows, "key string, seq int, raw string"), "key")
    assert {tuple(r) for r in got.collect()} == {("k", three, 2, 1), ("other", "x\n", 0, 0)}


def test_signature_visibility(spark):
    one = "void t() {"
    rows = [("both", one, one, one), ("added", "", "", one), ("removed", one, one, ""), ("context", one, "x", "y"), ("nowhere", "a", "b", "c")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "want string, before string, removed string, added string, name string")
    assert all(r["visible"] == r["want"] for r in lineage.signature_visibility(df, "name").collect())


def test_lineage(spark):
    rows = spark.createDataFrame([("k", 1, "a", "b"), ("k", 2, "b", "c"), ("k", 3, "b", "d"), ("k", 5, "x", "y"), ("m", 1, None, "q"), ("m", 2, "q", "r")], "key string, n int, before string, after string")
    got = lineage.chains(rows, ["key"], ["n"], "before", "after").orderBy("key", "n").collect()
    assert [r["relation"] for r in got] == ["first", "chained", "restarted", "other", "first", "chained"]
    assert {(r["key"], r["n"]) for r in lineage.latest(rows, ["key"], "n").collect()} == {("k", 5), ("m", 2)}
    assert {(r["n"], r["next_state"]) for r in lineage.neighbours(rows, ["key"], "n", "before").where("key = 'k'").collect()} == {(1, "b"), (2, "b")}
    same = lineage.distinct_edits(rows.unionByName(rows.where("n = 1")), ["key"], "before", "after")
    assert sorted(r["copies"] for r in same.collect()) == [1, 1, 1, 1, 2, 2]
    assert lineage.violations(rows, "after", ["c"]).select("marker").collect()[0][0] == "c"


def test_malformed_patches_are_told_apart(spark):
    good = "--- a/T.java\n+++ b/T.java\n@@ -1,1 +1,1 @@\n-a\n+b\n"
    raws = [good, "no patch", good + "@@ -9,2 +9,1 @@\n-x\n", None, good + "\ntail"]
    rows = spark.createDataFrame([(i, "r", "C", "t", x) for i, x in enumerate(raws)], "project_id int, run_ts string, class_name string, test_name string, raw string")
    faults = [r["f"] for r in rows.select("project_id", patches.fault("raw").alias("f")).orderBy("project_id").collect()]
    assert faults[0] is None and all(faults[1:]) and faults[3] == "null"
    assert {r["project_id"] for r in patches.patch_lines(rows, strict=False).collect()} == {0}
    for i, why in enumerate(faults):
        if why:
            with pytest.raises(Exception, match=why):
                patches.patch_lines(rows.where(f"project_id = {i}")).collect()


def test_order_of_work_comes_from_what_patches_show(spark):
    rows = [
        ("A", 1, "x", "old1", "new1"), ("A", 2, "new1 y", "old2", "new2"),  # 2 sees 1 repaired
        ("B", 1, "new2", "old1", "new1"), ("B", 2, "old1", "old2", "new2"),  # 1 sees 2 repaired
        ("C", 1, "old2", "old1", "new1"), ("C", 2, "old1", "old2", "new2"),  # neither took effect for the other
        ("D", 1, "", "old1", "new1"), ("D", 2, "", "old2", "new2"), ("D", 4, "new2", "o", "n"),  # not next to each other
        ("E", 1, None, "old1", "new1"), ("E", 2, "old1", None, "new2"),
    ]
    df = spark.createDataFrame(rows, "c string, no int, context string, removed string, added string")
    got = {(r["c"], r["no"]): r["order"] for r in lineage.evidence(df, ["c"], "no").collect()}
    assert got == {("A", 1): "this first", ("B", 1): "next first", ("C", 1): "unapplied", ("D", 1): "unknown", ("E", 1): "unknown"}
