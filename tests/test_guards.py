import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from palimpsest.functions import guards

# text, name, present, first marker
CASES = [
    ("void test1() {}", "test1", True, None),
    ("void test10() {}", "test1", False, None),
    ("int test1() {}", "test1", False, None),
    ("// void test1(", "test1", True, None),
    ("void  test1 (", "test1", True, None),
    ("void test1\n(", "test1", True, None),
    ("xvoid test1(", "test1", False, None),
    ("évoid test1(", "test1", False, None),
    ("void test1(", "test1", True, None),
    ("void　test1(", "test1", True, None),
    ("void\x0btest1(", "test1", True, None),
    ("void a.b(", "a.b", True, None),
    ("void aXb(", "a.b", False, None),
    (r"void \Ex(", r"\Ex", True, None),
    ("@Ignore void t(", "t", True, "@Ignore"),
    ("@org.junit.Ignore void t(", "t", True, "org.junit.Ignore"),
    ("import org.junit.Ignore; @Ignore void t(", "t", True, "@Ignore"),
    ("@IgnoreFoo void t(", "t", True, "@Ignore"),
    ("", "t", False, None),
    (None, "t", False, None),
]


def test_guards(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, java string, name string, present boolean, marker string")
    for r in guards.guard(rows, "java", "name").collect():
        assert (r["method_present"], r["first_marker"]) == (r["present"], r["marker"]), r
        assert r["ok"] == (r["present"] and r["marker"] is None)
        assert r["message"] == (None if r["ok"] else f"Disallowed marker found: {r['marker']}" if r["present"] else f"Test method disappeared: {r['name']}")
    one = rows.select(guards.method_present("java", "test1").alias("p"), "present", "name").where("name = 'test1'").collect()
    assert all(r["p"] == r["present"] for r in one)


def test_enforced_stops_the_job_with_the_message(spark):
    good = spark.createDataFrame([("void t(", "t")], "java string, name string")
    assert guards.enforced(good, "java", "name").count() == 1
    bad = good.select(F.lit("@Ignore void t(").alias("java"), "name")
    with pytest.raises(PySparkException, match="Disallowed marker found: @Ignore"):
        guards.enforced(bad, "java", "name").collect()


def test_no_python_and_no_exchange(spark):
    rows = spark.createDataFrame([("a", "b")], "java string, name string")
    plan = guards.guard(rows, "java", "name")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
