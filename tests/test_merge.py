import random

from palimpsest.operators import merge
from palimpsest.operators.linediff import lines_of, matching


def brute(base, left, right):
    """Chunks from the lines that are the same in all three: between two of those, what the sides have."""
    at = lambda side: {i + k: j + k for i, j, n in matching(base, side) for k in range(n)}
    x, y = at(left), at(right)
    stable = [(i, x[i], y[i]) for i in range(len(base)) if i in x and i in y] + [(len(base), len(left), len(right))]
    out, b, p, q = [], 0, 0, 0
    for i, j, k in stable:
        sides = base[b:i], left[p:j], right[q:k]
        if any(sides):
            if sides[1] == sides[2] or sides[2] == sides[0]:
                out.append(("ok", sides[1]))
            else:
                out.append(("ok", sides[2]) if sides[1] == sides[0] else ("conflict", *sides))
        if i < len(base):
            out.append(("ok", [base[i]]))
        b, p, q = i + 1, j + 1, k + 1
    return out


def test_against_brute_force():
    r = random.Random(1)
    for _ in range(3000):
        base, left, right = ("".join(r.choice("abcd"[: r.randint(2, 4)]) + "\n" for _ in range(r.randint(0, 9))) for _ in range(3))
        if r.random() < 0.5:
            left = right = base
            for _ in range(2):
                i = r.randint(0, len(base) // 2) * 2
                left, right = (left[:i] + "x\n" + left[i + 2 :], right[: len(base) - i] + "y\n" + right[len(base) - i :]) if len(base) % 2 == 0 else (left, right)
        want = brute(*map(lines_of, (base, left, right)))
        text, conflicts = merge.merge3(base, left, right)
        join = "".join
        assert [c[1:] for c in conflicts] == [tuple(map(join, x[1:])) for x in want if x[0] == "conflict"]
        assert text == join(join(x[1]) if x[0] == "ok" else merge.LEFT + join(x[2]) + merge.BASE + join(x[1]) + merge.MIDDLE + join(x[3]) + merge.RIGHT for x in want)


def test_sides_and_laws():
    assert merge.merge3("a\nb\nc\n", "A\nb\nc\n", "a\nb\nC\n") == ("A\nb\nC\n", [])
    assert merge.merge3("a\nb\n", "a\nX\n", "a\nX\n") == ("a\nX\n", [])
    assert merge.merge3("a", "a\n", "a") == ("a\n", []) and merge.merge3("", "x\n", "") == ("x\n", [])
    text, conflicts = merge.merge3("a\nb", "a\nX", "a\nY\r\n")
    assert conflicts == [(2, "b", "X", "Y\r\n")] and text == "a\n<<<<<<< left\nX\n||||||| base\nb\n=======\nY\r\n>>>>>>> right\n"


def test_columns_and_conflict_rows(spark):
    rows = [(1, "a\nb\nc\n", "A\nb\nc\n", "a\nb\nC\n"), (2, "a\n", "x\n", "y\n"), (3, None, "x", "y"), (4, "", "", "")]
    df = spark.createDataFrame(rows, "id int, b string, l string, r string").withColumn("m", merge.merged("b", "l", "r"))
    got = {r["id"]: r["m"] for r in df.select("id", "m").collect()}
    assert got[1]["text"] == "A\nb\nC\n" and got[1]["conflicts"] == [] and (got[3] is None or got[3]["text"] is None) and got[4]["text"] == ""
    assert [tuple(r) for r in merge.conflict_rows(df, "m", "id").collect()] == [(2, 1, "a\n", "x\n", "y\n")]


def test_long_texts_come_few_at_a_time(spark):
    import pandas as pd

    from palimpsest.functions.batches import BATCH_BYTES
    from palimpsest.operators import textdiff

    long = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1 << 20) text")
    count = lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches)
    for use in (lambda: merge.merged("text", "text", "text"), lambda: textdiff.diff("text", "text", "id"), lambda: textdiff.fold_patches(long, long.selectExpr("id", "1 seq", "text raw"), "id")):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        use()
        got = [r["n"] for r in long.mapInPandas(count, "n int").collect()]
        assert sum(got) == 40 and max(got) <= (BATCH_BYTES >> 20) + 1
