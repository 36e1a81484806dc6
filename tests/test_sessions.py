import random

from palimpsest.operators.sessions import sessions


def brute(rows, gap):
    out = []
    for key in {k for k, _ in rows}:
        for t in sorted(t for k, t in rows if k == key and t is not None):
            if out and out[-1][0] == key and t - out[-1][2] < gap:
                out[-1] = (key, out[-1][1], t, out[-1][3] + 1)
            else:
                out.append((key, t, t, 1))
    return sorted(out, key=str)


def test_sessions_in_any_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(0, 3000)])) for _ in range(500)] + [("run", i) for i in range(200)] + [("run", 7)] * 30
    df = spark.createDataFrame(rows, "k string, t int")
    for gap in (1, 9, 10_000):
        for n in (1, 11):
            assert sorted(map(tuple, sessions(df, "k", "t", gap, ranges=n).collect()), key=str) == brute(rows, gap)
    assert sessions(df.where("false"), "k", "t", 5).collect() == []
