import random

from palimpsest.operators import asof


def brute(left, right, strict):
    out = []
    for i, k, t in left:
        ok = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and (r[1] < t if strict else r[1] <= t)]
        out.append((i, k, t, max(ok, key=lambda r: (r[1], r[2]))[2] if ok else None))
    return sorted(out, key=str)


def test_as_of_with_a_hot_key_and_any_ranges(spark):
    r = random.Random(1)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None] + [f"k{i}" for i in range(20)])
    time = lambda: r.choice([None] + list(range(60)))
    left, right = [(i, key(), time()) for i in range(400)], [(key(), time(), i) for i in range(200)]
    left += left[:5]  # repeated rows come back each
    df, dg = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, at int, no int")
    for strict in (False, True):
        for n in (1, 9):
            got = asof.as_of(df, dg, ["k"], "t", "at", "no", strict=strict, ranges=n).selectExpr("id", "k", "t", "found.no").collect()
            assert sorted(map(tuple, got), key=str) == brute(left, right, strict)


def test_a_hot_key_lies_in_many_ranges(spark):
    df = spark.range(20_000).selectExpr("'hot' k", "id t")
    got = asof.as_of(df, df.where("t % 100 = 0"), ["k"], "t", "t", ranges=16)
    assert got.where("found.t <> t - t % 100").count() == 0 and got.count() == 20_000
    stored = asof.stored(df.repartitionByRange(16, "k", "t").withColumn("p", asof.F.spark_partition_id()), "x")
    assert stored.groupBy("p").count().agg({"count": "max"}).first()[0] < 5000


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, "a", 5)], "id int, k string, t int")
    assert asof.as_of(df, df.where("false"), ["k"], "t", "t").collect() == [(1, "a", 5, None)]
    assert asof.as_of(df.where("false"), df, ["k"], "t", "t").collect() == []


def test_intervals_of_any_length(spark):
    r = random.Random(2)
    ends = lambda s: s + r.choice([-1, 0, 1, 2, 3, 64, 65, 1000, 2**40, 2**53 + 1])
    spans = [(i, r.choice(["a", "b", None]), s, ends(s)) for i in range(60) for s in [r.choice([-(2**40), -70, -1, 0, 5, 63, 64, 900])]] + [(99, "a", None, 5), (98, "a", 5, None)]
    points = [(i, r.choice(["a", "b", None]), r.choice([None, -(2**40), -71, -70, -2, -1, 0, 1, 4, 5, 6, 63, 64, 65, 128, 899, 1000, 2**39, 2**53])) for i in range(80)]
    got = asof.within(spark.createDataFrame(points, "p int, k string, t bigint"), spark.createDataFrame(spans, "i int, k string, s bigint, e bigint"), ["k"], "t", "s", "e").selectExpr("p", "found.i")
    want = sorted((p, i) for p, k, t in points for i, q, s, e in spans if None not in (k, t, s, e) and k == q and s <= t < e)
    assert sorted(map(tuple, got.collect())) == want
