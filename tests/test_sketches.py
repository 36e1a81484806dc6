from pyspark.sql import functions as F

from palimpsest.operators import sketches


def test_errors_are_within_their_bounds_after_merging(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("id % 10 run", "id % 2 kind", "id % 60000 thing", "double(id) number")
    table = sketches.sketched(rows, ["run", "kind"], "thing", "number")
    assert table.count() == 10
    one = sketches.combined(table, []).select(sketches.distinct("theta"), sketches.distinct_small("hll"), *(sketches.quantile("kll", q) for q in (0.1, 0.5, 0.9)), "rows").first()
    assert one["rows"] == n
    assert abs(one[0] / 60_000 - 1) < 4 / 2 ** (sketches.THETA_BITS / 2) and abs(one[1] / 60_000 - 1) < 4 * 0.8 / 2 ** (sketches.HLL_BITS / 2)
    assert all(abs(one[2 + i] / n - q) < 0.017 for i, q in enumerate((0.1, 0.5, 0.9)))


def test_sets_and_few_things_are_exact(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(1000)] + [("b", i, None) for i in range(400, 1200)] + [("b", None, 3.0)], "kind string, thing int, number double")
    t = sketches.combined(sketches.sketched(rows, ["kind"], "thing", "number"), ["kind"])
    a, b = (t.where(F.col("kind") == k).select(F.col("theta").alias(k), F.col("kll").alias(f"{k}_kll")) for k in "ab")
    r = a.crossJoin(b).select(sketches.distinct("a"), sketches.distinct("b"), sketches.only("a", "b"), sketches.both("a", "b"), sketches.quantile("b_kll", 0.5)).first()
    assert tuple(r) == (1000, 800, 400, 600, 3.0)


def test_weeks_with_more_users_than_a_sketch_has_room_for_are_exact(spark, tmp_path):
    import duckdb

    from palimpsest.plans import registry

    # A full week, one with a user that is none, one without either kind, and events of no time.
    rows = spark.range(60_000).selectExpr("id event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(id % 7)) ts", "id % 40009 user_id", "if(id % 5 < 3, 'purchase', 'error') event_type", "double(id) value")
    rows = rows.unionByName(rows.where("event_id < 900").selectExpr("event_id", "ts + make_dt_interval(7) ts", "nullif(user_id, 7) user_id", "event_type", "value"))
    rows = rows.unionByName(rows.where("event_id < 9").selectExpr("event_id", "ts + make_dt_interval(700) ts", "user_id", "'view' event_type", "value"))
    rows = rows.unionByName(rows.where("event_id < 9").selectExpr("event_id", "cast(null as timestamp_ntz) ts", "user_id", "event_type", "value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in registry.queries()["sketch_table"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert len(got) > 3 and sorted(got, key=str) == sorted(con.sql(registry.oracle_sql()["sketch_table"]).fetchall(), key=str)
