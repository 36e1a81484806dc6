import json
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest.functions import patch_functions
from palimpsest.operators import textdiff
from palimpsest.sources import audit, external, patches, storage
from palimpsest.streaming import audit_stream, joined


def test_followed_in_time_once_and_outer_on_expiry(spark, tmp_path):
    def stream(name, files, columns):
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, f"{columns}, s long").withColumn("at", joined.F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / name / str(i)))
        schema = spark.read.parquet(str(tmp_path / name / "0")).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))

    records = [[("a", 1, 1000), ("b", 2, 1000)], [("a", 1, 1000), ("a", 3, 1500)], [("x", 9, 9000)], [("x", 10, 99_000)]]
    others = [[("a", 11, 1060)], [("a", 11, 1060), ("a", 12, 1600), ("b", 13, 1601), ("b", 14, 999)], [("x", 99, 9000)], [("x", 98, 99_000)]]
    out = joined.followed(stream("l", records, "key string, id int"), stream("r", others, "key string, other int"), "key", "id", "other", "10 MINUTES", late="20 minutes")
    q = out.writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    got = sorted((r["id"], r["other"] or 0) for r in spark.table("followed").collect() if r["id"] < 10)
    assert got == [(1, 11), (1, 12), (2, 0), (3, 12), (9, 99)]
    # What both watermarks have passed is no longer kept: only the last records are.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    recs = lambda n: audit.records(spark.range(n).selectExpr("id", "double(id) ts"), "e", "ts", "id")
    audit.append(recs(2), log)
    assert [audit.append_batch(recs(3), log, "w", 0), audit.append_batch(recs(3), log, "w", 0), audit.append_batch(recs(4), log, "w", 1), audit.append_batch(recs(3), log, "v", 0)] == [True, False, True, True]
    assert audit.read(spark, log).count() == 2 + 3 + 4 + 3
    (tmp_path / "log" / "_lost").mkdir()
    (tmp_path / "log" / "_lost" / "part-0.txt").write_text(json.dumps({"ts": 1, "event": "half"}) + "\n")
    assert audit.read(spark, log).count() == 12  # what a lost run has left is not read
    q = audit_stream.read_stream(spark, log).select("ts").writeStream.format("memory").queryName("whole_log").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and spark.table("whole_log").count() == 12
    assert not [p for p in Path(log).iterdir() if p.name.startswith("_") and p.name not in ("_lost", "_SUCCESS")]


def test_commands_of_rows(spark, tmp_path):
    rows = [(1, ["-c", "echo out; echo err >&2; exit 0"], str(tmp_path)), (2, ["-c", "pwd; exit 7"], str(tmp_path)), (3, ["-c", "echo a; sleep 30"], None), (4, None, str(tmp_path / "none")), (5, ["-c", "printf '\\377'", None], None)]
    df = spark.createDataFrame(rows, "id int, targets array<string>, root string").repartition(5, "id")
    got = {r["id"]: (r["exit_code"], r["output"], r["failure"]) for r in external.build_rows(df, "targets", "root", "sh", timeout_sec=3).collect()}
    assert got == {1: (0, "out\nerr\n", None), 2: (7, f"{tmp_path}\n", "exit"), 3: (None, "a\n", "timeout"), 4: (None, None, "missing"), 5: (0, "�", None)}
    assert external.build_rows(df.where("id = 1"), "targets", command="no-such-command").first()["failure"] == "missing"


def test_listing_and_moves(spark, tmp_path):
    storage.write_file(spark, str(tmp_path / "a" / "x"), b"123")
    storage.ensure_empty_dir(spark, str(tmp_path / "a" / "d"))
    assert storage.listing(spark, str(tmp_path / "a")) == [("d", True, 0), ("x", False, 3)] or storage.listing(spark, str(tmp_path / "a"))[-1] == ("x", False, 3)
    assert storage.move_new(spark, str(tmp_path / "a"), str(tmp_path / "p" / "b")) and not storage.exists(spark, str(tmp_path / "a"))
    storage.write_file(spark, str(tmp_path / "c" / "y"), b"")
    assert not storage.move_new(spark, str(tmp_path / "c"), str(tmp_path / "p" / "b")) and storage.exists(spark, str(tmp_path / "c" / "y"))


def test_table_function_equals_the_frame_function(spark):
    rows = [(i, "r", "C", f"t{i}", textdiff.unified("a\nb\nc", "\n".join("abc"[: i + 1]) + "\n" * (i % 2), "p")) for i in range(3)]
    df = spark.createDataFrame([r for r in rows if r[4]], "project_id int, run_ts string, class_name string, test_name string, raw string")
    df.createOrReplaceTempView("some_patches")
    patch_functions.register(spark)
    got = spark.sql("SELECT * FROM patch_lines(TABLE(some_patches) PARTITION BY project_id ORDER BY test_name)")
    want = patches.patch_lines(df)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_commands_of_one_partition_are_dealt_over_tasks(spark):
    rows = external.build_rows(spark.range(0, 40, 1, 1).selectExpr("id", "array('-c', 'exit 0') targets"), "targets", command="sh", tasks=8)
    assert [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()] == [5] * 8


def test_followed_query_takes_a_part_of_many_files_as_one_batch(spark, tmp_path, monkeypatch):
    import duckdb

    from palimpsest.plans import history, registry

    monkeypatch.setattr(history, "_place", lambda _, name: str(tmp_path / name))
    rows = spark.range(0, 20_000, 1, 8).selectExpr("id event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 7919) % 2592000) ts", "id % 50 user_id", "if(id % 3 < 1, 'purchase', 'click') event_type")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, registry.queries()["stream_followed"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == sorted(con.sql(registry.oracle_sql()["stream_followed"]).fetchall(), key=str)
    assert all(len(list((tmp_path / "followed" / "click" / str(i)).glob("*.parquet"))) > 1 for i in range(3))
