import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import audit
from palimpsest.streaming import audit_stream


def lines(path):
    return [json.loads(x) for f in sorted(Path(path).glob("part-*")) for x in f.read_text().splitlines()]


def test_records_keep_order_nulls_and_characters(spark, tmp_path):
    path = str(tmp_path / "new" / "log")
    rows = spark.createDataFrame([(1.5, "é", None, "d")], "ts double, a string, x string, diff string")
    audit.append(audit.records(rows, "e", "ts", "a", "x", "diff"), path)
    audit.append(audit.records(rows.drop("ts"), "later", "a"), path)
    got = lines(path)
    assert sorted(got, key=lambda r: r["ts"])[0] == {"ts": 1.5, "event": "e", "a": "é", "x": None, "diff": "d"}
    raw = "".join(f.read_text() for f in Path(path).glob("part-*"))
    assert '{"ts":1.5,"event":"e","a":"é","x":null,"diff":"d"}' in raw and len(got) == 2
    back = audit.read(spark, path).orderBy("ts").select("ts", "event", audit.field("a", "string").alias("a"), audit.field("none", "int").alias("n")).collect()
    assert [tuple(r) for r in back][0] == (1.5, "e", "é", None) and back[1]["event"] == "later" and back[1]["ts"] > 1.7e9


def test_terse_hides_top_level_fields_only(spark):
    recs = spark.createDataFrame([(1.0, "e", "p", ("inner",))], "ts double, event string, prompt string, nested struct<diff: string>")
    assert audit.terse(recs).columns == ["ts", "event", "nested"] and audit.terse(recs).first()["nested"]["diff"] == "inner"


def test_event_given_twice_is_refused(spark):
    with pytest.raises(TypeError):
        audit.records(spark.createDataFrame([("x",)], "event string"), "e", "event")


def test_malformed_lines_do_not_stop_the_reader(spark):
    rows = audit.parsed(spark.createDataFrame([('{"ts": 1, "event": "e"}',), ("not json",), ('{"ts": "x"}',)], "value string")).collect()
    assert [(r["ts"], r["event"]) for r in rows] == [(1.0, "e"), (None, None), (None, None)]


def test_stream_counts_and_state(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(60.0 * i, "a" if i % 3 else "b", str(i % 2)) for i in range(30)], "ts double, event string, user string")
    audit.append(audit.records(rows, F.col("event"), "ts", "user"), log)
    recs = audit_stream.read_stream(spark, log)

    def collected(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    counts = collected(audit_stream.windowed_counts(recs, "10 minutes"), "windows", "complete")
    assert sum(r["n"] for r in counts) == 30 and {(r["event"], r["n"]) for r in counts} == {("a", 6), ("a", 7), ("b", 4), ("b", 3)}
    state = collected(audit_stream.running_totals(recs.withColumn("user", audit.field("user", "string")).drop("extras"), "user"), "totals", "update")
    assert {(r["user"], r["n"], r["last_event"]) for r in state} == {("0", 15, "a"), ("1", 15, "a")}
    batch = audit_stream.sessions(audit.read(spark, log).withColumn("user", audit.field("user", "string")), "user", "5 minutes").collect()
    assert {(r["user"], r["n"]) for r in batch} == {("0", 15), ("1", 15)}


def test_last_event_does_not_depend_on_arrival(spark, tmp_path):
    for name, events in (("one", "abc"), ("two", "cba")):
        log = str(tmp_path / name / "log")
        for e in events:  # a file and a batch each
            audit.append(audit.records(spark.createDataFrame([(5.0, e, "u"), (None, "z", "u")], "ts double, event string, user string").coalesce(1), F.col("event"), "ts", "user"), log)
        recs = audit_stream.read_stream(spark, log, max_files=1).withColumn("user", audit.field("user", "string")).drop("extras")
        q = audit_stream.running_totals(recs, "user").writeStream.format("memory").queryName(f"last_{name}").outputMode("update").option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and max((r["n"], r["last_event"]) for r in spark.table(f"last_{name}").collect()) == (6, "c")
