import random

import pytest

from palimpsest.operators import textdiff
from palimpsest.plans import history
from palimpsest.plans.catalog import SQL
from palimpsest.streaming import patch_stream

SCHEMA = "key string, at timestamp, source boolean, seq bigint, body string"


def run(spark, records, tmp_path, order):
    """Rows of the stream, one file a batch in the given order, and a last record that lets the watermark pass."""
    log = tmp_path / "log"
    for i, part in enumerate(order):
        spark.createDataFrame(part, "key string, at long, source boolean, seq bigint, body string").selectExpr("key", "timestamp_seconds(at) at", "source", "seq", "body").coalesce(1).write.mode("append").json(str(log / f"{i:03}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(log / "*"))
    with patch_stream.composite_state(spark):
        q = patch_stream.fold_stream(stream, "key", late="100 seconds", idle_ms=10_000_000).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return spark.table("folded").collect()


def last(rows):
    return {r["key"]: tuple(r)[1:] for r in sorted(rows, key=lambda r: r["applied"] + r["rejected"])}


@pytest.fixture(scope="module")
def records():
    r = random.Random(1)
    sources, patches = [], []
    for k in range(5):
        text = "".join(f"{i}\n" for i in range(9))
        sources.append((f"k{k}", 1000, True, None, text))
        for seq in range(1, 7):
            lines = text.split("\n")
            lines[r.randrange(9)] += f" by {seq}"
            new = "\n".join(lines)
            patches.append((f"k{k}", 1000 + 10 * seq, False, seq, textdiff.unified(text, new, "p") if seq != 4 else "no patch"))
            text = new if seq != 4 else text
    patches.append(("none", 1005, False, 1, textdiff.unified("a\n", "b\n", "p")))
    return sources, patches


def test_out_of_order_patches_give_the_batch_folds_rows(spark, tmp_path, records):
    sources, patches = records
    want = textdiff.fold_patches(spark.createDataFrame([(k, b) for k, _, _, _, b in sources], "key string, text string"), spark.createDataFrame([(k, s, b) for k, _, _, s, b in patches], "key string, seq bigint, raw string"), "key")
    mixed = [*sources, *patches]
    random.Random(2).shuffle(mixed)
    order = [mixed[i::4] for i in range(4)] + [[("clock", 5000, True, None, "")], [("clock", 6000, True, None, "")]]
    got = last(run(spark, mixed, tmp_path, order))
    assert {k: v for k, v in got.items() if k != "clock"} == {r["key"]: (r["text"], r["applied"], r["rejected"]) for r in want.collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_state_is_kept_between_batches_and_forgotten_when_idle(spark, tmp_path):
    d = lambda a, b: textdiff.unified(a, b, "p")
    order = [
        [("k", 1000, True, None, "a\n"), ("k", 1010, False, 1, d("a\n", "b\n"))],
        [("clock", 2000, True, None, "")],  # what is due so far is applied after this
        [("k", 2500, False, 2, d("b\n", "c\n"))],
        [("clock", 4000, True, None, "")],
        [("clock", 20_000, True, None, "")],  # over 10,000 seconds without a record: forgotten
        [("k", 30_000, False, 3, d("c\n", "d\n"))],
        [("clock", 50_000, True, None, "")],
    ]
    got = [tuple(r)[1:] for r in run(spark, None, tmp_path, order) if r["key"] == "k"]
    assert sorted(got, key=str) == sorted([("b\n", 1, 0), ("c\n", 2, 0), (None, 0, 1)], key=str)


def test_keys_of_any_kind_share_groups(spark, tmp_path):
    """Keys are numbers, null or bytes; all are in one group, and a key idle for long starts anew while others go on."""
    d = lambda a, b: textdiff.unified(a, b, "p")
    rows = [(k, 1000, True, None, f"{k}\n") for k in (2**60 + 1, 2**60, None)] + [(k, 1010, False, 1, d(f"{k}\n", "b\n")) for k in (2**60 + 1, 2**60, None)]
    rows += [(2**60, 20_000, False, 2, d("b\n", "c\n"))]
    log = str(tmp_path / "log")
    for n, part in enumerate((rows, [(5, 90_000, True, None, "")])):
        spark.createDataFrame(part, "key long, at long, source boolean, seq bigint, body string").selectExpr("key", "timestamp_seconds(at) at", "source", "seq", "body").coalesce(1).write.json(f"{log}/{n}")
    for n, (name, kind) in enumerate((("key", "bigint"), ("cast(cast(key as string) as binary)", "binary"))):
        stream = spark.readStream.schema(SCHEMA.replace("key string", "key bigint")).option("maxFilesPerTrigger", 1).json(f"{log}/*").selectExpr(f"{name} key", "at", "source", "seq", "body")
        with patch_stream.composite_state(spark):
            folded = patch_stream.fold_stream(stream, "key", late="100 seconds", idle_ms=10_000_000, groups=1)
            assert dict(folded.dtypes)["key"] == kind
            folded.writeStream.format("memory").queryName(f"kinds{n}").outputMode("append").option("checkpointLocation", str(tmp_path / f"state{n}")).trigger(availableNow=True).start().awaitTermination(180)
        got = sorted(((int(r["key"]) if r["key"] is not None else None, *tuple(r)[1:]) for r in spark.table(f"kinds{n}").collect()), key=str)
        assert got == sorted([(2**60 + 1, "b\n", 1, 0), (2**60, "b\n", 1, 0), (None, "b\n", 1, 0), (2**60, None, 0, 1)], key=str)


def test_query_keeps_one_slice_on_disk_at_a_time(spark, tmp_path, monkeypatch):
    """What a stream keeps goes before the next slice's begins; at the end only the rows are there, and they are those of SQL."""
    duckdb = pytest.importorskip("duckdb")
    base, kept, fold = tmp_path / "patches", [], patch_stream.fold_stream
    files = lambda *of: [p for d in of for p in (base / d).rglob("*") if p.is_file() and not p.name.endswith(".crc")]

    def watched(*args, **kwargs):
        kept.append((len(files("state")), {p.relative_to(base / "in").parts[0] for p in files("in")}))
        return fold(*args, **kwargs)

    monkeypatch.setattr(history, "_SLICE_ROWS", 60, raising=False)
    monkeypatch.setattr(history, "_place", lambda spark, name: str(base))
    monkeypatch.setattr(patch_stream, "fold_stream", watched)
    before = [spark.conf.get(f"spark.sql.{x}") for x in ("shuffle.partitions", "streaming.minBatchesToRetain", "streaming.stateStore.maintenanceInterval")]
    got = history.patch_stream_fold(spark, "/root/testdata/sf0.001")
    assert kept == [(0, {"0"}), (0, {"1"}), (0, {"2"})]
    assert {p.relative_to(base).parts[0] for p in files(".") if p.name != "_SUCCESS"} == {"out"}
    assert before == [spark.conf.get(f"spark.sql.{x}") for x in ("shuffle.partitions", "streaming.minBatchesToRetain", "streaming.stateStore.maintenanceInterval")]
    con = duckdb.connect()
    con.sql("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(SQL["patch_stream_fold"]).fetchall())
