import hashlib
import random

import numpy as np
import xxhash

from palimpsest.llm import common, fingerprint


def test_winnow_keeps_the_rightmost_least_of_each_window():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choices("abé😀", k=r.randint(0, 120)))
        k, w = r.choice([(3, 4), (5, 7), (24, 64)])
        hashes, at = fingerprint.winnow(text, k, w)
        if len(text) < k:
            assert len(hashes) == bool(text)
            continue
        units = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        h = [int(common.kgram_hashes(units[i : i + k], k)[0]) for i in range(len(text) - k + 1)]
        size = max(1, min(w, len(h) // 8))
        want = set()
        for i in range(len(h) - size + 1):
            least = min(x >> 32 for x in h[i : i + size])
            want.add(max(j for j in range(i, i + size) if h[j] >> 32 == least))
        assert at.tolist() == sorted(want) and hashes.tolist() == [h[j] for j in sorted(want)]


def test_shared_stretch_shares_a_hash():
    r = random.Random(2)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    for _ in range(100):
        common_part = text(fingerprint.K + fingerprint.WINDOW - 1)
        a, b = text(r.randint(0, 300)) + common_part + text(50), text(r.randint(0, 300)) + common_part + text(90)
        assert set(fingerprint.winnow(a)[0].tolist()) & set(fingerprint.winnow(b)[0].tolist())


def brute(rows):
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (h >> 63 << 64)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1] or "")))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 4] + nxt[: n // 4]
        f, g, h = (fingerprint.winnow(t) for t in (text, edited, nxt))
        out.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint.rendered(*f), fingerprint.rendered(*g), fingerprint.likeness(f[0], g[0]), fingerprint.likeness(f[0], h[0])))
    return out


def test_next_document_in_any_partitioning(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choices("abc éß", k=r.choice([0, 1, 3, 90, 400])))) for i in r.sample(range(10_000), 60)]
    rows += [(rows[0][0], "another text"), (None, "no id"), (20_000, None), (20_001, rows[0][1]), (20_002, "x" * 300_000)]
    rows += [(None, f"without an id {i}") for i in range(40)] + [(5000, f"of one id {i}") for i in range(40)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, tail int")
    want = sorted(map(str, brute(rows)))
    for n in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = fingerprint.with_next(docs).collect()
        assert sorted(str(tuple(x)) for x in got) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_of_one_id_are_split(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * 20) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    sizes = [r["count"] for r in fingerprint.in_order(docs).groupBy(fingerprint.F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) >= 25 and max(sizes) <= 250


def test_short_texts_keep_several_hashes():
    r = random.Random(6)
    for n in (60, 100, 200, 400):
        text = "".join(r.choices("abcdefgh ", k=n))
        edited = text[: n - n // 4] + "".join(r.choices("abcdefgh ", k=n // 4))
        assert 0 < fingerprint.likeness(fingerprint.winnow(text)[0], fingerprint.winnow(edited)[0]) < 1
    long = "".join(r.choices("abcdefgh ", k=5000))
    assert len(fingerprint.winnow(long)[0]) < 5000 / 20


def test_edge_cases(spark):
    assert fingerprint.likeness(*(np.zeros(0, np.uint64),) * 2) == 1.0
    one = spark.createDataFrame([(7, "abcdefgh")], "doc_id bigint, text string")
    r = fingerprint.with_next(one).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0 and r[0]["n_chars"] == 8
    assert fingerprint.with_next(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert fingerprint.fingerprints(one).collect()[0]["positions"] == [0]
