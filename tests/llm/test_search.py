import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from palimpsest.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, q in asked.items():
        scored = []
        for doc_id, c in rows:
            m = 10 + 90 * c.total() * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in q if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, terms string, score int")
    return d, spark.createDataFrame([(i, t, "y") for i, t in items], "item_id bigint, text string, doc_id string")


def test_terms():
    for text in ("", "Ab-c 1é\x00\x7f×÷ÄÖ x_y ＡＢ İ", "".join(map(chr, range(1, 0x250)))):
        assert [t.decode() for t in search.terms_of(text)] == terms(text)
    assert search.terms_of(None) == []


def test_against_brute_force(spark):
    r = random.Random(2)
    words = [f"W{i}" for i in range(40)] + ["é", "日本", "x1"]
    docs = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 5, 80])))) for i in r.sample(range(1000), 120)]
    docs += [(2000 + i, "tie tie other") for i in range(30)] + [(5, "tie tie other"), (None, "tie tie other"), (7, None), (8, "..."), (9, "long " * 60_000 + "w1"), (docs[0][0], docs[0][1])]
    items = [(i, " ".join(r.choices(words, k=r.choice([0, 3, 20])))) for i in range(15)]
    items += [(50, "tie"), (51, "nothing like it"), (52, None), (None, "w1 w2"), (53, "w3"), (53, "w4 W3"), (54, "w1"), (54, "w1")]
    d, q = frames(spark, docs, items)
    want = brute(docs, items)
    assert sorted(map(tuple, search.ranked(d, q).collect()), key=str) == want
    # Small shards and many blocks of queries change nothing.
    index, n = search.build(d, shard_bytes=300, shard_docs=7)
    assert index.count() > 15
    assert sorted(map(tuple, search.search(index, n, q, block_terms=60).collect()), key=str) == want
    assert sorted(map(tuple, search.search(index, n, q, k=3).collect()), key=str) == brute(docs, items, 3)


def test_empty_tables(spark):
    d, q = frames(spark, [], [(1, "a")])
    assert search.ranked(d, q).collect() == []
    d, q = frames(spark, [(1, "a"), (2, None)], [])
    assert search.ranked(d, q).collect() == []
    d, q = frames(spark, [(1, None), (2, "!")], [(1, "a")])
    assert search.ranked(d, q).collect() == []


def test_ties_at_the_last_place():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(0, 50))
        scores, rank = r.integers(0, 4, n), r.permutation(n)
        want = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], rank[i]))[:5]
        assert search.best(scores, rank, 5).tolist() == want


def test_a_shard_holds_sorted_terms_and_impacts():
    row = search._shard([3, None], [[b"b", b"a", b"b"], [b"a"]], 2, 4)
    assert row["terms"] == [[b"a", b"b"]] and np.frombuffer(row["starts"][0], np.int64).tolist() == [0, 2, 3]
    assert np.frombuffer(row["docs"][0], np.int32).tolist() == [0, 1, 0] and np.frombuffer(row["no_id"][0], np.int32).tolist() == [1]
    m = [10 + 90 * 3 * 2 // 4, 10 + 90 * 2 // 4]
    assert np.frombuffer(row["impacts"][0], np.int32).tolist() == [search.impact(1, m[0]), search.impact(1, m[1]), search.impact(2, m[0])]


def test_long_rows_of_the_index_come_few_at_a_time(spark):
    from palimpsest.functions.batches import BATCH_BYTES
    from palimpsest.llm.common import arrow_map, written

    long = written(spark.range(0, 40, 1, 1).selectExpr("repeat(char(65 + id), 1 << 20) text"), "long", group_rows=search.GROUP_SHARDS)
    sizes = lambda batches: ({"n": [len(b["text"])]} for b in batches)
    got = [r["n"] for r in arrow_map(long, sizes, "n int").collect()]
    assert sum(got) == 40 and max(got) <= (BATCH_BYTES >> 20) + 1
    index, _ = search.build(spark.range(0, 40, 1, 1).selectExpr("id doc_id", "concat('w', id) text"), shard_docs=1)
    groups = [pq.ParquetFile(p.removeprefix("file:")).metadata for p in index.inputFiles()]
    assert sum(g.num_rows for g in groups) == 40 and all(g.row_group(i).num_rows <= search.GROUP_SHARDS for g in groups for i in range(g.num_row_groups))
