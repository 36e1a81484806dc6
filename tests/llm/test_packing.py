import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from palimpsest.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def check(rows, texts, size=1024):
    """Every document is whole, every sequence gapless and within size; returns the number of sequences."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert k == 0 or r["length"] == size
            at += r["length"]
        assert at == len(ids)
        assert len(by_doc[i]) == -(-len(ids) // size)
    return len(by_seq)


def test_documents_are_packed_whole(spark):
    r = random.Random(6)
    texts = [(i, " ".join(r.choices(["the", "thing", "éa", "ningly"], k=r.choice([0, 3, 50, 300, 900, 3000])))) for i in range(150)] + [(900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, length int")
    rows = packing.pack_documents(docs, PATH).collect()
    n, tokens = check(rows, texts), sum(r["length"] for r in rows)
    assert n <= -(-tokens // 1024) + 1


SHAPES = {
    "any": lambda r, i: r.randint(1, 1024),
    "halves": lambda r, i: 600 if i < 12_000 else 400,  # the large ones first, in partitions of their own
    "above half": lambda r, i: r.randint(513, 900) if i % 2 else r.randint(100, 500),
    "only large": lambda r, i: r.randint(513, 1023),
    "tiny": lambda r, i: r.randint(1, 3),
    "one pair": lambda r, i: {5: 500, 20_000: 524}.get(i, 900),
    "room of two tokens": lambda r, i: {5: 2, 20_000: 1022}.get(i, 1023),
    "few and small": lambda r, i: 30 if i % 3000 == 7 else 1000,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_levels_lose_nothing_and_come_near_one_best_fit(spark, shape):
    r = random.Random(7)
    cut = [(i, 0, 0, SHAPES[shape](r, i), i) for i in range(24_000)]
    df = spark.createDataFrame(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    rows = packing.pack(df, items_per_partition=6000, pieces_per_partition=20_000).collect()
    assert sorted(x["doc_id"] for x in rows) == list(range(24_000))
    by_seq = defaultdict(list)
    for x in rows:
        by_seq[x["sequence_id"]].append((x["offset"], x["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    used = sorted(sum(n for _, n in places) for places in by_seq.values())
    assert used[0] + used[1] > 1024  # so no two can be joined
    assert len(by_seq) <= 1.01 * len(packing.best_fit([c[3] for c in cut], 1024)) + 1


@pytest.mark.parametrize("items", [1, 7, 100])
def test_partitions_of_few_items_come_to_an_end(spark, items):
    r = random.Random(9)
    cut = [(i, 0, 0, r.randint(1, 1023), i) for i in range(300)]
    df = spark.createDataFrame(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    rows = packing.pack(df, items_per_partition=items, pieces_per_partition=2 * items).collect()
    used = defaultdict(int)
    for x in rows:
        used[x["sequence_id"]] += x["length"]
    first, second = sorted(used.values())[:2]
    assert sorted(x["doc_id"] for x in rows) == list(range(300)) and max(used.values()) <= 1024 < first + second


def test_best_fit_against_a_plain_one():
    r = random.Random(8)
    for _ in range(50):
        lengths = [r.randint(1, 30) for _ in range(r.randint(0, 60))]
        plain = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in plain if sum(b) + n <= 30]
            if fits:
                max(fits, key=sum).append(n)
            else:
                plain.append([n])
        got = packing.best_fit(lengths, 30)
        assert len(got) == len(plain) and sorted(i for b in got for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 30 for b in got)


def test_cut_points_and_edge_cases(spark):
    assert packing.cut_points(2048) == [(0, 1024), (1024, 1024)]
    assert packing.cut_points(1030) == [(0, 6), (6, 1024)]
    assert packing.cut_points(1) == [(0, 1)]
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
    same = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "doc_id bigint, text string")
    assert sorted(r["offset"] for r in packing.pack_documents(same, PATH).collect()) == [0, 2, 4]
