import random

import pytest

from palimpsest.operators import lineage


def test_chain_of_a_thousand_and_forests(spark):
    r = random.Random(1)
    parent = {i: (i - 1 if i % 1000 else None) for i in range(2000)}
    parent |= {10_000 + i: (10_000 + r.randrange(i) if i and r.random() < 0.9 else None) for i in range(300)}
    parent[77_777] = 99_999  # its parent has no row
    df = spark.createDataFrame(list(parent.items()), "id int, parent int")

    def origin(i):
        n = 0
        while parent.get(i) is not None:
            i, n = parent[i], n + 1
        return i, n

    got = {r["id"]: (r["origin"], r["steps"]) for r in lineage.origins(df, "id").collect()}
    assert got == {i: origin(i) for i in parent}


def test_cycles_are_refused_and_no_rows_are_fine(spark):
    with pytest.raises(ValueError, match="cycle"):
        lineage.origins(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "id int, parent int"), "id")
    assert lineage.origins(spark.createDataFrame([], "id int, parent int"), "id").collect() == []


def test_parents_are_linked_by_text(spark):
    rows = [("k", 1, "a", "b"), ("k", 2, "b", "c"), ("k", 3, "a", "b"), ("k", 4, "b", "d"), ("m", 5, "b", "x"), ("k", 6, None, "y"), ("k", 7, "c", None), ("k", 8, "e", "e"), ("k", 9, "e", "f")]
    df = spark.createDataFrame(rows, "key string, no int, before string, after string")
    linked = lineage.with_parents(df, ["key"], "no", ["no"], "before", "after")
    assert {r["no"]: r["parent"] for r in linked.collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None, 7: 2, 8: None, 9: 8}
    assert {r["no"]: r["origin"] for r in lineage.origins(linked, "no").collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 1, 8: 8, 9: 8}
