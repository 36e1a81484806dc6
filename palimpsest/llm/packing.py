"""Best-fit packing of documents into sequences, from partitions upwards.

Every partition packs its pieces best-fit, longest first. Then no two of its bins can be
joined, so one at most is half empty or emptier. That one goes a level up, and with it, as
hosts, one bin of each length that is not nearly full; all others are done. What goes up is
dealt anew to as many partitions as its number asks for, half of those below at most, and
packed again as items, until one partition is left. Its one bin that is half empty, if
there is one, joins the fullest of all done bins that has room for it. So no two of all
sequences could be joined, whatever is nearly full. An item carries its pieces along, so no
level has to look anything up, and a partition holds a bounded number of items and of pieces.

Defined cases: null text is read as empty; a document's ids end with the
separator, so an empty one is a piece of one token; texts of any length are
packed whole; repeated rows are packed once each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import fast_ids
from palimpsest.llm.common import arrow_map, pick, written

SIZE, SEPARATOR = 1024, 2
PIECE = "doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint"
_BIN = f"up boolean, length bigint, parts array<struct<{PIECE}, offset: bigint>>"


def cut_points(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of full size but the first, which takes the rest."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids with the separator, cut to size."""

    def run(batches):
        ids_of = fast_ids(path)
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(ids_of(text), separator).astype("<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), size)):
                    for name, v in zip(out, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        out[name].append(v)
            yield out

    return arrow_map(pick(docs, "doc_id", "text"), run, PIECE.replace(":", ""))


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of item numbers: longest first, each into the fullest bin that takes it. A bit per room left finds that bin at once."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        mask |= 1 << (room - n)
    return bins


def pack(cut: DataFrame, size: int = SIZE, items_per_partition: int = 20_000, pieces_per_partition: int = 200_000, slack: int = 2) -> DataFrame:
    """The pieces with sequence_id and offset. No two sequences could be joined."""

    def level(batches):
        items = [x for b in batches for x in zip(b["length"], b["parts"], strict=True)]
        items.sort(key=lambda x: (-x[0], x[1][0]["doc_id"] is None, x[1][0]["doc_id"] or 0, x[1][0]["piece"]))
        chosen = best_fit([n for n, _ in items], size)
        offered = set()
        for a in range(0, len(chosen), 1000):
            made = []
            for bin_ in chosen[a : a + 1000]:
                parts, at = [], 0
                for i in bin_:
                    parts += [{**p, "offset": p["offset"] + at} for p in items[i][1]]
                    at += items[i][0]
                up = at < size - slack and (2 * at <= size or at not in offered)
                offered.add(at)
                made.append((up, at, parts))
            yield dict(zip(("up", "length", "parts"), map(list, zip(*made, strict=True)), strict=True))

    whole = F.array(F.struct(*(x.split(":")[0] for x in PIECE.split(", ")), F.lit(0).cast("bigint").alias("offset"))).alias("parts")
    items = cut.where(F.col("length") < size).select("length", whole)
    finished = cut.where(F.col("length") >= size).select(F.monotonically_increasing_id().alias("sequence_id"), "length", whole)
    height, n = 1, max(1, -(-items.count() // items_per_partition))
    while True:
        # Dealt by row number, not by document: no key can gather many rows.
        dealt = items.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())).repartition(n, "deal").select("length", "parts")
        # Numbered where they are written, apart from those of other levels.
        packed = written(arrow_map(dealt, level, _BIN).withColumn("sequence_id", F.lit(height << 56) + F.monotonically_increasing_id()), "bins")
        if n == 1:
            break
        finished = finished.unionByName(packed.where("not up").drop("up"))
        items = packed.where("up").select("length", "parts")
        left = items.agg(F.count("*").alias("bins"), F.sum(F.size("parts")).alias("pieces")).first()
        height, n = height + 1, max(1, min(n // 2, max(-(-left["bins"] // items_per_partition), -(-(left["pieces"] or 0) // pieces_per_partition))))
    finished = finished.unionByName(packed.drop("up"))
    placed = finished.select("sequence_id", F.explode("parts").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
    # One bin at most is half empty; a bin that stayed below may have room for it.
    last = packed.where(2 * F.col("length") <= size).select("sequence_id", "length").first()
    fits = last and finished.where((F.col("length") <= size - last["length"]) & (F.col("sequence_id") != last["sequence_id"]))
    host = fits and fits.select("sequence_id", "length").orderBy(F.desc("length"), "sequence_id").first()
    if not host:
        return placed
    moved = F.col("sequence_id") == last["sequence_id"]
    return placed.withColumns({"offset": F.when(moved, F.col("offset") + host["length"]).otherwise(F.col("offset")), "sequence_id": F.when(moved, F.lit(host["sequence_id"])).otherwise(F.col("sequence_id"))})


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """The columns that op3 returns, one row per piece."""
    return pack(written(pieces(docs, path, size, separator), "pieces"), size)
