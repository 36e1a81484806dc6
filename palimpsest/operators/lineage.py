"""How repeated edits of one thing relate: latest version, chains, duplicates, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.asof import as_of, stored


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Each key's last row by the order columns, which should end in a unique one. One sort by key, limited to a row per group before the exchange."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chains(rows: DataFrame, key: list[str], order: list[str], before: str, after: str) -> DataFrame:
    """rows with run_no and relation to the row before of the same key: first, chained (starts from its result), restarted (starts from the same original) or other."""
    w = Window.partitionBy(*key).orderBy(*order)
    relation = (
        F.when(F.row_number().over(w) == 1, "first")
        .when(F.lag(after).over(w).eqNullSafe(F.col(before)), "chained")
        .when(F.lag(before).over(w).eqNullSafe(F.col(before)), "restarted")
        .otherwise("other")
    )
    return rows.withColumns({"run_no": F.row_number().over(w).cast("bigint"), "relation": relation})


def distinct_edits(rows: DataFrame, group: list[str], *texts: str) -> DataFrame:
    """Per group and content of the text columns: how many rows have it. Only a digest of the texts is exchanged."""
    digest = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(t), F.lit("")) for t in texts)), 256)
    return rows.groupBy(*group, digest.alias("content")).agg(F.count("*").alias("copies"))


def with_parents(rows: DataFrame, key: list[str], id: str, order: list[str], before: str, after: str) -> DataFrame:
    """rows with `parent`: the id of the latest earlier row of the same key whose result is what this row starts from; null for an origin.

    The link is the text itself, by its digest, not the place in a series: a run may start from any earlier result. A null text links nothing. `order` ends in a unique column.
    """
    digest = lambda c: F.sha2(c, 256)
    place = F.struct(*order)
    child = rows.withColumns({"_text": digest(before), "_at": place})
    results = rows.select(*key, digest(after).alias("_text"), place.alias("_at"), F.col(id).alias("_id"))
    found = as_of(child, results, [*key, "_text"], "_at", "_at", strict=True)
    return found.select(*rows.columns, F.col("found._id").alias("parent"))


def origins(rows: DataFrame, id: str, parent: str = "parent") -> DataFrame:
    """rows with `origin`, the id at the end of their chain of parents, and `steps` to it, in log2 of the longest chain rounds.

    Each round follows every open link twice as far and is written to the shared folder, so that neither lineage nor plan grows; links
    that have arrived are only looked up. Ids are unique; a parent that is not among them is an origin all the same, without a row.
    A cycle, which links to earlier rows never make, raises ValueError.
    """
    c = F.col
    links = stored(rows.where(c(parent).isNotNull()).select(c(id).alias("_id"), c(parent).alias("_to"), F.lit(1).cast("bigint").alias("_n"), F.lit(False).alias("_there")), "links")
    n = links.count()
    reach, left = 1, n
    while left:
        if reach > 2 * n:
            raise ValueError(f"{left} rows are in a cycle of parents")
        onward = links.select(c("_id").alias("_to"), c("_to").alias("_further"), c("_n").alias("_more"), c("_there").alias("_then"))
        step = links.where("not _there").join(onward, "_to", "left")
        step = step.select("_id", F.coalesce("_further", "_to").alias("_to"), (c("_n") + F.coalesce("_more", F.lit(0))).alias("_n"), F.coalesce("_then", F.lit(True)).alias("_there"))
        links = stored(links.where("_there").unionByName(step), "links")
        left = links.where("not _there").count()
        reach *= 2
    ends = links.select(c("_id").alias(id), c("_to").alias("origin"), c("_n").alias("steps"))
    return rows.join(ends, id, "left").withColumns({"origin": F.coalesce("origin", id), "steps": F.coalesce("steps", F.lit(0))})


def neighbours(rows: DataFrame, key: list[str], number: str, state: str) -> DataFrame:
    """Each row beside that of the next number under the same key, found by one sort, not by a join of the table with itself."""
    w = Window.partitionBy(*key).orderBy(number)
    nxt = lambda c: F.lead(c).over(w)
    rows = rows.withColumns({"next_number": nxt(number), "next_state": nxt(state)})
    return rows.where(F.col("next_number") == F.col(number) + 1).drop("next_number")


def evidence(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """What patches of neighbouring numbers (context, removed, added) show of each other, and what follows about their order.

    `this_shows`: the neighbour's added text is in this patch's context (repaired), its removed text is (original), or neither.
    `order`: this first or next first, if just one of them shows the other repaired; unapplied, if each shows the other as it
    was, so that one of them was saved and never applied; else unknown. The order of work comes from here, never from numbers.
    """
    w = Window.partitionBy(*key).orderBy(number)
    nxt = {f"_{c}": F.lead(c).over(w) for c in (number, "context", "removed", "added")}
    shows = lambda context, added, removed: F.when(F.contains(context, added), "repaired").when(F.contains(context, removed), "original").otherwise("neither")
    c = F.col
    rows = rows.withColumns(nxt).where(c(f"_{number}") == c(number) + 1)
    rows = rows.withColumns({"this_shows": shows(c("context"), c("_added"), c("_removed")), "next_shows": shows(c("_context"), c("added"), c("removed"))})
    this, that = c("this_shows"), c("next_shows")
    order = F.when((this == "original") & (that == "original"), "unapplied").when((that == "repaired") & (this != "repaired"), "this first").when((this == "repaired") & (that != "repaired"), "next first").otherwise("unknown")
    return rows.withColumn("order", order).drop(*nxt)


def signature_visibility(sides: DataFrame, name: str) -> DataFrame:
    """sides (before, removed, added of each patch) with `visible`: where the method's signature shows. A patch that shows none
    says nothing about the method; the guard belongs on the whole text."""
    from palimpsest.functions.guards import method_present

    seen = lambda c: method_present(c, F.col(name))
    visible = F.when(seen("added") & seen("removed"), "both").when(seen("added"), "added").when(seen("removed"), "removed").when(seen("before"), "context").otherwise("nowhere")
    return sides.withColumn("visible", visible)


def violations(rows: DataFrame, text: str, markers: list[str]) -> DataFrame:
    """Rows whose added text has a marker; none is the rule."""
    from palimpsest.functions.guards import first_marker

    return rows.withColumn("marker", first_marker(text, markers)).where("marker is not null")
