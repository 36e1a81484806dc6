"""Quality rules whose thresholds adapt to each language and source. DataFrame functions only.

Each document gets four measures. A sketch of every measure's distribution is kept
for each (language, source), over the documents that pass the fixed limits: counts of
values by bucket. Shares (of symbols, of repeated lines, of repeated words) are in
millionths, rounded down to `BITS` significant binary digits, which resolves the tail
to 1 part in 32 at every size of share; mean word lengths go by twentieths of a
character. Such sketches merge by addition, whatever the order, and a quantile of a
sketch is exactly the bucket of the data's quantile.

Mean word length fails beyond `REACH["m_word"]` times the distance of the quartiles
from them, either way. Shares fail upwards only, and most documents have none, so their
bounds look at the part that is not zero, too:

* repeated lines and words, which sound texts have: beyond the fence of the quartiles of
  the part that is not zero, and beyond the last hundredth of all;
* symbols, of which sound texts have few: beyond twice the last tenth of all, and beyond
  an eighth of the median of the part that is not zero. A document's symbols count less three times the
  error of such a count (its root), so that a handful in a short text shows nothing.

So a measure that spreads in a group takes only what is far out of it, no bound is zero
where anything is above zero, and no fixed part of a group is lost. There is no cutoff in the
measure's own units. Length is no measure: of documents that pass the fixed limits, sound ones
and junk have the same. A source with fewer than `LEAST_DOCS` such documents of a language is
judged by the language's merged sketch, and such a language by all documents'.

Fixed limits of the contract (fewer than 20 words; over 30 % of words in repeated
8-word windows) apply besides.

Defined cases: null text has no words and fails; empty text likewise; null language
or source is a group of its own; ties fall on the same side, since a document fails
only beyond a fence; texts are read whole; repeated rows count and are answered once
each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Documents that a group needs for thresholds of its own.
LEAST_DOCS = 50
#: How many times the distance of the quartiles a fence lies beyond them (of the part that is not zero, for shares).
REACH = {"m_word": 4, "m_lines": 3, "m_repeated": 3}
#: A share of symbols fails beyond FACTOR times the last tenth of all and beyond the median of those above zero, divided by PART.
FACTOR, PART = 2, 8
#: Standard errors of a count of symbols that are taken off it.
ERRORS = 3
#: Significant binary digits of a share.
BITS = 6
MEASURES = ("m_word", "m_symbols", "m_lines", "m_repeated")
BOTH_ENDS = ("m_word",)
_SPACE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeated_words(hashes: Column) -> Column:
    """From an array of word hashes: how many words lie in a window of 8 words that occurs twice or more."""
    k = WINDOW

    def of_windows(w: Column) -> Column:
        # Windows as (hash, place), sorted: equal ones are neighbours.
        def flagged(s: Column) -> Column:
            n = F.size(s)
            places = F.filter(
                F.transform(s, lambda x, i: F.when(((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | ((i < n - 1) & (x["h"] == F.get(s, i + 1)["h"])), x["p"])),
                lambda p: p.isNotNull(),
            )
            return _bind(F.array_sort(places), lambda q: F.aggregate(q, F.struct(F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("n")), lambda a, p: F.struct((p + k - 1).alias("end"), (a["n"] + (p + k - 1 - F.greatest(a["end"], p - 1))).cast("bigint").alias("n")), lambda a: a["n"]))

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(_bind(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), flagged))

    def windows(h: Column) -> Column:
        return F.when(F.size(h) <= k, F.lit(0).cast("bigint")).otherwise(_bind(F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))), of_windows))

    return _bind(hashes, windows)


def _rounded(value: Column) -> Column:
    """A whole number with all but its first BITS binary digits cleared."""
    cleared = F.greatest(F.lit(0), F.length(F.bin(value)) - BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, cleared), cleared)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source with the contract's counts and the measures in buckets."""
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", "lang", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, _SPACE, "") != "")
    counted = one.select(
        "doc_id", "lang", "source",
        F.char_length(F.translate("text", _SPACE, "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        _bind(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("bigint").alias("n_words"), _repeated_words(h).alias("n_repeat_words"))).alias("w"),
        _bind(lines, lambda x: F.size(x)).cast("bigint").alias("n_lines"),
    )
    counted = counted.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_lines")
    words, lines_ = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    share = lambda a, b: _rounded(F.floor(1_000_000 * a / b).cast("bigint"))
    sure = F.greatest(F.lit(0), F.col("n_symbols") - F.ceil(F.sqrt(ERRORS**2 * F.col("n_symbols"))))
    return counted.withColumns({
        "base_failed": failed,
        "m_word": F.floor(20 * F.col("word_chars") / words).cast("bigint"),
        "m_symbols": share(sure, F.greatest("word_chars", F.lit(1))),
        "m_lines": share(F.col("n_dup_lines"), lines_),
        "m_repeated": share(F.col("n_repeat_words"), words),
    })


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the mergeable sketch of each group. A measure has some hundreds of buckets at most, so its size follows the number of groups, not of documents."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("bucket")) for m in MEASURES))
    return rows.select("lang", "source", F.explode(pairs).alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def _levels() -> Column:
    """The groups that a row's language and source belong to, narrowest first; level 2 has all rows."""
    nothing = F.lit(None).cast("string")
    return F.array(*(F.struct(F.lit(i).alias("level"), a.alias("lang"), b.alias("source")) for i, (a, b) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), nothing), (nothing, nothing)])))


def bounds(sketch: DataFrame) -> DataFrame:
    """level, lang, source, docs and, for each measure, low_ (where it may fail downwards) and high_ bounds from the merged sketches."""
    group = ["level", "lang", "source", "measure"]
    merged = sketch.select(F.explode(_levels()).alias("g"), "measure", "bucket", "n").groupBy("g.level", "g.lang", "g.source", "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group)
    seen = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w)).withColumn("zero", F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket"))).alias(f"all_{q}")
    above = lambda q: F.min(F.when((F.col("bucket") > 0) & ((F.col("upto") - F.col("zero")) * 100 >= (F.col("all") - F.col("zero")) * q), F.col("bucket"))).alias(f"above_{q}")
    quantiles = seen.groupBy(*group).agg(F.max("all").alias("docs"), *map(at, (25, 75, 90, 99)), *map(above, (25, 50, 75)))
    apart = F.greatest(F.col("all_75") - F.col("all_25"), F.lit(1))
    high = F.when(F.col("measure") == "m_word", F.col("all_75") + REACH["m_word"] * apart).when(F.col("measure") == "m_symbols", F.greatest(FACTOR * F.col("all_90"), F.expr(f"above_50 div {PART}")))
    for m in ("m_lines", "m_repeated"):
        high = high.when(F.col("measure") == m, F.greatest("all_99", F.col("above_75") + REACH[m] * (F.col("above_75") - F.col("above_25"))))
    ends = {"low": F.col("all_25") - REACH["m_word"] * apart, "high": high}
    aggs = [F.max(F.when(F.col("measure") == m, v)).alias(f"{end}_{m}") for m in MEASURES for end, v in ends.items() if end == "high" or m in BOTH_ENDS]
    return quantiles.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *aggs)


def limits(sketch: DataFrame) -> DataFrame:
    """g_lang, g_source and bounds: of the narrowest group with enough documents, for each language and source in the sketch."""
    found = bounds(sketch)
    names = [c for c in found.columns if c.startswith(("low_", "high_"))]
    groups = sketch.select("lang", "source").distinct().select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.explode(_levels()).alias("g"))
    same = (F.col("g.level") == found["level"]) & F.col("g.lang").eqNullSafe(found["lang"]) & F.col("g.source").eqNullSafe(found["source"])
    enough = groups.join(found, same).where((F.col("docs") >= LEAST_DOCS) | (found["level"] == 2))
    return enough.groupBy("g_lang", "g_source").agg(F.min_by(F.struct(*names), found["level"]).alias("x")).select("g_lang", "g_source", "x.*")


def judged(docs: DataFrame) -> DataFrame:
    """The columns that op4 returns: contract's counts, base_failed and kept, with the rule that failed first."""
    rows = written(measured(docs), "measures")
    sketch = written(sketches(rows.where("not base_failed")), "sketches")
    joined = rows.join(limits(sketch), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    rule = F.when(F.col("base_failed"), "base")
    for m in MEASURES:
        beyond = F.col(m) > F.col(f"high_{m}")
        rule = rule.when(beyond | (F.col(m) < F.col(f"low_{m}")) if m in BOTH_ENDS else beyond, m)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", rule.isNull().alias("kept"), rule.alias("failed_rule"))
