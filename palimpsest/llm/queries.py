"""The queries of this folder: each applies an operator, with its production parameters, to a whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, exact, fingerprint, jaccard, kneser_ney, language, packing, pii, rules, search, secrets, spelling, suffixes
from palimpsest.llm.common import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_digest(read_table(spark, sf_dir, "documents"))


#: Every 400-byte string of every document, by its digest.
OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT rid, i, md5(substr(h, 2 * i - 1, 800)) AS k FROM (SELECT rid, h, unnest(range(1, length(h) // 2 - 398)) AS i FROM d WHERE length(h) >= 800)),
again AS (SELECT rid, i, i > lag(i, 1, -400) OVER (PARTITION BY rid ORDER BY i) + 400 AS fresh FROM places JOIN (SELECT k FROM places GROUP BY k HAVING count(*) > 1) USING (k)),
runs AS (SELECT rid, min(i) AS s, max(i) + 400 AS e FROM (SELECT rid, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY rid ORDER BY i) AS run FROM again) GROUP BY rid, run),
parts AS (SELECT rid, s, e, lag(e, 1, 1) OVER (PARTITION BY rid ORDER BY s) AS p FROM runs),
rest AS (SELECT rid, count(*) AS n_spans, sum(e - s) AS gone, max(e) AS last, string_agg(substr(h, 2 * p - 1, 2 * (s - p)), '' ORDER BY s) AS kept FROM parts JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE kept || substr(h, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN rest USING (rid)
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_digest(read_table(spark, sf_dir, "documents"))


_MEASURES = {
    "m_word": "20 * word_chars // greatest(n_words, 1)",
    "m_symbols": f"six(1000000 * greatest(0, n_symbols - CAST(ceil(sqrt({rules.ERRORS**2} * n_symbols)) AS BIGINT)) // greatest(word_chars, 1))",
    "m_lines": "six(1000000 * n_dup_lines // greatest(n_lines, 1))",
    "m_repeated": "six(1000000 * n_repeat_words // greatest(n_words, 1))",
}


def _six(sql: str) -> str:
    """six(x): x with all but its first binary digits cleared."""
    return re.sub(r"six\((.*)\)$", rf"((\1) >> greatest(0, length(bin(\1)) - {rules.BITS})) << greatest(0, length(bin(\1)) - {rules.BITS})", sql)


def _exact_bounds_sql(name: str, by: str) -> str:
    """Per group: documents, and each measure's bounds from exact quantiles of the sorted values."""
    at = lambda q, v="v": f"{v}[(len({v}) * {q} + 99) // 100]"
    apart = f"{rules.REACH['m_word']} * greatest({at(75)} - {at(25)}, 1)"
    fence = lambda m: f"WHEN '{m}' THEN greatest({at(99)}, {at(75, 'z')} + {rules.REACH[m]} * ({at(75, 'z')} - {at(25, 'z')}))"
    high = f"CASE measure WHEN 'm_word' THEN {at(75)} + {apart} WHEN 'm_symbols' THEN greatest({rules.FACTOR} * {at(90)}, {at(50, 'z')} // {rules.PART}) {fence('m_lines')} {fence('m_repeated')} END"
    return f"""
{name} AS (SELECT * EXCLUDE (v, z), len(v) AS docs, {at(25)} - {apart} AS low, {high} AS high
  FROM (SELECT *, list_filter(v, lambda x: x > 0) AS z FROM (SELECT {by} measure, list_sort(list(bucket)) AS v FROM long GROUP BY ALL)))"""


_BOTH_ENDS = ", ".join(f"'{m}'" for m in rules.BOTH_ENDS)
OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k FROM d WHERE len(w) >= 8
), twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(8) AS r(j) GROUP BY rid),
c AS (
  SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    len(w) < {rules.LEAST_WORDS} OR 100 * coalesce(n, 0) > {rules.MOST_REPEATED} * len(w) AS failed FROM d LEFT JOIN covered USING (rid)
), long AS ({" UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS measure, {_six(e)} AS bucket FROM c WHERE NOT failed" for m, e in _MEASURES.items())}),{_exact_bounds_sql("a", "lang, source,")},{_exact_bounds_sql("b", "lang,")},{_exact_bounds_sql("e", "")},
beyond AS (
  SELECT rid, list_position({list(_MEASURES)}, x.measure) AS place FROM long x
  JOIN a ON a.measure = x.measure AND a.lang IS NOT DISTINCT FROM x.lang AND a.source IS NOT DISTINCT FROM x.source JOIN b ON b.measure = x.measure AND b.lang IS NOT DISTINCT FROM x.lang JOIN e ON e.measure = x.measure
  WHERE x.measure IN ({_BOTH_ENDS}) AND bucket < CASE WHEN a.docs >= {rules.LEAST_DOCS} THEN a.low WHEN b.docs >= {rules.LEAST_DOCS} THEN b.low ELSE e.low END
    OR bucket > CASE WHEN a.docs >= {rules.LEAST_DOCS} THEN a.high WHEN b.docs >= {rules.LEAST_DOCS} THEN b.high ELSE e.high END
), first AS (SELECT rid, {list(_MEASURES)}[min(place)] AS measure FROM beyond GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND measure IS NULL AS kept, CASE WHEN failed THEN 'base' ELSE measure END AS failed_rule
FROM c LEFT JOIN first USING (rid)
"""


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y, c.n = s.n AND c.n = t.n AS same FROM common c JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 9 * c.n >= 4 * (s.n + t.n)
), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, least(doc_id, (SELECT min(y) FROM links WHERE x = doc_id AND same)) AS class_id,
  least(doc_id, (SELECT min(y) FROM reach WHERE x = doc_id)) AS group_id, (SELECT count(*) FROM links WHERE x = doc_id) AS n_links
FROM documents
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs.where(~language.held_out())))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(read_table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS_SQL} AS terms FROM documents),
t AS (SELECT sum(len(terms)) AS l, count(*) FILTER (len(terms) > 0) AS n FROM d),
p AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT rid, doc_id, unnest(terms) AS term, len(terms) AS size FROM d) GROUP BY rid, term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
s AS (SELECT item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * size * n) // l AS BIGINT))))) AS score FROM q JOIN w USING (term) JOIN p USING (term), t GROUP BY item_id, doc_id, rid),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= {search.TOP}
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


#: Near words by their single deletions; the checksum by a table of 256 remainders made by its rule.
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= {spelling.LEAST_CHARS} GROUP BY ALL),
drawn AS (SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS x FROM runs), crc),
words AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT n, CASE WHEN h % {spelling.DELETED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w FROM drawn) WHERE length(w) >= {spelling.LEAST_CHARS} GROUP BY w HAVING sum(n) >= {spelling.LEAST_COUNT}),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words) UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
best AS (SELECT x AS word, count(*) AS n_near, first(y ORDER BY n DESC, encode(y)) AS form, max(n) AS form_n FROM pairs JOIN words ON y = word GROUP BY x),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
roots AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM roots r JOIN f ON f.word = r.next)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN roots r ON r.word = f.word AND r.next IS NULL
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_digest(read_table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, h AS text_sha256
FROM d WINDOW same AS (PARTITION BY h)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_suffix_dedup, op3_best_fit_packing, op4_quality_rules, op5_ngram_jaccard_join, op6_secret_scan, op7_bpe, op8_language_id, op9_winnowing, op10_kneser_ney, op11_ranked_search, op12_spelling_variants, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op4_quality_rules": OP4_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op11_ranked_search": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_exact_dedup": OP13_SQL}
