"""The engine's queries over the driver's tables, each beside the SQL that it must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import features, guards
from palimpsest.operators import lineage, sessions, textdiff
from palimpsest.plans import catalog
from palimpsest.plans.catalog import Query, query, table
from palimpsest.plans.shipping import shared_folder
from palimpsest.sources import audit, external, patches, storage
from palimpsest.streaming import audit_stream

#: Markers and a name that occur in the tables; the guards' own default markers never do.
MARKERS = ["License", "token", "@"]


@query(r"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT lang, count(*) AS n_lines, count(*) FILTER (contains(line, 'License')) AS marker_lines,
  CAST(sum(len(regexp_extract_all(line, '[0-9]+'))) AS BIGINT) AS number_hits,
  CAST(sum(length(line)) AS BIGINT) AS chars
FROM l GROUP BY lang""")
def audit_lines(spark, sf_dir):
    """Lines, marked lines and numbers by language."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(
        F.count("*").alias("n_lines"), F.count_if(guards.first_marker("line", ["License"]).isNotNull()).alias("marker_lines"),
        F.sum(features.count_of("line", "[0-9]+")).alias("number_hits"), F.sum(F.char_length("line")).cast("bigint").alias("chars"),
    )


@query(r"""
SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'License' WHEN contains(text, 'token') THEN 'token' WHEN contains(text, '@') THEN '@' END AS first_marker
FROM documents""")
def marker_first_hit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", guards.first_marker("text", MARKERS).alias("first_marker"))


_DECLARED = r"""SELECT conv_id, turn, 'public ' || CASE WHEN turn % 3 = 0 THEN 'int ' ELSE 'void  ' END || role || ' (' || chr(10) || ') { // ' || text AS java, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS name FROM conversations"""


def _declared(spark, sf_dir):
    """Turns dressed as method declarations, with the name each ought to declare."""
    kind = F.when(F.col("turn") % 3 == 0, "int ").otherwise("void  ")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("public "), kind, "role", F.lit(" (\n) { // "), "text").alias("java"), F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("name"),
    )


@query(rf"SELECT conv_id, turn, coalesce(regexp_matches(java, '\bvoid\s+' || name || '\s*\('), false) AS present FROM ({_DECLARED})")
def required_method(spark, sf_dir):
    """The required-method guard with a name from the data."""
    return _declared(spark, sf_dir).select("conv_id", "turn", guards.method_present("java", F.col("name")).alias("present"))


@query(r"SELECT doc_id, regexp_matches(text, 'token\s*=') AS present FROM documents")
def required_pattern(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.rlike("text", F.lit(r"token\s*=")).alias("present"))


@query(rf"""
WITH g AS (SELECT name, coalesce(regexp_matches(java, '\bvoid\s+' || name || '\s*\('), false) AS p,
  CASE WHEN contains(java, 'please') THEN 'please' WHEN contains(java, 'the') THEN 'the' END AS m FROM ({_DECLARED}))
SELECT CASE WHEN NOT p THEN 'Test method disappeared: ' || name WHEN m IS NOT NULL THEN 'Disallowed marker found: ' || m END AS message, p AND m IS NULL AS ok, count(*) AS n
FROM g GROUP BY ALL""")
def guard_messages(spark, sf_dir):
    """Both guards in their order, as messages."""
    return guards.guard(_declared(spark, sf_dir), "java", "name", ["please", "the"]).groupBy("message", "ok").agg(F.count("*").alias("n"))


@query(r"""
SELECT quality, toxic, CASE WHEN contains(text, 'License') THEN 'License' WHEN contains(text, 'token') THEN 'token' WHEN contains(text, '@') THEN '@' END AS marker, count(*) AS docs
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def guard_summary(spark, sf_dir):
    marked = table(spark, sf_dir, "documents").select("doc_id", guards.first_marker("text", MARKERS).alias("marker"))
    return marked.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "marker").agg(F.count("*").alias("docs"))


@query("SELECT doc_id AS id, lang FROM documents")
def terse_projection(spark, sf_dir):
    """A record's hidden fields dropped by name; names that are not there do no harm."""
    return audit.terse(table(spark, sf_dir, "documents").selectExpr("doc_id id", "lang", "text prompt", "source completion", "text java_source"))


@query("SELECT epoch_us(ts) / 1e6 AS ts, event_type AS event, event_id, user_id, value FROM events")
def audit_roundtrip(spark, sf_dir):
    """Events written to a log as JSON lines and read back."""
    path = f"{shared_folder(spark)}/palimpsest/audit-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    audit.append(audit.records(events, F.col("event_type"), "ts", "event_id", "user_id", "value"), path)
    return audit.read(spark, path).select("ts", "event", *(audit.field(n, k).alias(n) for n, k in (("event_id", "bigint"), ("user_id", "bigint"), ("value", "double"))))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def extras_parse(spark, sf_dir):
    """A dynamic field taken from JSON without inference."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_type", (k % 10).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)(/.*)?$', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/]+)(/.*)?$', 2) AS host FROM pages")
def key_from_path(spark, sf_dir):
    part = lambda k: F.regexp_extract("url", r"^([a-z]+)://([^/]+)(/.*)?$", k)
    return table(spark, sf_dir, "pages").select("page_id", part(1).alias("scheme"), part(2).alias("host"))


@query(r"""SELECT CAST(doc_id % 90 + 1 AS INTEGER) AS project_id, source AS project, make_timestamp(2026, 1, 27, CAST(doc_id % 86400 // 3600 AS BIGINT), 30, 15.0) AS run_ts,
  '_C' || lang AS class_name, 'test' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS test_name, CAST(doc_id % 100 AS INTEGER) AS test_no, count(*) AS n
FROM documents GROUP BY ALL""")
def patch_tree_keys(spark, sf_dir):
    """Keys from paths of a patch tree; digits of a test's name are kept as text."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    d = F.col("doc_id")
    path = F.concat(F.lit("/"), (d % 90 + 1).cast("string"), F.lit("_"), "source", F.lit("/run_20260127_"), two(F.floor(d % 86400 / 3600)), F.lit("3015/patches/"), "source", F.lit("/_C"), "lang", F.lit("/test"), two(d % 100), F.lit(".diff"))
    files = table(spark, sf_dir, "documents").select(path.alias("file_path"), F.col("text").alias("value"))
    return patches.with_keys(files).groupBy("project_id", "project", "run_ts", "class_name", "test_name", "test_no").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT turn, unnest(string_split(text, ' ')) AS w FROM conversations),
d AS (SELECT w FROM t WHERE turn % 2 = 0 EXCEPT ALL SELECT w FROM t WHERE turn % 2 = 1)
SELECT w, count(*) AS extra FROM d GROUP BY w""")
def line_multiset_diff(spark, sf_dir):
    """What even turns say more often than odd ones."""
    words = table(spark, sf_dir, "conversations").select("turn", F.explode(F.split("text", " ")).alias("w"))
    return textdiff.line_multiset_diff(words.where("turn % 2 = 0"), words.where("turn % 2 = 1"), "w").groupBy("w").agg(F.count("*").alias("extra"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins(spark, sf_dir):
    return lineage.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type AS b, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'view' END AS a FROM events)
SELECT user_id, event_id, row_number() OVER w AS run_no, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN lag(a) OVER w IS NOT DISTINCT FROM b THEN 'chained'
  WHEN lag(b) OVER w IS NOT DISTINCT FROM b THEN 'restarted' ELSE 'other' END AS relation
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def chain_lag(spark, sf_dir):
    """Whether each event starts from the state its predecessor left."""
    e = table(spark, sf_dir, "events").withColumns({"b": F.col("event_type"), "a": F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("view")})
    return lineage.chains(e, ["user_id"], ["ts", "event_id"], "b", "a").select("user_id", "event_id", "run_no", "relation")


@query("SELECT lang, copies, count(*) AS groups FROM (SELECT lang, sha256(text) AS content, count(*) AS copies FROM documents GROUP BY ALL) GROUP BY ALL")
def dedup_exact(spark, sf_dir):
    return lineage.distinct_edits(table(spark, sf_dir, "documents"), ["lang"], "text").groupBy("lang", "copies").agg(F.count("*").alias("groups"))


@query("""
SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(max(n_chars) AS BIGINT) AS longest, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level
FROM documents GROUP BY ROLLUP (lang, source)""")
def class_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.grouping_id().cast("bigint").alias("level"))


@query("""
SELECT doc_id, lang, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers FROM documents ORDER BY numbers DESC, doc_id LIMIT 25""")
def top_k_shift(spark, sf_dir):
    """A report of the 25 documents with most numbers, ties by id."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", features.count_of("text", "[0-9]+").alias("numbers")).orderBy(F.desc("numbers"), "doc_id").limit(25)


@query("SELECT a.conv_id, a.turn, a.role AS state, b.role AS next_state FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def neighbour_state(spark, sf_dir):
    return lineage.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", F.col("role").alias("state"), "next_state")


@query("SELECT doc_id, 'License' AS marker FROM documents WHERE contains(text, 'License')")
def contract_violations(spark, sf_dir):
    return lineage.violations(table(spark, sf_dir, "documents"), "text", ["License"]).select("doc_id", "marker")


#: Words of the documents, and the bits of Java that stand for them before and after a repair.
BEFORE = {
    "of": "try {", "de": "try {", "der": "try {", "was": 'verifyException("A",', "et": "fail(", "und": "fail(", "that": "// Undeclared exception!", "for": "Unstable assertion", "the": "assertEquals(3,",
    "la": "assertEquals(x, x)", "die": "assertNull(", "el": "assertFalse(", "les": "map.put(1,", "at": "instanceof", "with": "for (",
}
AFTER = {
    "of": 'assertTrue("of",', "the": "assertNotNull(", "la": "assertSame(y , y)", "und": "list.add(4); assertEquals(5, n)", "et": "set.clear(); assertArrayEquals(", "on": "try {", "dans": "finally {", "that": "instanceof", "with": "for (int i",
    "by": "f.setAccessible(", "zu": "getDeclaredField(", "was": "throws Exception", "y": "assertNotSame(", "en": "assertNotEquals(", "in": "in ", "is": "assertThrows(\n", "les": "fail(",
}
_BODY_SQL = lambda words: "array_to_string(list_transform(string_split(text, ' '), lambda w: CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in words.items()) + " ELSE w END), ' ')"
_HEAD_AFTER = "CASE WHEN contains(text, 'License') THEN '@Test(timeout = 4000, expected = E.class)' WHEN contains(text, 'token') THEN '@Test(timeout = 4004)' WHEN length(text) % 2 = 0 THEN '@Test' ELSE '@Test(timeout = 4000)' END"
_METHOD_SQL = f"""
SELECT doc_id, lang, source, before, CASE WHEN length(text) % 7 = 3 THEN replace(before, chr(10), chr(10) || '  ') ELSE after END AS after
FROM (SELECT doc_id, lang, source, text, '@Test(timeout = 4000)' || chr(10) || 'public void test' || doc_id || '() throws Throwable {{' || chr(10) || {_BODY_SQL(BEFORE)} || chr(10) || '}}' AS before,
  {_HEAD_AFTER} || chr(10) || 'public void test' || doc_id || '() throws Throwable {{' || chr(10) || {_BODY_SQL(AFTER)} || chr(10) || '}}' AS after
FROM documents)"""


def _swapped(words: dict[str, str]):
    """The document's text with some of its words replaced."""

    def one(w):
        out = w
        for k, v in words.items():
            out = F.when(w == k, v).otherwise(out)
        return out

    return F.array_join(F.transform(F.split("text", " "), one), " ")


def _methods(spark, sf_dir):
    """A test method before and after repair, made of each document's whole text; one in seven is only indented."""
    method = lambda head, words: F.concat(head, F.lit("\npublic void test"), "doc_id", F.lit("() throws Throwable {\n"), _swapped(words), F.lit("\n}"))
    rows = table(spark, sf_dir, "documents").withColumns({"before": method(F.lit("@Test(timeout = 4000)"), BEFORE), "after": method(F.expr(_HEAD_AFTER), AFTER)})
    indented = F.when(F.char_length("text") % 7 == 3, F.replace("before", F.lit("\n"), F.lit("\n  "))).otherwise(F.col("after"))
    return rows.select("doc_id", "lang", "source", "before", indented.alias("after"))


def _count_sql(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


_FEATURES_SQL = "SELECT *, " + ", ".join(f"{_count_sql(s, p)} AS {n}_{s}" for n, p in features.PATTERNS.items() for s in ("before", "after")) + f" FROM ({_METHOD_SQL})"
_TIMEOUT_SQL = "regexp_extract({}, 'timeout\\s*=\\s*([0-9]+)', 1)"
_LITERALS_SQL = f"regexp_extract_all({{}}, '{features.LITERAL}')"
_PAIR_SQL = f"list_transform(regexp_extract_all(after, '{features.TWO_SIDED}', {{}}), lambda v: trim(v))"
#: Each flag of a pair of methods as SQL.
FLAGS_SQL = {
    "try_to_expected": "try_blocks_before > 0 AND try_blocks_after = 0 AND expected_before = 0 AND expected_after > 0",
    "try_lost": "try_blocks_before > 0 AND try_blocks_after = 0 AND expected_after = 0",
    "value_test": f"try_blocks_before > 0 AND try_blocks_after = 0 AND expected_after = 0 AND asserts_after > 0 AND len(list_filter({_LITERALS_SQL.format('after')}, lambda v: NOT list_contains({_LITERALS_SQL.format('before')}, v))) > 0",
    "try_kept": "try_blocks_before > 0 AND try_blocks_after > 0",
    "try_gained": "try_blocks_before = 0 AND try_blocks_after > 0",
    "more_asserts": "asserts_after > asserts_before",
    "same_asserts": "asserts_after = asserts_before",
    "fewer_asserts": "asserts_after < asserts_before",
    "assert_free_fixed": "asserts_before = 0 AND asserts_after > 0",
    "assert_free_gained": "asserts_before > 0 AND asserts_after = 0",
    "unchecked_after": "asserts_after = 0 AND expected_after = 0 AND fails_after = 0",
    "whitespace_only": "before <> after AND regexp_replace(before, '\\s+', '', 'g') = regexp_replace(after, '\\s+', '', 'g')",
    "state_before_assert": f"state_calls_after > state_calls_before AND regexp_matches(after, '(?s){features.PATTERNS['state_calls']}.*\\bassert\\w+\\s*\\(')",
    "throws_narrowed": "throws_exception_before = 0 AND throws_exception_after > 0",
    "self_comparing": f"len(list_filter(list_zip({_PAIR_SQL.format(1)}, {_PAIR_SQL.format(2)}), lambda p: p[1] = p[2])) > 0",
    "timeout_dropped": "timeouts_before > 0 AND timeouts_after = 0",
    "timeout_changed": f"timeouts_before > 0 AND timeouts_after > 0 AND {_TIMEOUT_SQL.format('before')} <> {_TIMEOUT_SQL.format('after')}",
}


@query(f"""
WITH f AS ({_FEATURES_SQL})
SELECT lang, count(*) AS methods, {", ".join(f"CAST(sum({n}_{s}) AS BIGINT) AS {n}_{s}" for n in features.PATTERNS for s in ("before", "after"))},
  count(*) FILTER (regexp_extract(after, '@Test\\s*\\([^)]*expected\\s*=\\s*([\\w.]+)\\.class', 1) = 'E') AS expected_e,
  CAST(sum(len(string_split(after, chr(10))) - len(string_split(before, chr(10)))) AS BIGINT) AS net_lines
FROM f GROUP BY lang""")
def edit_features(spark, sf_dir):
    """What each side of the method pairs has, per language."""
    rows = features.flags(features.counts(_methods(spark, sf_dir), "before", "after"))
    sums = [F.sum(f"{n}_{s}").alias(f"{n}_{s}") for n in features.PATTERNS for s in ("before", "after")]
    return rows.groupBy("lang").agg(F.count("*").alias("methods"), *sums, F.count_if(F.col("expected_type") == "E").alias("expected_e"), F.sum("net_lines").alias("net_lines"))


@query(f"SELECT doc_id, {', '.join(f'({e}) AS {n}' for n, e in FLAGS_SQL.items())} FROM ({_FEATURES_SQL})")
def edit_flags(spark, sf_dir):
    """What happened to each method."""
    return features.flags(features.counts(_methods(spark, sf_dir), "before", "after")).select("doc_id", *FLAGS_SQL)


_ROLLED = ("try_lost", "more_asserts", "unchecked_after", "self_comparing")


@query(f"""
SELECT lang, source, count(*) AS methods, CAST(sum(asserts_after) AS BIGINT) AS asserts_after, {", ".join(f"count(*) FILTER ({FLAGS_SQL[n]}) AS {n}" for n in _ROLLED)}
FROM ({_FEATURES_SQL}) GROUP BY ROLLUP (lang, source)""")
def edit_rollup(spark, sf_dir):
    """The flags by language and source, with subtotals."""
    rows = features.flags(features.counts(_methods(spark, sf_dir), "before", "after"))
    return features.rollup(rows, "lang", "source").select("lang", "source", "methods", "asserts_after", *_ROLLED)


#: Lines are numbered, so that none repeats; those that hold this are changed.
_LINES = """SELECT doc_id, list_transform(range(1, len(l) + 1), lambda i: i || ': ' || l[i]) AS l, list_filter(range(1, len(l) + 1), lambda i: contains(l[i], 'es,')) AS changed FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
#: Changed lines more than six unchanged ones apart are in different hunks; a hunk has three lines around its changes.
_HUNKS = f"""
SELECT doc_id, hunk_no, greatest(1, min(i) - 3) AS old_start, least(max(n), max(i) + 3) - greatest(1, min(i) - 3) + 1 AS old_len, count(*) AS changes
FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS hunk_no
  FROM (SELECT doc_id, i, n, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 7, true) AS fresh FROM (SELECT doc_id, unnest(changed) AS i, len(l) AS n FROM ({_LINES}))))
GROUP BY doc_id, hunk_no"""


def _edits(spark, sf_dir):
    """Every document's numbered lines before and after a change of some, and the diff of the two."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    changed = F.transform(lines, lambda x: F.when(F.contains(x, F.lit("es,")), F.concat(x, F.lit(" //"))).otherwise(x))
    # One text in three has CR LF, one in two no end of its last line.
    end = F.when(F.col("doc_id") % 3 == 0, "\r\n").otherwise("\n")
    ended = lambda x: F.concat(F.array_join(F.transform(x, lambda y: F.concat(F.when(F.substring_index(y, ": ", 1) == "1", "").otherwise(end), y)), ""), F.when(F.col("doc_id") % 2 == 0, end).otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", ended(lines).alias("before"), ended(changed).alias("after"))
    rows = rows.withColumn("raw", textdiff.diff("before", "after", F.concat(F.lit("evosuite/T"), "doc_id", F.lit(".java"))))
    return rows.select("doc_id", "before", "after", "raw", F.col("doc_id").alias("project_id"), F.lit("r").alias("run_ts"), F.lit("C").alias("class_name"), F.lit("t").alias("test_name"))


@query(f"""
WITH h AS ({_HUNKS})
SELECT d.doc_id, coalesce(hunks, 0) AS hunks, coalesce(n, 0) AS removed, coalesce(n, 0) AS added, true AS fits
FROM documents d LEFT JOIN (SELECT doc_id, CAST(max(hunk_no) AS BIGINT) AS hunks, CAST(sum(changes) AS BIGINT) AS n FROM h GROUP BY doc_id) USING (doc_id)""")
def diff_roundtrip(spark, sf_dir):
    """Diffs of whole texts, parsed into lines, and applied: how many hunks and lines they have, and whether they give `after` again."""
    edits = _edits(spark, sf_dir)
    lines = patches.patch_lines(edits.where("raw <> ''"))
    n = lines.groupBy(F.col("project_id").alias("doc_id")).agg(F.max("hunk_no").cast("bigint").alias("hunks"), F.count_if(F.col("op") == "-").alias("removed"), F.count_if(F.col("op") == "+").alias("added"))
    done = textdiff.fold_patches(edits.select("doc_id", F.col("before").alias("text")), edits.select("doc_id", F.lit(1).alias("seq"), "raw"), "doc_id")
    rows = edits.select("doc_id", "after").join(done, "doc_id").join(n, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("doc_id", zero("hunks"), zero("removed"), zero("added"), (F.col("text") == F.col("after")).alias("fits"))


@query(f"SELECT doc_id, CAST(hunk_no AS INTEGER) AS hunk_no, CAST(old_start AS INTEGER) AS old_start, CAST(old_len AS INTEGER) AS old_len, CAST(old_start AS INTEGER) AS new_start, CAST(old_len AS INTEGER) AS new_len FROM ({_HUNKS})")
def hunk_headers(spark, sf_dir):
    """Headers of the hunks of whole texts' diffs, read by expressions alone."""
    return patches.hunks(_edits(spark, sf_dir)).select(F.col("project_id").alias("doc_id"), "hunk_no", "old_start", "old_len", "new_start", "new_len")


@query("""
SELECT doc_id, CAST(3 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS rejected, text || chr(10) || 'run 1' || chr(10) || 'run 2' || chr(10) || 'run 3' || chr(10) AS text FROM documents""")
def sequential_patches(spark, sf_dir):
    """Three patches of every document applied in the order that the data gives, each on what the one before left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n")).alias("text"))
    stage = lambda k: F.concat("text", *(F.lit(f"run {i}\n") for i in range(1, k + 1)))
    each = [docs.select("doc_id", F.lit(k).alias("seq"), textdiff.diff(stage(k - 1) if k > 1 else F.col("text"), stage(k), F.lit("T.java")).alias("raw")) for k in (3, 1, 2)]
    return textdiff.fold_patches(docs, each[0].unionByName(each[1]).unionByName(each[2]), "doc_id")


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type AS event, count(*) AS n FROM events GROUP BY ALL""")
def audit_windows(spark, sf_dir):
    """The batch form of the stream's windowed counts."""
    recs = table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_type").alias("event"))
    return audit_stream.windowed_counts(recs, "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event", "n")


@query(f"""
WITH m AS ({_METHOD_SQL})
SELECT lang, kind, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after FROM (
  SELECT lang, unnest([{", ".join(f"'{k}'" for k in features.ASSERTIONS)}]) AS kind, unnest([{", ".join(_count_sql("before", rf"{chr(92)}bassert{k}{chr(92)}s*{chr(92)}(") for k in features.ASSERTIONS)}]) AS b,
    unnest([{", ".join(_count_sql("after", rf"{chr(92)}bassert{k}{chr(92)}s*{chr(92)}(") for k in features.ASSERTIONS)}]) AS a FROM m)
GROUP BY ALL""")
def assertion_kinds(spark, sf_dir):
    """Calls of each kind of assertion before and after, by language."""
    rows = features.counts(_methods(spark, sf_dir), "before", "after")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"assert_{k.lower()}_before").alias("b"), F.col(f"assert_{k.lower()}_after").alias("a")) for k in features.ASSERTIONS))
    return rows.select("lang", F.inline(kinds)).groupBy("lang", "kind").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))


@query("SELECT conv_id, turn, role FROM conversations")
def guard_enforced(spark, sf_dir):
    """Every turn through the strict guard, which would stop the job at the first that lacks its method."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("public void\t"), "role", F.lit(" () { // "), "text").alias("java"))
    return guards.enforced(rows, "java", "role").select("conv_id", "turn", "role")


_PLANTED = "replace(replace(text, 'token', '@Ignore'), 'License', 'org.junit.Ignore')"


@query(f"SELECT doc_id, CASE WHEN contains(t, '@Ignore') THEN '@Ignore' WHEN contains(t, 'org.junit.Ignore') THEN 'org.junit.Ignore' END AS marker FROM (SELECT doc_id, {_PLANTED} AS t FROM documents)")
def default_markers(spark, sf_dir):
    """The markers that are forbidden by default, in texts where other words were replaced by them."""
    return table(spark, sf_dir, "documents").select("doc_id", guards.first_marker(F.expr(_PLANTED)).alias("marker"))


@query("SELECT event_id, 'run_' || strftime(ts, '%Y%m%d_%H%M%S') AS run FROM events")
def run_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", patches.run_stamp("ts").alias("run"))


@query("SELECT n_nationkey, n_name FROM nation")
def directory_copy(spark, sf_dir):
    """A written table's directory copied over another one, read from there."""
    base = f"{shared_folder(spark)}/palimpsest/copy-{uuid.uuid4().hex}"
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nation.write.parquet(f"{base}/new")
    nation.limit(1).write.parquet(f"{base}/old")
    storage.ensure_empty_dir(spark, f"{base}/empty")
    storage.copytree(spark, f"{base}/new", f"{base}/old")
    return spark.read.parquet(f"{base}/old")


@query("""
SELECT s_suppkey, CAST(s_suppkey % 3 AS INTEGER) AS exit_code, s_name || ' of ' || n_name || chr(10) AS output, CASE WHEN s_suppkey % 3 <> 0 THEN 'exit' END AS failure
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def build_step(spark, sf_dir):
    """A command run for every supplier, by tasks: its output, its exit code, and whether it failed."""
    script = F.concat(F.lit('echo "$0 of $1"; exit '), F.col("s_suppkey") % 3)
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = rows.select("s_suppkey", F.array(F.lit("-c"), script, "s_name", "n_name").alias("targets"))
    return external.build_rows(rows, "targets", command="sh").drop("targets")


@query("SELECT r_regionkey, true AS before, false AS after FROM region")
def directory_empty(spark, sf_dir):
    """What is in a directory before and after it was emptied."""
    base = f"{shared_folder(spark)}/palimpsest/emptied-{uuid.uuid4().hex}"
    region = table(spark, sf_dir, "region").select("r_regionkey")
    region.withColumn("part", F.col("r_regionkey")).write.partitionBy("part").parquet(base)
    listed = lambda: F.array(*(F.lit(name) for name, is_dir, _ in storage.listing(spark, base) if is_dir)).cast("array<string>")
    before = listed()
    storage.ensure_empty_dir(spark, base)
    part = F.concat(F.lit("part="), "r_regionkey")
    return region.select("r_regionkey", F.array_contains(before, part).alias("before"), F.array_contains(listed(), part).alias("after"))


@query(r"""
SELECT doc_id, 'class T {' || chr(10) || '// ' || replace(text, chr(10), chr(10) || '// ') || chr(10) || '@Test' || chr(10) || 'void ' || source || '() { run("' || lang || '"); }' || chr(10) || chr(10) || '}' AS source FROM documents""")
def method_replacement(spark, sf_dir):
    """The method of a source, found beneath the whole text as its comment, replaced by another, trimmed and followed by a blank line."""
    noted = lambda between: F.concat(F.lit("class T {\n// "), F.replace("text", F.lit("\n"), F.lit("\n// ")), F.lit(between))
    old = F.concat(noted("\n@Test(timeout = 4000)\npublic void "), "source", F.lit("() {\n// { "), F.replace("text", F.lit("\n"), F.lit("\n// ")), F.lit("\nif (x) { y('}'); }\n}\n}"))
    new = F.concat(F.lit("  @Test\nvoid "), "source", F.lit('() { run("'), "lang", F.lit('"); }\n\n'))
    return table(spark, sf_dir, "documents").select("doc_id", textdiff.replace_method(old, "source", new).alias("source"))


@query("""
SELECT CAST(n_nationkey + 1 AS INTEGER) AS project_id, n_name AS project, '_Request' AS class_name, 'test0' || n_regionkey AS test_name, CAST(1 AS BIGINT) AS removed, CAST(2 AS BIGINT) AS added, lower(replace(n_name, ' ', '')) AS package FROM nation""")
def patch_tree(spark, sf_dir):
    """A tree of patch files as they are stored, one to a file, in a class directory that starts with _, listed and parsed into lines."""
    root = f"{shared_folder(spark)}/palimpsest/tree-{uuid.uuid4().hex}"
    package = F.lower(F.replace("n_name", F.lit(" "), F.lit("")))
    raw = F.concat(F.lit("--- a/evosuite/"), package, F.lit("/T.java\n+++ b/evosuite/"), package, F.lit("/T.java\n@@ -3,1 +3,2 @@\n-"), "n_name", F.lit("\n+"), "n_regionkey", F.lit("\n+\n"))
    path = F.concat(F.lit(f"{root}/"), (F.col("n_nationkey") + 1).cast("string"), F.lit("_"), "n_name", F.lit("/run_20260127_030639/patches/"), "n_name", F.lit("/_Request/test0"), "n_regionkey", F.lit(".diff"))
    patches.write_files(table(spark, sf_dir, "nation").select(path.alias("path"), raw.alias("raw")))
    tree = patches.read_tree(spark, root)
    lines = patches.patch_lines(tree).groupBy(*patches.KEY).agg(F.count_if(F.col("op") == "-").alias("removed"), F.count_if(F.col("op") == "+").alias("added"))
    return tree.join(lines, list(patches.KEY)).select("project_id", "project", "class_name", "test_name", "removed", "added", "package")


@query("SELECT source AS project, 'run_2026012' || (1 + n_chars % 3) || '_000000' AS run, count(*) AS patches, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def patch_sink(spark, sf_dir):
    """Patches stored by project and run, and read back by those partitions."""
    path = f"{shared_folder(spark)}/palimpsest/sink-{uuid.uuid4().hex}"
    day = F.concat(F.lit("2026-01-2"), (1 + F.col("n_chars") % 3).cast("string"))
    patches.write_tree(table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.to_timestamp_ntz(day).alias("run_ts"), F.col("text").alias("raw")), path)
    return spark.read.parquet(path).groupBy("project", "run").agg(F.count("*").alias("patches"), F.sum(F.char_length("raw")).alias("chars"))


_SIDES = """SELECT conv_id, turn, text AS removed, text || '!' AS added, role, length(text) AS n, lag(text) OVER w AS prev, lead(text) OVER w AS nxt, lag(length(text)) OVER w AS prev_n, lead(length(text)) OVER w AS next_n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
#: What a turn's patch shows of the turns beside it: repaired, original or not at all, as the lengths of the two texts will have it.
_CONTEXT = "concat_ws(chr(10), CASE WHEN (n + prev_n) % 3 = 0 THEN prev || '!' WHEN (n + prev_n) % 3 = 1 THEN prev END, CASE WHEN (2 * n + next_n) % 3 = 0 THEN nxt || '!' WHEN (2 * n + next_n) % 3 = 1 THEN nxt END)"


@query(f"""
WITH s AS (SELECT conv_id, turn, removed, added, {_CONTEXT} AS context FROM ({_SIDES})),
p AS (SELECT a.conv_id, a.turn, CASE WHEN contains(a.context, b.added) THEN 'repaired' WHEN contains(a.context, b.removed) THEN 'original' ELSE 'neither' END AS this_shows,
  CASE WHEN contains(b.context, a.added) THEN 'repaired' WHEN contains(b.context, a.removed) THEN 'original' ELSE 'neither' END AS next_shows FROM s a JOIN s b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT *, CASE WHEN this_shows = 'original' AND next_shows = 'original' THEN 'unapplied' WHEN next_shows = 'repaired' AND this_shows <> 'repaired' THEN 'this first'
  WHEN this_shows = 'repaired' AND next_shows <> 'repaired' THEN 'next first' ELSE 'unknown' END AS "order" FROM p""")
def work_order(spark, sf_dir):
    """The order of work on neighbouring turns, and edits saved yet not applied, from what their patches show of each other."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("palimpsest_conversations")
    rows = spark.sql(f"SELECT conv_id, turn, removed, added, {_CONTEXT} AS context FROM ({_SIDES.replace('FROM conversations', 'FROM palimpsest_conversations')})")
    return lineage.evidence(rows, ["conv_id"], "turn").select("conv_id", "turn", "this_shows", "next_shows", "order")


_SIGNED = {side: f"replace(text, '{word}', ' void test (')" for side, word in (("before", " en "), ("removed", " the "), ("added", " of "))}


@query(f"""
SELECT doc_id, CASE WHEN a AND r THEN 'both' WHEN a THEN 'added' WHEN r THEN 'removed' WHEN b THEN 'context' ELSE 'nowhere' END AS visible
FROM (SELECT doc_id, {", ".join(f"contains({e}, 'void test (') AS {side[0]}" for side, e in _SIGNED.items())} FROM documents)""")
def signature_visibility(spark, sf_dir):
    """Where a patch shows its method's signature; the sides are the document's text with one word or another made the signature."""
    sides = table(spark, sf_dir, "documents").select("doc_id", F.lit("test").alias("name"), *(F.expr(e).alias(side) for side, e in _SIGNED.items()))
    return lineage.signature_visibility(sides, "name").select("doc_id", "visible")


@query("""
WITH e AS (SELECT event_type, ts, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL 10 MINUTE AS fresh FROM events),
s AS (SELECT *, sum(CASE WHEN fresh IS DISTINCT FROM false THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS no FROM e)
SELECT event_type AS event, min(ts) AS first, count(*) AS n FROM s GROUP BY event_type, no""")
def audit_sessions(spark, sf_dir):
    """Runs of events of one kind without a pause of ten minutes: the batch form of the stream's sessions."""
    recs = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("event"))
    return sessions.sessions(recs, "event", "at", 600_000_000).select("event", F.timestamp_micros("first").cast("timestamp_ntz").alias("first"), "n")


@query("SELECT CAST(user_id AS VARCHAR) AS user, count(*) AS n, max_by(event_type, (ts, event_type)) AS last_event FROM events GROUP BY user_id")
def audit_running_totals(spark, sf_dir):
    """Totals of each user kept as state while the log is read as a stream; the last state of each is the result."""
    base = f"{shared_folder(spark)}/palimpsest/totals-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_type", F.col("user_id").cast("string").alias("user"))
    audit.append(audit.records(events, F.col("event_type"), "ts", "user"), f"{base}/log")
    records = audit_stream.read_stream(spark, f"{base}/log").select("ts", "event", audit.field("user", "string").alias("user"))

    def store(batch: DataFrame, n: int) -> None:  # a batch that runs again replaces itself
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    audit_stream.running_totals(records, "user").writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    return lineage.latest(spark.read.parquet(f"{base}/out"), ["user"], "batch", "n").select("user", "n", "last_event")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def audit_stream_windows(spark, sf_dir):
    """The log read as a stream until it is drained, windows counted with a watermark."""
    base = f"{shared_folder(spark)}/palimpsest/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_type")
    audit.append(audit.records(events, F.col("event_type"), "ts"), f"{base}/log")
    counts = audit_stream.windowed_counts(audit_stream.read_stream(spark, f"{base}/log"), "1 day")
    out = counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event", "n")

    def store(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    out.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


from palimpsest.plans import history  # noqa: E402, F401  its queries join these


def queries() -> dict[str, Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
