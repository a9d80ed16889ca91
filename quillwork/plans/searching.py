"""Search, pages and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import paging, search
from ..registry import query
from ..sources import corpus
from .sql import PARAGRAPHS, normalised

PATTERNS = ["the", "with", "was"]
_RE = r"(?i)\b(the|with|was)\b"

_HEADER = r"""CASE WHEN NOT regexp_matches(text, '^[A-Z]') OR length(text) < 2 THEN NULL
  WHEN length(trim(text)) <= 50 THEN
    CASE WHEN right(trim(text), 1) IN ('.', ':') THEN left(trim(text), length(trim(text)) - 1)
         WHEN len(regexp_split_to_array(trim(text), '\s+')) <= 5 THEN trim(text) END
  WHEN h <> '' AND length(trim(text)) > length(h) AND length(trim(p)) <= 60 THEN trim(p) END"""
_HEADER_PARTS = r"""regexp_extract(trim(text), '^([A-Z][^.!?:]*(?:\s+[A-Z][^.!?:]*)*)([.:]?)(?:\s|$)', 0) AS h,
  regexp_extract(trim(text), '^([A-Z][^.!?:]*(?:\s+[A-Z][^.!?:]*)*)([.:]?)(?:\s|$)', 1) AS p,
  regexp_extract(trim(text), '^([A-Z][^.!?:]*(?:\s+[A-Z][^.!?:]*)*)([.:]?)(?:\s|$)', 2) AS stop"""


@query("grep_paragraphs", f"""
SELECT doc_id, para_idx, CAST(len(regexp_extract_all(text, '{_RE}')) AS BIGINT) AS match_count, m AS match_text,
  '...' || substr(text, greatest(pos - 50, 1), least(50, pos - 1)) || '>>>' || m || '<<<' || substr(text, pos + length(m), 50) || '...' AS context,
  '' AS list_label, coalesce({_HEADER}, '') AS header
FROM (SELECT *, regexp_extract(text, '{_RE}') AS m, length(regexp_split_to_array(text, '{_RE}')[1]) + 1 AS pos, {_HEADER_PARTS}
      FROM {PARAGRAPHS} WHERE regexp_matches(text, '{_RE}'))
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) <= 100""")
def grep_paragraphs(spark, sf_dir):
    rows, _ = search.grep(corpus.paragraphs(spark, sf_dir), PATTERNS, whole_word=True, rules=X.WHOLE_NUMBER_RULES)
    return rows.withColumn("match_count", F.col("match_count").cast("long"))


@query("grep_totals", f"""
SELECT CAST(sum(len(regexp_extract_all(text, '{_RE}'))) AS BIGINT) AS total_matches, count(*) AS paragraphs_with_matches, CAST(NULL AS VARCHAR) AS error
FROM {PARAGRAPHS} WHERE regexp_matches(text, '{_RE}')""")
def grep_totals(spark, sf_dir):
    return search.grep(corpus.paragraphs(spark, sf_dir), PATTERNS, whole_word=True)[1]


@query("grep_bad_pattern", "SELECT CAST(0 AS BIGINT) AS total_matches, CAST(0 AS BIGINT) AS paragraphs_with_matches, TRUE AS has_error")
def grep_bad_pattern(spark, sf_dir):
    totals = search.grep(corpus.paragraphs(spark, sf_dir), ["(open"])[1]
    return totals.select("total_matches", "paragraphs_with_matches", F.startswith("error", F.lit("Invalid regex pattern")).alias("has_error"))


@query("grep_per_match", f"""
SELECT doc_id, para_idx, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS match_idx, unnest(found) AS match_text
FROM (SELECT doc_id, para_idx, regexp_extract_all(text, '{_RE}') AS found FROM {PARAGRAPHS}) WHERE len(found) > 0""")
def grep_per_match(spark, sf_dir):
    return search.grep_each(corpus.paragraphs(spark, sf_dir), PATTERNS, whole_word=True)


@query("paragraph_page", f"""
SELECT doc_id, para_idx, text, n, total, total > 5 AS has_more, CAST(CASE WHEN total > 5 THEN 6 END AS BIGINT) AS next_offset FROM
 (SELECT doc_id, para_idx, text, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS n, count(*) OVER (PARTITION BY doc_id) AS total
  FROM {PARAGRAPHS} WHERE trim(text) <> '') WHERE n BETWEEN 3 AND 5""")
def paragraph_page(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).where(F.trim("text") != "").select("doc_id", "para_idx", "text")
    out = paging.page(rows, offset=3, limit=3)
    return out.withColumns({"n": F.col("n").cast("long"), "next_offset": F.col("next_offset").cast("long")})


@query("paragraph_tail", f"""
SELECT doc_id, para_idx, n, total FROM
 (SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS n, count(*) OVER (PARTITION BY doc_id) AS total
  FROM {PARAGRAPHS} WHERE trim(text) <> '') WHERE n > greatest(total - 2, 0)""")
def paragraph_tail(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).where(F.trim("text") != "").select("doc_id", "para_idx")
    return paging.page(rows, offset=-2).select("doc_id", "para_idx", F.col("n").cast("long").alias("n"), "total")


@query("revision_page", f"""
SELECT doc_id, para_idx FROM (SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS n FROM {PARAGRAPHS}) WHERE n > 1 AND n <= 5""")
def revision_page(spark, sf_dir):
    return paging.revision_page(corpus.paragraphs(spark, sf_dir), offset=1, limit=4).select("doc_id", "para_idx")


@query("token_budget_page", f"""
SELECT doc_id, para_idx, CAST(used AS BIGINT) AS used_chars FROM
 (SELECT doc_id, para_idx, sum(length(text) + 1) OVER w AS used, row_number() OVER w AS n FROM {PARAGRAPHS} WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx))
WHERE n = 1 OR ceil(used / 4.0) <= 1000""")
def token_budget_page(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", "text")
    return paging.within_budget(rows, F.length("text"), 1000).select("doc_id", "para_idx", "used_chars")


@query("index_lists", """
SELECT doc_id, list_sort(list_filter(l, lambda i: i >= 0 AND i < n)) AS found, list_sort(list_filter(l, lambda i: i < 0 OR i >= n)) AS missing
FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, [3, 0, 3, 40, -1] AS raw, [-1, 0, 3, 40] AS l FROM documents)""")
def index_lists(spark, sf_dir):
    wanted = F.array(*map(F.lit, (3, 0, 3, 40, -1)))
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", paging.index_lists(wanted, F.size(F.split("text", "\n"))).alias("x"))
    return rows.select("doc_id", "x.found", "x.missing")


@query("headers", f"""
SELECT doc_id, para_idx, {_HEADER} AS header,
  CASE WHEN ({_HEADER}) IS NULL THEN NULL WHEN length(trim(text)) <= 50 THEN CASE right(trim(text), 1) WHEN '.' THEN 'title_with_period' WHEN ':' THEN 'title_with_colon' ELSE 'title_bare' END
       ELSE CASE stop WHEN '.' THEN 'title_with_period' WHEN ':' THEN 'title_with_colon' ELSE 'title_bare' END END AS style
FROM (SELECT *, {_HEADER_PARTS} FROM {PARAGRAPHS})""")
def headers(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", X.header(F.col("text")).alias("h"))
    return rows.select("doc_id", "para_idx", F.col("h.text").alias("header"), F.col("h.style").alias("style"))


@query("paragraph_identity", f"""
WITH own AS (SELECT doc_id, para_idx, {normalised('text')} AS t FROM {PARAGRAPHS}),
seeds AS (SELECT doc_id, para_idx, t || '|' || coalesce(lag(t) OVER w, '') || '|' || coalesce(lead(t) OVER w, '') AS seed FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx)),
salted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seed ORDER BY para_idx) - 1 AS r FROM seeds)
SELECT doc_id, para_idx, '_bk_' || left(sha1(seed || CASE WHEN r > 0 THEN '|salt:' || r ELSE '' END), 12) AS para_id FROM salted""")
def paragraph_identity(spark, sf_dir):
    from ..operators.groups import identities

    return identities(corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", "text")).select("doc_id", "para_idx", "para_id")


def _matches(spark, sf_dir):
    """Every document and benchmark item of which a stage finds the item."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    pairs = search.match_candidates(docs, items)
    rows = pairs.join(docs, "doc_id").join(items, "item_id").withColumn("m", F.explode(F.array(search.unique_match(F.col("text"), F.col("needle")))))  # computed once
    return rows.where("m.status <> 'not_found'")


_CLEAN = f"regexp_replace(text, '{search.MATCH_TAGS}', '', 'g')"
_STRAIGHT = f"regexp_replace(regexp_replace({_CLEAN}, '[“”«»‹›]', '\"', 'g'), '[‘’]', '''', 'g')"
_SPACED = f"regexp_replace({_STRAIGHT}, '\\s+', ' ', 'g')"
_SEEN = f"[text, {_CLEAN}, {_STRAIGHT}, {_SPACED}, regexp_replace({_SPACED}, '[\"'']', '', 'g')]"


@query("unique_match_status", f"""
WITH d AS (SELECT doc_id, {_SEEN} AS t FROM documents), i AS (SELECT item_id, {_SEEN} AS n FROM benchmark),
f AS (SELECT doc_id, item_id, t, n, list_position(list_transform(range(1, 6), lambda k: n[k] <> '' AND contains(t[k], n[k])), TRUE) AS k FROM d, i)
SELECT doc_id, item_id, CASE WHEN contains(substr(t[k], instr(t[k], n[k]) + 1), n[k]) THEN 'multiple' ELSE 'unique' END AS status, {list(search.STAGES)}[k] AS mode FROM f WHERE k > 0""")
def unique_match_status(spark, sf_dir):
    return _matches(spark, sf_dir).select("doc_id", "item_id", "m.status", "m.mode")


@query("unique_match_span")
def unique_match_span(spark, sf_dir):
    rows = _matches(spark, sf_dir).withColumn("s", search.unique_span(F.col("text"), F.col("needle")))
    return rows.select("doc_id", "item_id", "s.start", "s.stop")


@query("match_positions", """
SELECT item_id, list_filter(range(0, length(text) - 1), lambda i: substr(text, CAST(i AS INTEGER) + 1, 2) = 'th') AS starts FROM benchmark""")
def match_positions(spark, sf_dir):
    starts = search.match_positions(F.col("text"), F.lit("th"))
    return corpus.table(spark, sf_dir, "benchmark").select("item_id", F.transform(starts, lambda i: i.cast("long")).alias("starts"))
