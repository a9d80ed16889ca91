"""Styles, modes, counts and quality summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formatting as S
from ..functions import text as X
from ..operators import groups
from ..registry import query
from ..sources import corpus
from .sql import PARAGRAPHS

_NODES = f"""nodes AS (SELECT doc_id, para_idx, text, '_bk_' || left(sha1(doc_id || ':' || para_idx), 12) AS para_id,
  CAST(length(text) % 4 - 1 AS INTEGER) AS list_level, length(text) % 2 AS left_indent, 0 AS first_indent,
  CASE WHEN length(text) < 40 THEN 'Heading 1' WHEN source = 'src0' THEN 'Quote' ELSE 'Normal' END AS style, upper(lang) AS align,
  CASE length(text) % 5 WHEN 0 THEN 'LETTER' WHEN 1 THEN 'ROMAN' END AS label_type FROM {PARAGRAPHS})"""


def nodes(spark, sf_dir):
    """Paragraphs with a formatting fingerprint derived from their length, language and source."""
    n = F.length("text")
    rows = corpus.paragraphs(spark, sf_dir)
    return rows.select(
        "doc_id", "para_idx", "text", X.short_id(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("para_idx").cast("string"))).alias("para_id"),
        (n % 4 - 1).cast("int").alias("list_level"), (n % 2).alias("left_indent"), F.lit(0).alias("first_indent"),
        F.when(n < 40, "Heading 1").when(F.col("source") == "src0", "Quote").otherwise("Normal").alias("style"), F.upper("lang").alias("align"),
        F.when(n % 5 == 0, "LETTER").when(n % 5 == 1, "ROMAN").alias("label_type"),
    )


@query("style_catalogue", f"""
WITH {_NODES},
ranked AS (SELECT *, row_number() OVER (w ORDER BY para_idx) - 1 AS k, count(*) OVER w AS n FROM nodes WINDOW w AS (PARTITION BY doc_id, list_level, left_indent, style, align)),
g AS (SELECT doc_id, list_level, left_indent, style, align, count(*) AS count, min(para_idx) AS first_idx, max(para_id) FILTER (k = n // 2) AS example_id,
  max(left(text, 80)) FILTER (k = n // 2) AS example_text, arg_min(label_type, para_idx) FILTER (label_type IS NOT NULL) AS label_type FROM ranked GROUP BY ALL),
b AS (SELECT *, CASE WHEN list_level = 0 THEN CASE label_type WHEN 'ROMAN' THEN 'roman_section' ELSE 'top_level' END
  WHEN list_level = 1 THEN CASE label_type WHEN 'LETTER' THEN 'subsection' WHEN 'ROMAN' THEN 'subsection_roman' ELSE 'level_1' END
  WHEN list_level > 1 THEN 'level_' || list_level || CASE label_type WHEN 'ROMAN' THEN '_roman' WHEN 'LETTER' THEN '_letter' ELSE '' END
  WHEN left_indent > 0 THEN 'indent_block' WHEN style = 'Heading 1' THEN 'heading' WHEN style = 'Quote' THEN 'block_quote' ELSE 'body' END AS base FROM g)
SELECT doc_id, list_level, style, align, count, example_id, example_text,
  base || CASE WHEN row_number() OVER w > 1 THEN '_' || (row_number() OVER w - 1) ELSE '' END AS style_id FROM b WINDOW w AS (PARTITION BY doc_id, base ORDER BY first_idx)""")
def style_catalogue(spark, sf_dir):
    return groups.style_catalogue(nodes(spark, sf_dir)).select("doc_id", "list_level", "style", "align", "count", "example_id", "example_text", "style_id")


@query("style_tokens", f"""
WITH {_NODES} SELECT doc_id, para_idx, style || ':L' || list_level || ':' || align || ':I' || left_indent || ':H' || first_indent AS token FROM nodes""")
def style_tokens(spark, sf_dir):
    token = S.style_token(F.col("style"), F.col("list_level").cast("string"), F.col("align"), F.col("left_indent"), F.col("first_indent"))
    return nodes(spark, sf_dir).select("doc_id", "para_idx", token.alias("token"))


@query("fingerprint_lookup", f"""
WITH {_NODES}, g AS (SELECT doc_id, style, align, min(para_idx) AS first_idx FROM nodes GROUP BY ALL)
SELECT n.doc_id, n.para_idx, g.first_idx FROM nodes n JOIN g USING (doc_id, style, align)""")
def fingerprint_lookup(spark, sf_dir):
    rows = nodes(spark, sf_dir).select("doc_id", "para_idx", "style", "align")
    return rows.join(rows.groupBy("doc_id", "style", "align").agg(F.min("para_idx").alias("first_idx")), ["doc_id", "style", "align"]).select("doc_id", "para_idx", "first_idx")


_RUNS = r"""runs AS (SELECT page_id, i AS run_idx, starts_with(part, '<b>') AS bold, regexp_replace(part, '^<[^>]*>', '') AS text FROM
  (SELECT page_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS part FROM
   (SELECT page_id, list_transform(list_filter(string_split('x' || html, '<'), lambda p: TRUE), lambda p, i: CASE WHEN i = 1 THEN substr(p, 2) ELSE '<' || p END) AS parts FROM pages))
  WHERE regexp_replace(part, '^<[^>]*>', '') <> '')"""


@query("modal_format", f"""
WITH {_RUNS}, s AS (SELECT page_id, bold, sum(length(text)) AS chars, min(run_idx) AS first FROM runs GROUP BY ALL)
SELECT page_id, arg_max(bold, chars * 1000000 - first) AS bold, CAST(max(chars) AS BIGINT) AS chars, max(chars) / sum(chars) >= 0.6 AS suppressed FROM s GROUP BY page_id""")
def modal_format(spark, sf_dir):
    runs = corpus.tagged_runs(spark, sf_dir).withColumns({"italic": F.lit(False), "underline": F.lit(False)})
    return groups.modal_flags(runs, ["page_id"]).select("page_id", "bold", "chars", "suppressed")


@query("font_baseline", """
WITH r AS (SELECT conv_id, CAST(turn AS INTEGER) AS run_idx, text, role AS color, CASE WHEN turn % 2 = 0 THEN 'Serif' ELSE '' END AS font, CAST(length(text) % 3 + 10 AS INTEGER) AS size FROM conversations),
m AS (SELECT conv_id, 'c' AS k, color AS v, sum(length(text)) AS n, min(run_idx) AS f FROM r GROUP BY ALL UNION ALL SELECT conv_id, 'f', font, sum(length(text)), min(run_idx) FROM r GROUP BY ALL
  UNION ALL SELECT conv_id, 's', CAST(size AS VARCHAR), sum(length(text)), min(run_idx) FROM r GROUP BY ALL),
t AS (SELECT conv_id, k, arg_max(v, n * 1000000 - f) AS v FROM m GROUP BY ALL)
SELECT conv_id, max(v) FILTER (k = 'c') AS color, nullif(max(v) FILTER (k = 'f'), '') AS font, CAST(max(v) FILTER (k = 's') AS INTEGER) AS size FROM t GROUP BY conv_id""")
def font_baseline(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("run_idx"), "text", F.col("role").alias("color"), F.when(F.col("turn") % 2 == 0, "Serif").otherwise("").alias("font"), (F.length("text") % 3 + 10).cast("int").alias("size"))
    return groups.font_baseline(rows, ["conv_id"])


@query("marker_counts", """
WITH t AS (SELECT conv_id AS doc_id, CASE role WHEN 'user' THEN 'ins' WHEN 'assistant' THEN 'del' ELSE 'rPrChange' END AS tag FROM conversations)
SELECT doc_id, count(*) FILTER (tag = 'ins') AS ins, count(*) FILTER (tag = 'del') AS del, count(*) FILTER (tag <> 'rPrChange') AS content_changes,
  count(*) FILTER (tag = 'rPrChange') AS property_changes, count(*) AS total, TRUE AS has_changes FROM t GROUP BY doc_id""")
def marker_counts(spark, sf_dir):
    tags = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "ins").when(F.col("role") == "assistant", "del").otherwise("rPrChange").alias("tag"))
    return groups.marker_counts(tags).select("doc_id", "ins", "del", "content_changes", "property_changes", "total", "has_changes")


def _statuses(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", (F.col("turn") / 3).cast("int").alias("para_idx"), F.when(F.col("role") == "user", "Inserted").when(F.col("role") == "assistant", "Deleted").otherwise("FormatChanged").alias("status"))


@query("change_stats", """
SELECT conv_id, count(*) FILTER (role = 'user') AS insertions, count(*) FILTER (role = 'assistant') AS deletions, CAST(0 AS BIGINT) AS moves,
  count(*) FILTER (role = 'system') AS format_changes, CAST(0 AS BIGINT) AS equal, count(DISTINCT turn // 3) AS paragraphs FROM conversations GROUP BY conv_id""")
def change_stats(spark, sf_dir):
    return groups.change_stats(_statuses(spark, sf_dir), ["conv_id"])


@query("modified_paragraphs", """
WITH p AS (SELECT conv_id, turn // 3 AS p, bool_or(role = 'user') AND bool_or(role = 'assistant') OR bool_or(role = 'system') AS m FROM conversations GROUP BY ALL)
SELECT conv_id, count(*) FILTER (m) AS modified FROM p GROUP BY conv_id""")
def modified_paragraphs(spark, sf_dir):
    return groups.modified_paragraphs(_statuses(spark, sf_dir), ["conv_id"])


@query("conformance_status", """
WITH r AS (SELECT doc_id % 50 AS fixture, CASE WHEN toxic = 1 THEN 'FAIL' WHEN quality = 1 THEN 'PASS' ELSE 'NOT_COVERED' END AS status FROM labels)
SELECT fixture, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_and(status = 'NOT_COVERED') THEN 'NOT_COVERED' ELSE 'PASS' END AS overall,
  count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'NOT_COVERED') AS not_covered FROM r GROUP BY fixture""")
def conformance_status(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("fixture"), F.when(F.col("toxic") == 1, "FAIL").when(F.col("quality") == 1, "PASS").otherwise("NOT_COVERED").alias("status"))
    return groups.worst_status(rows, ["fixture"])


@query("gate_summary", """
WITH g AS (SELECT doc_id % 40 AS fixture, 'gate' || doc_id % 3 AS gate, doc_id % 3 < 2 AS hard, toxic = 0 AS passed FROM labels)
SELECT fixture, bool_and(passed OR NOT hard) AS passed, list_sort(coalesce(list(DISTINCT gate) FILTER (NOT passed), [])) AS failed FROM g GROUP BY fixture""")
def gate_summary(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("fixture"), F.concat(F.lit("gate"), (F.col("doc_id") % 3).cast("string")).alias("gate"), (F.col("doc_id") % 3 < 2).alias("hard"), (F.col("toxic") == 0).alias("passed"))
    return groups.gates(rows, ["fixture"])


@query("diff_minimality", """
SELECT conv_id, round((count(*) FILTER (role = 'user') + count(*) FILTER (role = 'assistant')) / nullif(count(*) FILTER (role = 'assistant') * 2, 0), 6) AS minimality FROM conversations GROUP BY conv_id""")
def diff_minimality(spark, sf_dir):
    rows = groups.change_stats(_statuses(spark, sf_dir), ["conv_id"]).withColumns({"best_insertions": F.col("deletions"), "best_deletions": F.col("deletions")})
    return groups.minimality(rows).select("conv_id", F.round("minimality", 6).alias("minimality"))


@query("coverage_matrix", """
SELECT o_orderpriority AS package, CAST(sum(o_custkey) AS BIGINT) AS covered, CAST(sum(o_orderkey + o_custkey) AS BIGINT) AS total, round(sum(o_custkey) / sum(o_orderkey + o_custkey) * 100, 1) AS percent FROM orders GROUP BY 1""")
def coverage_matrix(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("package"), F.col("o_custkey").alias("covered"), (F.col("o_orderkey") + F.col("o_custkey")).alias("total"))
    return groups.coverage(rows, ["package"]).drop("mean_percent")


@query("most_uncovered", """
SELECT CAST(doc_id AS VARCHAR) AS file, n_chars AS total, CAST(doc_id AS BIGINT) AS covered, n_chars - doc_id AS uncovered FROM documents ORDER BY uncovered DESC, file LIMIT 20""")
def most_uncovered(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("n_chars").alias("total"), F.col("doc_id").alias("covered"))
    return groups.most_uncovered(rows, 20)


@query("coverage_ratchet", """
WITH r AS (SELECT o_orderpriority AS name, round(count(*) FILTER (o_orderstatus = 'F') * 100 / count(*), 2) AS percent, round(count(*) FILTER (o_orderstatus = 'O') * 100 / count(*), 2) AS baseline FROM orders GROUP BY 1)
SELECT * FROM r WHERE round(percent - baseline, 6) < -0.1""")
def coverage_ratchet(spark, sf_dir):
    share = lambda s: F.round(F.count_if(F.col("o_orderstatus") == s) * 100 / F.count("*"), 2)
    orders = corpus.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"))
    return groups.ratchet(orders.agg(share("F").alias("percent")), orders.agg(share("O").alias("percent")))


@query("story_metrics", """
WITH r AS (SELECT source AS story, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'passed' END AS status, l.doc_id AS stop FROM labels l JOIN documents d USING (doc_id))
SELECT count(DISTINCT story) AS stories, count(*) AS results, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS skipped,
  count(*) FILTER (status IS NULL) AS unknown, max(stop) AS last_stop, round(count(DISTINCT story) FILTER (status = 'passed') / count(DISTINCT story) * 100, 1) AS percent_covered FROM r""")
def story_metrics(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "labels").join(corpus.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return groups.stories(rows.select(F.col("source").alias("story"), F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "passed").alias("status"), F.col("doc_id").alias("stop")))
