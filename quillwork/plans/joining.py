"""Threads, notes, references, tables and styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as R
from ..registry import query
from ..sources import corpus
from .sql import PARAGRAPHS


@query("comment_threads", """
SELECT conv_id AS doc_id, turn AS comment_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_id, CAST(0 AS BIGINT) AS root_id, CAST(turn AS BIGINT) AS depth FROM conversations""")
def comment_threads(spark, sf_dir):
    rows = R.threads(corpus.comments(spark, sf_dir).select("doc_id", "comment_id", "parent_id"))
    return rows.withColumn("depth", F.col("depth").cast("long"))


@query("comment_replies", """
SELECT a.conv_id AS doc_id, a.turn AS comment_id, coalesce(list(b.turn ORDER BY b.turn) FILTER (b.turn IS NOT NULL), []) AS replies
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY a.conv_id, a.turn""")
def comment_replies(spark, sf_dir):
    return R.replies(corpus.comments(spark, sf_dir)).select("doc_id", "comment_id", "replies")


@query("cascade_delete", "SELECT conv_id AS doc_id, turn AS comment_id FROM conversations WHERE turn < conv_id % 4 + 1")
def cascade_delete(spark, sf_dir):
    rows = corpus.comments(spark, sf_dir)
    doomed = rows.where("comment_id = doc_id % 4 + 1").select("doc_id", "comment_id")
    return R.delete_comments(rows, doomed).select("doc_id", "comment_id")


@query("add_comments", """
WITH n AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id AS doc_id, turn AS comment_id, left(upper(trim(role)), 1) AS initials FROM conversations
UNION ALL SELECT conv_id, last + 1, 'R' FROM n UNION ALL SELECT conv_id, last + 2, 'R' FROM n""")
def add_comments(spark, sf_dir):
    rows = corpus.comments(spark, sf_dir)
    new = rows.where("comment_id = 0").select("doc_id", F.lit(0).cast("long").alias("parent_id"), F.lit("reviewer").alias("author"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("text"))
    return R.add_comments(rows, new).select("doc_id", "comment_id", R.initials(F.col("author")).alias("initials"))


@query("comments_by_paragraph", """
SELECT d.doc_id, list({'comment_id': c.turn, 'author': c.role} ORDER BY c.turn)[1].author AS first_author, count(c.turn) AS n
FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id""")
def comments_by_paragraph(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", F.lit("p0").alias("para_id"))
    out = R.attach(docs, corpus.comments(spark, sf_dir).withColumn("para_id", F.lit("p0")))
    return out.select("doc_id", F.get("comments", F.lit(0))["author"].alias("first_author"), F.coalesce(F.size("comments"), F.lit(0)).cast("long").alias("n"))


@query("footnote_display_numbers", """
WITH notes AS (SELECT DISTINCT conv_id AS doc_id, length(text) % 7 AS note_id, CASE WHEN length(text) % 7 = 0 THEN 'separator' END AS type FROM conversations),
refs AS (SELECT conv_id AS doc_id, length(text) % 6 AS note_id, min(turn) AS first_ref FROM conversations GROUP BY ALL)
SELECT n.doc_id, CAST(n.note_id AS BIGINT) AS note_id, r.first_ref, CAST(CASE WHEN r.first_ref IS NOT NULL THEN row_number() OVER (PARTITION BY n.doc_id ORDER BY r.first_ref NULLS LAST) END AS BIGINT) AS display_number
FROM notes n LEFT JOIN refs r USING (doc_id, note_id) WHERE n.type IS NULL""")
def footnote_display_numbers(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    n = F.length("text").cast("long")
    notes = turns.select(F.col("conv_id").alias("doc_id"), (n % 7).alias("note_id"), F.when(n % 7 == 0, "separator").alias("type")).distinct()
    refs = turns.select(F.col("conv_id").alias("doc_id"), (n % 6).alias("note_id"), F.col("turn").alias("ref_idx"), F.col("turn").alias("para_idx"))
    return R.notes_shown(notes, refs).select("doc_id", "note_id", "first_ref", F.col("display_number").cast("long").alias("display_number"))


@query("duplicate_ids", "SELECT role, length(text) AS n_chars, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("n_chars"))
    return R.duplicates(rows, ["role", "n_chars"])


@query("missing_refs", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_refs(spark, sf_dir):
    return R.missing(corpus.table(spark, sf_dir, "documents"), corpus.table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("unmatched_pairs", """
(SELECT conv_id, 'start' AS side FROM conversations WHERE role = 'system' EXCEPT SELECT conv_id, 'start' FROM conversations WHERE turn >= 6)
UNION ALL (SELECT conv_id, 'end' FROM conversations WHERE turn >= 6 EXCEPT SELECT conv_id, 'end' FROM conversations WHERE role = 'system')""")
def unmatched_pairs(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    return R.unmatched(turns.where("role = 'system'"), turns.where("turn >= 6"), ["conv_id"])


@query("unresolved_links", r"""
WITH l AS (SELECT DISTINCT page_id AS doc_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS name FROM pages)
SELECT l.doc_id, l.name FROM l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = l.doc_id AND p.url = l.name)""")
def unresolved_links(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    return R.unresolved(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("name")), r'<a href="([^"]*)"')


@query("hyperlinks", r"""
SELECT page_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS link_idx, unnest(t) AS target FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS t FROM pages) WHERE len(t) > 0""")
def hyperlinks(spark, sf_dir):
    return corpus.links(spark, sf_dir)


@query("part_diff", """
WITH l AS (SELECT source AS doc_id, 'p' || doc_id AS part_uri, sha256(text) AS sha, strlen(text) AS size FROM documents),
r AS (SELECT source AS doc_id, 'p' || d.doc_id AS part_uri, sha256(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS sha, strlen(text) AS size FROM documents d JOIN labels USING (doc_id)
  UNION ALL SELECT role, 'p' || conv_id || '-' || turn, sha256(text), strlen(text) FROM conversations)
SELECT doc_id, part_uri, CASE WHEN r.sha IS NULL THEN 'only_in_left' WHEN l.sha IS NULL THEN 'only_in_right' WHEN l.sha = r.sha AND l.size = r.size THEN 'same' ELSE 'different' END AS status FROM l FULL JOIN r USING (doc_id, part_uri)""")
def part_diff(spark, sf_dir):
    """Documents by source on the left; on the right the labelled ones, changed where toxic, and turns."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.octet_length("text").alias("size"))
    uri = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("part_uri")
    left = docs.select(F.col("source").alias("doc_id"), uri, F.sha2("text", 256).alias("sha"), "size")
    marked = docs.join(corpus.table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("doc_id"), uri, F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"), "size")
    turns = corpus.table(spark, sf_dir, "conversations").select(F.col("role").alias("doc_id"), F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("part_uri"), F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    return R.part_diff(left, marked.unionByName(turns)).select("doc_id", "part_uri", "status")


@query("copy_missing", """
WITH own AS (SELECT doc_id AS num_id, 'own' AS origin FROM documents WHERE lang = 'en'), other AS (SELECT doc_id AS num_id, 'other' AS origin FROM documents), used AS (SELECT DISTINCT doc_id AS num_id FROM labels)
SELECT * FROM own UNION ALL SELECT * FROM other WHERE num_id NOT IN (SELECT num_id FROM own) AND num_id IN (SELECT num_id FROM used)""")
def copy_missing(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("num_id"), "lang")
    used = corpus.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("num_id"))
    return R.copy_missing(docs.where("lang = 'en'").select("num_id", F.lit("own").alias("origin")), docs.select("num_id", F.lit("other").alias("origin")), used, ["num_id"])


_PARENT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'body' WHEN '3-MEDIUM' THEN 'tbl' ELSE 'pPr' END"


@query("section_rules", f"""
WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS child_idx, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last_idx, {_PARENT} AS parent, CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderstatus END AS rid FROM orders),
r AS (SELECT DISTINCT o_custkey AS doc_id, o_orderstatus AS rid FROM orders WHERE o_totalprice > 300000),
e AS (SELECT doc_id, 'more than one body section' AS rule FROM s WHERE parent = 'body' GROUP BY doc_id HAVING count(DISTINCT child_idx) > 1
  UNION ALL SELECT doc_id, 'body section is not last' FROM s WHERE parent = 'body' AND child_idx <> last_idx
  UNION ALL SELECT doc_id, 'invalid parent' FROM s WHERE parent NOT IN ('body', 'pPr')
  UNION ALL SELECT doc_id, 'missing id' FROM s WHERE rid = ''
  UNION ALL SELECT doc_id, 'dangling id' FROM s WHERE rid <> '' AND doc_id IN (SELECT doc_id FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND r.rid = s.rid))
SELECT DISTINCT doc_id, rule FROM e""")
def section_rules(spark, sf_dir):
    orders = corpus.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("child_idx"), F.expr(_PARENT).alias("parent"), F.col("o_orderstatus").alias("rid"), "o_totalprice")
    last = orders.groupBy("doc_id").agg(F.max("child_idx").alias("last_idx"))
    sections = orders.join(last, "doc_id").withColumn("rid", F.when(F.col("rid") == "P", "").otherwise(F.col("rid")))
    return R.section_errors(sections, orders.where("o_totalprice > 300000").select("doc_id", "rid").distinct())


@query("wrapper_warnings", """
WITH w AS (SELECT conv_id AS doc_id, turn AS wrapper_idx, CASE WHEN turn = 1 THEN '' ELSE 'a' END AS author, length(text) % 5 AS children FROM conversations)
SELECT doc_id, wrapper_idx, 'missing author' AS warning FROM w WHERE author = '' UNION ALL SELECT doc_id, wrapper_idx, 'empty' FROM w WHERE children = 0""")
def wrapper_warnings(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("wrapper_idx"), F.lit("1").alias("id"), F.when(F.col("turn") == 1, "").otherwise("a").alias("author"), F.lit("2020").alias("date"), (F.length("text") % 5).alias("children"))
    return R.wrapper_errors(rows)


#: Parts as styles: a hundred a document, each based on the one before it; those over the sixtieth lead into a cycle of six.
_STYLE_SQL = """s AS (SELECT p_partkey // 100 AS doc_id, 's' || p_partkey AS style_id, CASE p_partkey % 100 WHEN 0 THEN NULL WHEN 60 THEN 's' || (p_partkey + 5) ELSE 's' || (p_partkey - 1) END AS based_on,
  CASE p_size % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'center' END AS align, CASE WHEN p_size % 3 = 0 THEN p_size END AS size,
  CASE p_size % 7 WHEN 0 THEN 'superscript' WHEN 1 THEN 'baseline' END AS vert_align, CASE WHEN p_size % 5 = 0 THEN p_size - 20 END AS position,
  CASE WHEN p_size % 6 = 0 THEN 'direct' END AS run_align, CASE WHEN p_size % 2 = 0 THEN p_size - 10 END AS run_position FROM part)"""
_CHAIN_SQL = f"""
WITH RECURSIVE {_STYLE_SQL}, chain AS (
  SELECT doc_id, style_id, style_id AS ancestor, based_on AS nxt, 0 AS depth, [style_id] AS seen FROM s
  UNION ALL SELECT c.doc_id, c.style_id, s.style_id, s.based_on, c.depth + 1, list_append(c.seen, s.style_id) FROM chain c JOIN s ON s.doc_id = c.doc_id AND s.style_id = c.nxt WHERE NOT list_contains(c.seen, s.style_id)),
up AS (SELECT c.style_id, c.depth, a.align, a.size, a.vert_align, a.position FROM chain c JOIN s a ON a.doc_id = c.doc_id AND a.style_id = c.ancestor)"""


def styles(spark, sf_dir):
    """Parts as style definitions, with direct formatting of one run each."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name = lambda k: F.concat(F.lit("s"), k.cast("string"))
    return corpus.table(spark, sf_dir, "part").select(
        F.floor(key / 100).alias("doc_id"), name(key).alias("style_id"), F.when(key % 100 == 0, None).when(key % 100 == 60, name(key + 5)).otherwise(name(key - 1)).alias("based_on"),
        F.when(size % 4 == 0, "left").when(size % 4 == 1, "center").alias("align"), F.when(size % 3 == 0, size).alias("size"),
        F.when(size % 7 == 0, "superscript").when(size % 7 == 1, "baseline").alias("vert_align"), F.when(size % 5 == 0, size - 20).alias("position"),
        F.when(size % 6 == 0, "direct").alias("run_align"), F.when(size % 2 == 0, size - 10).alias("run_position"),
    )


@query("style_chain", _CHAIN_SQL + " SELECT style_id, CAST(depth AS INTEGER) AS depth, ancestor FROM chain")
def style_chain(spark, sf_dir):
    return R.style_chains(styles(spark, sf_dir)).select("style_id", "depth", "ancestor")


@query("style_inherited", _CHAIN_SQL + " SELECT style_id, arg_min(align, depth) FILTER (align IS NOT NULL) AS align, arg_min(size, depth) FILTER (size IS NOT NULL) AS size FROM up GROUP BY style_id")
def style_inherited(spark, sf_dir):
    return R.inherited(styles(spark, sf_dir), ["align", "size"]).select("style_id", "align", "size")


@query("effective_formatting", _CHAIN_SQL + """, f AS (SELECT style_id, arg_min(struct_pack(a := align, z := size), depth) AS o FROM up WHERE align IS NOT NULL OR size IS NOT NULL GROUP BY style_id)
SELECT f.style_id, coalesce(s.run_align, f.o.a) AS align, f.o.z AS size FROM f JOIN s USING (style_id)""")
def effective_formatting(spark, sf_dir):
    rows = styles(spark, sf_dir)
    first = R.first_run_style(rows, ["align", "size"]).select("style_id", F.struct("align", "size").alias("style"))
    runs = rows.select("style_id", F.struct(F.col("run_align").alias("align"), F.lit(None).cast("int").alias("size")).alias("run"))
    return runs.join(first, "style_id").select("style_id", *R.effective(["align", "size"], "run", "style"))


@query("double_elevation", _CHAIN_SQL + """, n AS (SELECT style_id, arg_min(vert_align, depth) FILTER (vert_align IS NOT NULL) AS v, arg_min(position, depth) FILTER (position IS NOT NULL) AS p FROM up GROUP BY style_id)
SELECT style_id, CASE WHEN n.v = 'superscript' AND coalesce(s.run_position, n.p, 0) > 0 THEN 0 ELSE s.run_position END AS position FROM s JOIN n USING (style_id)""")
def double_elevation(spark, sf_dir):
    rows = styles(spark, sf_dir)
    runs = rows.select("doc_id", "style_id", F.lit(None).cast("string").alias("vert_align"), F.col("run_position").alias("position"))
    return R.raised(rows, runs).select("style_id", "position")


#: Three paragraphs of a document are a table, its sentences are the cells; some are merged.
_CELLS = f"""c AS (SELECT doc_id, para_idx // 3 AS table_idx, para_idx % 3 AS row_idx, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS cell_idx, unnest(p) AS text FROM (SELECT doc_id, para_idx, string_split(text, '. ') AS p FROM {PARAGRAPHS})),
k AS (SELECT *, CASE length(text) % 23 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS grid_span, CASE WHEN length(text) % 41 = 3 THEN 'restart' END AS v_merge FROM c)"""


def cells(spark, sf_dir):
    parts = corpus.paragraphs(spark, sf_dir).select("doc_id", F.floor(F.col("para_idx") / 3).cast("int").alias("table_idx"), (F.col("para_idx") % 3).alias("row_idx"), F.posexplode(F.split("text", r"\. ")).alias("cell_idx", "text"))
    n = F.length("text")
    return parts.withColumns({"grid_span": F.when(n % 23 == 0, 2).when(n % 23 == 1, 0), "h_merge": F.lit(None).cast("string"), "v_merge": F.when(n % 41 == 3, "restart")})


_TABLES = f"""WITH {_CELLS},
t AS (SELECT doc_id, table_idx, bool_or(v_merge IS NOT NULL OR coalesce(grid_span, 1) > 1) AS merged, count(*) FILTER (row_idx = 0) > count(DISTINCT trim(text)) FILTER (row_idx = 0) AS twice FROM k GROUP BY doc_id, table_idx)"""


@query("table_extract", _TABLES + """,
h AS (SELECT doc_id, table_idx, cell_idx, trim(text) AS header FROM k WHERE row_idx = 0),
r AS (SELECT doc_id, table_idx, row_idx, count(*) AS cells FROM k WHERE row_idx > 0 GROUP BY ALL)
SELECT r.doc_id, r.table_idx, r.row_idx, h.header, coalesce(trim(k.text), '') AS text, CAST(r.cells AS INTEGER) AS cells FROM r JOIN t USING (doc_id, table_idx) JOIN h USING (doc_id, table_idx)
LEFT JOIN k ON k.doc_id = r.doc_id AND k.table_idx = r.table_idx AND k.row_idx = r.row_idx AND k.cell_idx = h.cell_idx WHERE NOT merged AND NOT twice""")
def table_extract(spark, sf_dir):
    rows, _ = R.extract_tables(cells(spark, sf_dir))
    return rows.select("doc_id", "table_idx", "row_idx", F.size("texts").alias("cells"), F.explode("row").alias("header", "text"))


@query("table_diagnostics", _TABLES + " SELECT doc_id, table_idx, CASE WHEN merged THEN 'merged cells' ELSE 'duplicate headers' END AS why FROM t WHERE merged OR twice")
def table_diagnostics(spark, sf_dir):
    return R.extract_tables(cells(spark, sf_dir))[1]


@query("table_metadata", f"""WITH {_CELLS}, r AS (SELECT doc_id, table_idx, row_idx, sum(greatest(coalesce(grid_span, 1), 1)) AS cols FROM k GROUP BY ALL),
h AS (SELECT doc_id, table_idx, string_agg(text, '|' ORDER BY cell_idx, i) AS headers FROM k, unnest(range(greatest(coalesce(grid_span, 1), 1))) AS u(i) WHERE row_idx = 0 GROUP BY ALL)
SELECT doc_id, table_idx, count(*) AS n_rows, CAST(max(cols) AS BIGINT) AS n_cols, any_value(sha1(headers)) AS headers FROM r JOIN h USING (doc_id, table_idx) GROUP BY doc_id, table_idx""")
def table_metadata(spark, sf_dir):
    return R.table_metadata(cells(spark, sf_dir)).withColumn("headers", F.sha1(F.array_join("headers", "|")))


@query("cell_columns", f"""WITH {_CELLS}
SELECT doc_id, table_idx, row_idx, cell_idx, CAST(coalesce(sum(greatest(coalesce(grid_span, 1), 1)) OVER (PARTITION BY doc_id, table_idx, row_idx ORDER BY cell_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grid_col FROM k""")
def cell_columns(spark, sf_dir):
    return R.cell_columns(cells(spark, sf_dir)).select("doc_id", "table_idx", "row_idx", "cell_idx", "grid_col")


@query("rendered_view", """
WITH n AS (SELECT conv_id AS doc_id, turn AS para_idx, 'p' || turn AS para_id, role AS style, text, CASE WHEN turn BETWEEN 1 AND 2 THEN 0 WHEN turn = 3 THEN 1 END AS t FROM conversations),
m AS (SELECT *, t IS NOT NULL AND lag(t) OVER w IS DISTINCT FROM t AS o, t IS NOT NULL AND lead(t) OVER w IS DISTINCT FROM t AS c FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx))
SELECT doc_id, '#SCHEMA id | list_label | header | style | text' || chr(10) || string_agg(CASE WHEN o THEN '#TABLE ' || t || chr(10) ELSE '' END || para_id || ' |  |  | ' || style || ' | ' || text || CASE WHEN c THEN chr(10) || '#END_TABLE' ELSE '' END, chr(10) ORDER BY para_idx) AS rendered FROM m GROUP BY doc_id""")
def rendered_view(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_idx"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("para_id"), F.col("role").alias("style"), "text", F.lit(None).cast("string").alias("list_label"), F.lit(None).cast("string").alias("header"), F.when(F.col("turn").between(1, 2), 0).when(F.col("turn") == 3, 1).alias("table_idx"))
    return R.rendered(rows)


@query("rendered_simple", """
SELECT conv_id AS doc_id, string_agg('p' || turn || ' | ' || CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def rendered_simple(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_idx"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("para_id"), "text")
    return R.rendered_simple(rows)


@query("rendered_json", "SELECT conv_id AS doc_id, count(*) AS n, min(turn) AS first FROM conversations GROUP BY conv_id")
def rendered_json(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_idx"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("para_id"), "text")
    back = F.from_json("rendered", "array<struct<para_idx:bigint,para_id:string,text:string>>")
    return R.rendered_json(rows).select("doc_id", F.size(back).cast("long").alias("n"), F.get(back, F.lit(0))["para_idx"].alias("first"))
