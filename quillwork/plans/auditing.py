"""Whole-document checks, nested elements, archive parts and paragraph operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alignment as G
from ..operators import audit as U
from ..operators import chars as C
from ..operators import edits as E
from ..operators import groups
from ..operators import ordered as O
from ..operators import trees as T
from ..registry import query
from ..sources import archives as A
from ..sources import corpus
from . import comparing
from .joining import _STYLE_SQL, styles
from .ordering import FIELDS, fields, list_items, ordinal_sql
from .sql import PARAGRAPHS, normalised


@query("node_filter", f"SELECT p.doc_id, para_idx, sha1(text) AS hash FROM {PARAGRAPHS} p WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id AND l.quality + l.toxic = para_idx)")
def node_filter(spark, sf_dir):
    wanted = corpus.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("para_idx"))
    return U.only_nodes(corpus.paragraphs(spark, sf_dir), wanted, ["doc_id", "para_idx"]).select("doc_id", "para_idx", F.sha1("text").alias("hash"))


def elements(spark, sf_dir):
    """Each customer's orders as a tree: a table, a row a status, a cell an order."""
    orders = corpus.table(spark, sf_dir, "orders").withColumn("doc_id", F.col("o_custkey"))
    code, none = F.ascii("o_orderstatus").cast("long"), F.create_map().cast("map<string,string>")
    row = F.concat(F.lit("s"), F.col("o_orderstatus"))
    cells = orders.select("doc_id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), row.alias("parent"), F.col("o_orderkey").alias("pos"), F.lit("tc").alias("tag"), F.create_map(F.lit("xml:space"), F.lit("x"), F.lit("prio"), F.col("o_orderpriority")).alias("attributes"), F.col("o_orderkey").cast("string").alias("text"))
    rows = orders.select("doc_id", row.alias("node"), F.lit("r").alias("parent"), code.alias("pos"), F.lit("tr").alias("tag"), F.col("o_orderstatus").alias("v")).distinct().select("doc_id", "node", "parent", "pos", "tag", F.create_map(F.lit("val"), F.col("v")).alias("attributes"), F.lit("").alias("text"))
    roots = orders.select("doc_id").distinct().select("doc_id", F.lit("r").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("pos"), F.lit("tbl").alias("tag"), none.alias("attributes"), F.lit("").alias("text"))
    return cells.unionByName(rows).unionByName(roots)


@query("deep_hashes", """
WITH c AS (SELECT o_custkey AS doc_id, o_orderstatus AS s, o_orderkey AS pos, 'o' || o_orderkey AS node, sha1('tc|prio=' || o_orderpriority || '|' || o_orderkey) AS h FROM orders),
r AS (SELECT doc_id, 's' || s AS node, sha1(sha1('tr|val=' || s || '|') || '|' || string_agg(h, ',' ORDER BY pos)) AS h FROM c GROUP BY doc_id, s)
SELECT doc_id, node, h AS deep_hash FROM c UNION ALL SELECT doc_id, node, h FROM r UNION ALL SELECT doc_id, 'r', sha1(sha1('tbl||') || '|' || string_agg(h, ',' ORDER BY node)) FROM r GROUP BY doc_id""")
def deep_hashes(spark, sf_dir):
    return T.deep_hashes(elements(spark, sf_dir)).select("doc_id", "node", "deep_hash")


@query("deepest_first", """
WITH n AS (SELECT o_custkey AS doc_id, 'o' || o_orderkey AS node, 2 AS depth FROM orders UNION SELECT o_custkey, 's' || o_orderstatus, 1 FROM orders UNION SELECT o_custkey, 'r', 0 FROM orders)
SELECT doc_id, node, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY depth DESC, node) AS INTEGER) AS place FROM n""")
def deepest_first(spark, sf_dir):
    return T.deepest_first(elements(spark, sf_dir).select("doc_id", "node", "parent")).select("doc_id", "node", "depth", "place")


@query("nested_comments", """
SELECT conv_id AS doc_id, min(turn) AS root_id, string_agg('{"comment_id":' || turn || ',"author":"' || role || '","replies":[', '' ORDER BY turn) || repeat(']}', CAST(count(*) AS INTEGER)) AS thread FROM conversations GROUP BY conv_id""")
def nested_comments(spark, sf_dir):
    return T.nested_comments(corpus.comments(spark, sf_dir))


_PATH = "CASE l_linenumber WHEN 1 THEN array('p', 'ins', 'r') WHEN 2 THEN array('tbl', 'p', 'del', 'r') WHEN 3 THEN array('p', 'ins', 'del', 'r') WHEN 4 THEN array('tbl', 'p', 'moveTo', 'r') WHEN 5 THEN array('p', 'moveFrom') ELSE array('p', 'r') END"
_STATUS = "CASE l_linenumber WHEN 1 THEN 'Inserted' WHEN 2 THEN 'Deleted' WHEN 3 THEN 'Deleted' WHEN 4 THEN 'MovedDestination' WHEN 5 THEN 'MovedSource' ELSE 'Equal' END"
_TAG = "CASE l_returnflag WHEN 'A' THEN 't' WHEN 'N' THEN 'tab' ELSE 'delText' END"


def _leaves(spark, sf_dir):
    attributes = F.create_map(F.lit("xml:space"), F.lit("preserve"), F.lit("n"), F.col("l_linenumber").cast("string"))
    return corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.expr(_PATH).alias("ancestors"), F.expr(_TAG).alias("tag"), attributes.alias("attributes"), F.col("l_linestatus").alias("text"))


@query("atoms_of_leaves", f"""
SELECT l_orderkey, l_linenumber AS line, {_STATUS} AS status, sha1({_TAG} || '|n=' || l_linenumber || '|' || l_linestatus) AS hash, CASE l_returnflag WHEN 'N' THEN chr(9) ELSE l_linestatus END AS text, l_linenumber IN (2, 4) AS in_table FROM lineitem""")
def atoms_of_leaves(spark, sf_dir):
    return T.atoms_of(_leaves(spark, sf_dir)).select("l_orderkey", "line", "status", "hash", "text", "in_table")


@query("score_extras", "SELECT l_orderkey AS pair_id, bool_or(l_linenumber IN (4, 5)) AS has_moves, bool_or(l_linenumber IN (2, 4)) AS edits_in_cells FROM lineitem GROUP BY 1")
def score_extras(spark, sf_dir):
    return U.score_extras(T.atoms_of(_leaves(spark, sf_dir)).withColumnRenamed("l_orderkey", "pair_id"))


_PAIR = "CASE event_type WHEN 'view' THEN 'del' WHEN 'purchase' THEN 'del' WHEN 'error' THEN 'text' ELSE 'ins' END"
_WHO = "CASE WHEN event_type = 'error' THEN NULL WHEN value > 200 THEN 'b' ELSE 'a' END"


@query("joined_pairs", f"""
WITH e AS (SELECT user_id, event_id, {_PAIR} AS kind, {_WHO} AS author, CASE WHEN event_type <> 'error' THEN left(event_type, 1) WHEN value < 60 THEN ' ' ELSE 'x' END AS text FROM events),
o AS (SELECT *, coalesce(kind = 'del' AND lead(kind) OVER w = 'ins' AND author = lead(author) OVER w, FALSE) AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, coalesce(lag(opens) OVER w, FALSE) AS closes FROM o WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, coalesce(kind = 'text' AND text = ' ' AND lag(closes) OVER w AND lead(opens) OVER w AND lag(author) OVER w = lead(author) OVER w, FALSE) AS blank, lag(closes) OVER w AS pc, lag(author) OVER w AS pa FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, CASE WHEN closes OR blank OR (opens AND (coalesce(lag(blank) OVER w, FALSE) OR coalesce(pc AND pa = author, FALSE))) THEN 0 ELSE 1 END AS step FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM g),
m AS (SELECT *, (opens OR closes OR blank) AND sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k) > 1 AS chained FROM n),
d AS (SELECT *, unnest(CASE kind WHEN 'text' THEN ['del', 'ins'] ELSE [kind] END) AS side FROM m WHERE chained)
SELECT user_id AS doc_id, event_id AS turn, kind, author, text FROM m WHERE NOT chained
UNION ALL SELECT user_id, min(event_id), side, max(author), string_agg(text, '' ORDER BY event_id) FROM d GROUP BY user_id, k, side""")
def joined_pairs(spark, sf_dir):
    text = "CASE WHEN event_type <> 'error' THEN left(event_type, 1) WHEN value < 60 THEN ' ' ELSE 'x' END"
    rows = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("turn"), F.expr(_PAIR).alias("kind"), F.expr(_WHO).alias("author"), F.when(F.expr(_WHO).isNotNull(), "d").alias("date"), F.expr(text).alias("text"))
    return T.joined_pairs(rows, ["doc_id"], "turn").select("doc_id", "turn", "kind", "author", "text")


_WARNINGS = f"""WITH {FIELDS},
st AS (SELECT DISTINCT user_id AS doc_id, 'b' || CAST(floor(value) AS INTEGER) AS name FROM events WHERE event_type = 'view'), en AS (SELECT DISTINCT user_id AS doc_id, 'b' || CAST(floor(value) AS INTEGER) AS name FROM events WHERE event_type = 'click'),
fe AS (SELECT doc_id, count(*) FILTER (excess) AS n, arg_max(depth, turn) AS o FROM d GROUP BY doc_id),
wa AS (SELECT doc_id, 'bookmark without end' AS rule, name AS subject FROM (SELECT * FROM st EXCEPT SELECT * FROM en) UNION ALL SELECT doc_id, 'bookmark without start', name FROM (SELECT * FROM en EXCEPT SELECT * FROM st)
  UNION ALL SELECT user_id, 'wrapper missing author', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase' AND value < 5 UNION ALL SELECT user_id, 'wrapper empty', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase' AND CAST(floor(value) AS INTEGER) % 9 = 0
  UNION ALL SELECT doc_id, 'field ends too often', CAST(n AS VARCHAR) FROM fe WHERE n > 0 UNION ALL SELECT doc_id, 'field does not end', CAST(CAST(o AS BIGINT) AS VARCHAR) FROM fe WHERE o > 0)"""


def _warnings(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events").withColumn("doc_id", F.col("user_id"))
    whole = F.floor("value").cast("int")
    names = lambda kind: events.where(F.col("event_type") == kind).select("doc_id", F.concat(F.lit("b"), whole.cast("string")).alias("name")).distinct()
    wrappers = events.where("event_type = 'purchase'").select("doc_id", F.col("event_id").alias("wrapper_idx"), F.lit("1").alias("id"), F.when(F.col("value") >= 5, "a").otherwise("").alias("author"), F.lit("2020").alias("date"), (whole % 9).alias("children"))
    return U.validated(names("view"), names("click"), wrappers, fields(spark, sf_dir).withColumnRenamed("turn", "mark_idx"))


@query("validated_documents", _WARNINGS + " SELECT doc_id, rule, subject FROM wa")
def validated_documents(spark, sf_dir):
    return _warnings(spark, sf_dir)


@query("structural_gate", _WARNINGS + """, f AS (SELECT doc_id, list_sort(list(DISTINCT rule)) AS kinds FROM wa WHERE rule <> 'bookmark without end' AND rule <> 'bookmark without start' AND rule <> 'field ends too often' GROUP BY doc_id)
SELECT c.c_custkey AS doc_id, f.kinds IS NULL AS passed, array_to_string(coalesce(f.kinds, []), ',') AS kinds FROM customer c LEFT JOIN f ON f.doc_id = c.c_custkey""")
def structural_gate(spark, sf_dir):
    """Customers as documents, judged by the warnings of the users of their number that are diagnostics of the gate."""
    found = _warnings(spark, sf_dir).where("rule NOT LIKE 'bookmark%' AND rule <> 'field ends too often'").select("doc_id", F.col("rule").alias("kind"))
    docs = corpus.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return U.structural_gate(docs, found).select("doc_id", "passed", F.array_join("kinds", ",").alias("kinds"))


_MISMATCHES = f"""m AS (SELECT doc_id AS pair_id, para_idx, text || '!' AS found, text AS wanted FROM {PARAGRAPHS} WHERE length(text) % 7 = 0
  UNION ALL SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER), 'extra', NULL FROM documents WHERE len(string_split(text, chr(10))) % 2 = 1)"""


def _mismatches(spark, sf_dir):
    lines = F.split("text", "\n")
    changed = F.transform(lines, lambda t: F.when(F.length(t) % 7 == 0, F.concat(t, F.lit("!"))).otherwise(t))
    longer = F.when(F.size(lines) % 2 == 1, F.array_append(changed, F.lit("extra"))).otherwise(changed)
    return U.mismatches(corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.array_join(longer, "\n").alias("found"), F.col("text").alias("wanted")))


@query("text_mismatches", f"WITH {_MISMATCHES} SELECT * FROM m")
def text_mismatches(spark, sf_dir):
    return _mismatches(spark, sf_dir)


@query("mismatch_summaries", f"WITH {_MISMATCHES} SELECT pair_id, count(*) AS paragraphs, min(para_idx) AS first FROM m GROUP BY pair_id")
def mismatch_summaries(spark, sf_dir):
    return U.mismatch_summary(_mismatches(spark, sf_dir))


_PLACES = "CASE c_nationkey % 6 WHEN 0 THEN '/data/' || c_name WHEN 1 THEN '/data/../etc/' || c_name WHEN 2 THEN '/srv/./in//' || c_name WHEN 3 THEN '/data/a/../../../data/x' WHEN 4 THEN 'data/' || c_name ELSE '/database/' || c_name END"


@query("allowed_paths", f"SELECT c_custkey, {_PLACES} AS path, c_nationkey % 6 IN (0, 2) AS allowed FROM customer")
def allowed_paths(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_PLACES).alias("path"))
    return rows.withColumn("allowed", U.allowed_path(F.col("path"), "/data", "/srv/in/"))


@query("word_diff_round_trip", r"""
SELECT a.item_id, a.text AS before_text, b.text AS after_text, TRUE AS whole_words FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def word_diff_round_trip(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "benchmark")
    rows = rows.join(rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after")), "item_id").withColumn("ops", C.word_ops("text", "after"))
    tokens = lambda c: X.word_and_space_tokens(c)
    kept = F.flatten(F.transform(F.filter("ops", lambda o: o["op"] != C.INSERT), lambda o: tokens(o["text"])))
    return rows.select("item_id", C.rebuilt(F.col("ops"), C.DELETE).alias("before_text"), C.rebuilt(F.col("ops"), C.INSERT).alias("after_text"), (F.size(kept) == F.size(tokens(F.col("text")))).alias("whole_words"))


@query("group_similarities", rf"""
WITH p AS (SELECT doc_id, para_idx, CASE WHEN para_idx % 4 = 1 THEN ' ' ELSE text END AS x, coalesce(lead(CASE WHEN para_idx % 4 = 1 THEN ' ' ELSE text END) OVER (PARTITION BY doc_id ORDER BY para_idx), '') AS y FROM {PARAGRAPHS}),
n AS (SELECT doc_id, para_idx, {normalised('x')} AS x, {normalised('y')} AS y FROM p), w AS (SELECT *, list_distinct(string_split(x, ' ')) AS a, list_distinct(string_split(y, ' ')) AS b FROM n)
SELECT doc_id, para_idx, round(CASE WHEN x = '' AND y = '' THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity FROM w""")
def group_similarities(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", F.when(F.col("para_idx") % 4 == 1, " ").otherwise(F.col("text")).alias("x"))
    rows = rows.withColumn("y", F.coalesce(F.lead("x").over(Window.partitionBy("doc_id").orderBy("para_idx")), F.lit("")))
    return rows.select("doc_id", "para_idx", F.round(X.group_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("continued_counters", f"""
WITH i AS (SELECT doc_id, para_idx, length(text) % 3 AS level FROM {PARAGRAPHS}),
a AS (SELECT *, count(*) FILTER (level = 0) OVER w AS n0, count(*) FILTER (level <= 1) OVER w AS g1, first_value(level) OVER w AS f0 FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, n0 + CASE WHEN f0 > 0 THEN 1 ELSE 0 END AS c0,
  1 + count(*) FILTER (level = 1) OVER s + CASE WHEN first_value(CASE WHEN level > 0 THEN level END IGNORE NULLS) OVER s = 2 THEN 1 ELSE 0 END AS c1,
  count(*) FILTER (level = 2) OVER (PARTITION BY doc_id, g1 ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS c2
  FROM a WINDOW s AS (PARTITION BY doc_id, n0 ORDER BY para_idx ROWS UNBOUNDED PRECEDING))
SELECT doc_id, para_idx, CASE WHEN level = 1 AND c0 = 1 THEN c1 || '.' ELSE c0 || '.' || CASE WHEN level > 0 THEN {ordinal_sql('c1')} ELSE '' END || CASE WHEN level > 1 THEN '.(' || c2 || ')' ELSE '' END END AS label FROM b""")
def continued_counters(spark, sf_dir):
    rows = list_items(spark, sf_dir).withColumn("starts", F.array(F.lit(1), F.lit(2), F.lit(1)))
    return O.continued_labels(rows).select("doc_id", "para_idx", "label")


@query("paragraph_operations")
def paragraph_operations(spark, sf_dir):
    return G.compare_paragraphs(comparing.pairs(spark, sf_dir))


@query("paragraph_changes", f"WITH {comparing._PAIRS} SELECT pair_id, sha1(o.text) AS original, sha1(r.text) AS revised, TRUE AS adds_up FROM pairs JOIN documents r ON r.doc_id = pair_id JOIN documents o ON o.doc_id = original_id")
def paragraph_changes(spark, sf_dir):
    """Both texts of each pair put together again from what was done to its paragraphs."""
    rows = G.paragraph_changes(comparing.pairs(spark, sf_dir))
    n = C.change_counts(F.col("ops"))
    fits = (F.col("op") != "modified") | ((n["equal"] + n["deleted"] == F.length("before")) & (n["equal"] + n["inserted"] == F.length("after")))
    text = lambda at, t: F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(at) >= 0, F.struct(at, t)))), lambda x: x[t]), "\n"))
    return rows.groupBy("pair_id").agg(text("orig_para", "before").alias("original"), text("rev_para", "after").alias("revised"), F.bool_and(fits).alias("adds_up"))


@query("compared_documents", f"WITH {comparing._PAIRS} SELECT pair_id, 'aligned' AS mode, CAST(1 AS INTEGER) AS pass FROM pairs")
def compared_documents(spark, sf_dir):
    return G.compare_documents(comparing.pairs(spark, sf_dir), joined=G.STATUSES)[1]


@query("unified_paragraphs")
def unified_paragraphs(spark, sf_dir):
    """The place of each paragraph of a comparison in the merged output."""
    return G.unified_index(G.compare_pairs(comparing.pairs(spark, sf_dir), joined=G.STATUSES)).select("pair_id", "orig_para", "rev_para", "para_idx").distinct()


@query("saved_variants", f"""WITH {comparing._PAIRS} SELECT CAST(pair_id AS VARCHAR) AS doc_id, sha1(text) AS clean, TRUE AS tracked_accepts FROM pairs JOIN documents ON doc_id = pair_id""")
def saved_variants(spark, sf_dir):
    """The clean archive of each comparison read back, and whether the tracked one, accepted, holds the same words."""
    files = A.variants(G.compare_pairs(comparing.pairs(spark, sf_dir), joined=G.STATUSES), "reviewer", "2020-01-01T00:00:00Z")
    clean = A.document_text(A.paragraphs(A.entries(files.where("variant = 'clean'")))).select("doc_id", F.col("text").alias("clean"))
    runs = A.runs(A.entries(files.where("variant = 'tracked'"))).where("coalesce(rev_tag, '') <> 'del'")
    tracked = runs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "run_idx", "text"))), lambda x: x["text"]), "").alias("t"))
    return clean.join(tracked, "doc_id", "left").select("doc_id", F.sha1("clean").alias("clean"), (F.replace("clean", F.lit("\n"), F.lit("")) == F.coalesce("t", F.lit(""))).alias("tracked_accepts"))


@query("cleared_identities", f"SELECT doc_id, para_idx, sha1(text) AS hash FROM {PARAGRAPHS}")
def cleared_identities(spark, sf_dir):
    rows = groups.identities(corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", "text"))
    return E.clear_identities(rows).select("*", F.sha1("text").alias("hash")).drop("text")


@query("parsed_flags", "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN TRUE WHEN '2' THEN o_orderstatus = 'O' WHEN '3' THEN TRUE ELSE FALSE END AS flag FROM orders")
def parsed_flags(spark, sf_dir):
    flag = F.expr("CASE left(o_orderpriority, 1) WHEN '1' THEN ' TRUE ' WHEN '2' THEN lower(o_orderstatus) || CASE o_orderstatus WHEN 'O' THEN 'N' ELSE 'ff' END WHEN '3' THEN 'Yes' WHEN '4' THEN '0' ELSE '' END")
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", E.preserved_case(flag).alias("flag"))


# Parts of archives, written as markup and parsed again.

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _part(rows, uri: str, open_: str, piece, order: str, close: str):
    """One archive a document with one part: the pieces of its rows in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("x")))), lambda p: p["x"]), "")
    parts = rows.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.concat(F.lit(open_), body, F.lit(close)).cast("binary").alias("content"))
    return A.entries(A.packed(parts.withColumn("part_uri", F.lit(uri))))


def _element(name: str, value) -> object:
    """A property element, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f'<w:{name} w:val="'), X.escaped_attribute(value.cast("string")), F.lit('"/>')), F.lit(""))


@query("parsed_styles", f"WITH {_STYLE_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, style_id, 'Style ' || style_id AS name, based_on, align, size FROM s")
def parsed_styles(spark, sf_dir):
    c = F.col
    piece = F.concat(F.lit('<w:style w:styleId="'), c("style_id"), F.lit('">'), _element("name", F.concat(F.lit("Style "), c("style_id"))), _element("basedOn", c("based_on")), F.lit("<w:pPr>"), _element("jc", c("align")), F.lit("</w:pPr><w:rPr>"), _element("sz", c("size")), F.lit("</w:rPr></w:style>"))
    return A.styles(_part(styles(spark, sf_dir), A.PARTS[1], f"<w:styles {_NS}>", piece, "style_id", "</w:styles>")).select("doc_id", "style_id", "name", "based_on", "align", "size")


@query("parsed_numbering", """
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, c_custkey AS num_id, CAST(lv AS INTEGER) AS level, CASE WHEN lv = 0 AND c_acctbal < 0 THEN 9 ELSE CAST(c_custkey % 7 + 1 AS INTEGER) END AS start,
  CASE lv WHEN 0 THEN 'decimal' ELSE 'lowerLetter' END AS format, CASE lv WHEN 0 THEN '%1.' ELSE '%1.%2' END AS template, lv = 1 AND c_mktsegment = 'BUILDING' AS is_legal FROM customer, unnest([0, 1]) AS u(lv)""")
def parsed_numbering(spark, sf_dir):
    c, key = F.col, F.col("c_custkey").cast("string")
    levels = F.array_join(F.transform(F.array(F.lit(0), F.lit(1)), lambda lv: F.concat(F.lit('<w:lvl w:ilvl="'), lv.cast("string"), F.lit('">'), _element("start", c("c_custkey") % 7 + 1), F.when(lv == 0, '<w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/>').otherwise('<w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2"/>'), F.when((lv == 1) & (c("c_mktsegment") == "BUILDING"), "<w:isLgl/>").otherwise(""), F.lit("</w:lvl>"))), "")
    abstract = F.concat(F.lit('<w:abstractNum w:abstractNumId="'), key, F.lit('">'), levels, F.lit("</w:abstractNum>"))
    over = F.when(c("c_acctbal") < 0, '<w:lvlOverride w:ilvl="0"><w:startOverride w:val="9"/></w:lvlOverride>').otherwise("")
    piece = F.concat(abstract, F.lit('<w:num w:numId="'), key, F.lit('">'), _element("abstractNumId", key), over, F.lit("</w:num>"))
    rows = corpus.table(spark, sf_dir, "customer").withColumn("doc_id", c("c_nationkey"))
    return A.number_levels(_part(rows, A.PARTS[2], f"<w:numbering {_NS}>", piece, "c_custkey", "</w:numbering>"))


@query("parsed_relationships", r"""
SELECT CAST(page_id AS VARCHAR) AS doc_id, 'r' || generate_subscripts(t, 1) AS rid, unnest(t) AS target FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS t FROM pages) WHERE len(t) > 0""")
def parsed_relationships(spark, sf_dir):
    rows = corpus.links(spark, sf_dir).withColumn("doc_id", F.col("page_id"))
    piece = F.concat(F.lit('<Relationship Id="r'), (F.col("link_idx") + 1).cast("string"), F.lit('" Type="http://x/hyperlink" Target="'), X.escaped_attribute(F.col("target")), F.lit('"/>'))
    return A.relationships(_part(rows, A.PARTS[4], "<Relationships>", piece, "link_idx", "</Relationships>"))
