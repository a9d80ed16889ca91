"""Document views, revision predicates, tagged text and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import views as V
from ..registry import query
from ..sources import corpus
from .searching import _HEADER, _HEADER_PARTS
from .shaping import LABELLED, LABEL_PARTS
from .sql import PARAGRAPHS, normalised


@query("document_view", f"""
WITH own AS (SELECT doc_id, para_idx, text, {normalised('text')} AS t FROM {PARAGRAPHS}),
seeds AS (SELECT *, t || '|' || coalesce(lag(t) OVER w, '') || '|' || coalesce(lead(t) OVER w, '') AS seed FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx)),
salted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seed ORDER BY para_idx) - 1 AS r FROM seeds),
h AS (SELECT *, {_HEADER_PARTS} FROM salted)
SELECT doc_id, para_idx, '_bk_' || left(sha1(seed || CASE WHEN r > 0 THEN '|salt:' || r ELSE '' END), 12) AS para_id, CAST(NULL AS VARCHAR) AS list_label, CAST(-1 AS INTEGER) AS list_level, {_HEADER} AS header
FROM h WHERE regexp_replace(text, '\\s+', '', 'g') <> ''""")
def document_view(spark, sf_dir):
    none = F.lit(None).cast("int")
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", "text", none.alias("table_idx"), none.alias("row_idx"), none.alias("cell_idx"))
    return V.document_view(rows, rules=X.WHOLE_NUMBER_RULES).select("doc_id", "para_idx", "para_id", "list_label", "list_level", "header")


_VIEWED = f"CASE WHEN para_idx % 5 = 4 THEN '  ' ELSE {LABELLED} END"


@query("labelled_view", rf"""
WITH p AS (SELECT doc_id, para_idx, {_VIEWED} AS text, CASE WHEN para_idx % 7 = 4 THEN 1 END AS table_idx FROM {PARAGRAPHS}),
m AS (SELECT *, {LABEL_PARTS} FROM p WHERE trim(text) <> '' OR table_idx IS NOT NULL),
b AS (SELECT doc_id, para_idx, nullif(regexp_replace(hit, '\s+$', ''), '') AS list_label, CASE WHEN kind IS NULL THEN -1 WHEN kind IN ('SECTION', 'ARTICLE', 'NUMBERED_HEADING') THEN 0 ELSE 1 END AS list_level,
  CASE WHEN hit <> '' THEN regexp_replace(substr(text, length(hit) + 1), '^\s+', '') ELSE text END AS text FROM m),
h AS (SELECT *, {_HEADER_PARTS} FROM b),
v AS (SELECT *, {_HEADER} AS header, CASE WHEN length(trim(text)) <= 50 THEN right(trim(text), 1) IN ('.', ':') ELSE stop IN ('.', ':') END AS stopped FROM h)
SELECT doc_id, para_idx, list_label, CAST(list_level AS INTEGER) AS list_level, header,
  CASE WHEN header IS NULL OR header = '' OR NOT stopped THEN text {' '.join(f"WHEN starts_with(lower(text), lower(trim(header)) || '{x}') THEN regexp_replace(substr(text, length(lower(trim(header)) || '{x}') + 1), '^ +', '')" for x in (':', '.', '-', ';', ''))} ELSE text END AS clean_text FROM v""")
def labelled_view(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", F.expr(_VIEWED).alias("text"), F.when(F.col("para_idx") % 7 == 4, 1).alias("table_idx"))
    return V.document_view(rows.withColumns({"row_idx": F.lit(0), "cell_idx": F.lit(0)})).select("doc_id", "para_idx", "list_label", "list_level", "header", "clean_text")


@query("annotated_runs", """
WITH f AS (SELECT conv_id AS doc_id, turn // 4 AS para_idx, turn // 2 AS run_idx, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY ALL)
SELECT doc_id, CAST(run_idx AS BIGINT) AS run_idx, CAST(length(t) AS INTEGER) AS chars, CASE WHEN run_idx = 0 THEN 'http://x' END AS target FROM f""")
def annotated_runs(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    runs = turns.select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).alias("para_idx"), F.floor(F.col("turn") / 2).alias("run_idx"), F.col("turn").alias("frag_idx"), "text", F.when(F.col("turn") < 2, "r1").alias("rid"))
    rels = turns.select(F.col("conv_id").alias("doc_id"), F.lit("r1").alias("rid"), F.lit("http://x").alias("target")).distinct()
    return V.annotated_runs(runs, rels).select("doc_id", "run_idx", "chars", "target")


#: What stands in the paragraph of each order, and in the properties of its mark.
_TAGS = """CASE left(o_orderpriority, 1) WHEN '1' THEN ['pPr', 'ins', 'moveTo'] WHEN '2' THEN ['pPr', 'del'] WHEN '3' THEN ['r', 'ins', 'proofErr'] WHEN '4' THEN ['pPr', 'bookmarkStart', 'moveFrom', 'hyperlink'] ELSE CASE o_orderstatus WHEN 'P' THEN ['pPr', 'r', 'rPrChange'] WHEN 'F' THEN ['pPr'] ELSE ['r'] END END AS tags,
  CASE WHEN o_totalprice > 450000 THEN ['ins'] WHEN o_totalprice > 400000 THEN ['del', 'b'] ELSE ['b'] END AS mark"""


@query("revision_predicates", f"""
WITH o AS (SELECT o_orderkey, {_TAGS} FROM orders)
SELECT o_orderkey, list_has_any(tags, ['ins', 'del', 'moveFrom', 'moveTo', 'rPrChange', 'pPrChange', 'sectPrChange', 'tblPrChange', 'trPrChange', 'tcPrChange']) AS has,
  list_contains(mark, 'ins') OR (list_has_any(tags, ['ins', 'moveTo']) AND NOT list_has_any(tags, ['r', 'del', 'moveFrom'])) AS ins,
  list_contains(mark, 'del') OR (list_has_any(tags, ['del', 'moveFrom']) AND NOT list_has_any(tags, ['r', 'ins', 'moveTo'])) AS del, tags = ['pPr'] AS empty FROM o""")
def revision_predicates(spark, sf_dir):
    t, m = F.col("tags"), F.col("mark")
    rows = corpus.table(spark, sf_dir, "orders").selectExpr("o_orderkey", *(x.strip() for x in _TAGS.replace("[", "array(").replace("]", ")").split(" AS tags,")[0:1]), _TAGS.replace("[", "array(").replace("]", ")").split(" AS tags,")[1].removesuffix(" AS mark")).toDF("o_orderkey", "tags", "mark")
    return rows.select("o_orderkey", V.has_revisions(t).alias("has"), V.entirely_inserted(t, m).alias("ins"), V.entirely_deleted(t, m).alias("del"), V.is_empty_paragraph(t).alias("empty"))


_NAMES = [*V.LEAVES, "p", "r", "tbl"]


@query("leaf_texts", f"""
WITH l AS (SELECT l_orderkey, l_shipmode_ AS text, {_NAMES}[CAST(l_partkey % {len(_NAMES)} + 1 AS INTEGER)] AS tag FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem))
SELECT l_orderkey, tag, tag NOT IN ('p', 'r', 'tbl') AS leaf, CASE WHEN tag IN ('t', 'delText') THEN text WHEN tag IN ('br', 'cr') THEN chr(10) WHEN tag = 'tab' THEN chr(9) ELSE '' END AS text FROM l""")
def leaf_texts(spark, sf_dir):
    tag = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("l_partkey") % len(_NAMES) + 1).cast("int"))
    rows = corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", tag.alias("tag"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return rows.select("l_orderkey", "tag", V.is_leaf(F.col("tag")).alias("leaf"), V.leaf_text(F.col("tag"), F.col("text")).alias("text"))


@query("element_hashes", "SELECT item_id, sha1('w:t|a=1,b=2|' || text) AS hash FROM benchmark")
def element_hashes(spark, sf_dir):
    attributes = F.create_map(F.lit("b"), F.lit("2"), F.lit("xml:space"), F.lit("preserve"), F.lit("a"), F.lit("1"))
    return corpus.table(spark, sf_dir, "benchmark").select("item_id", V.element_hash(F.lit("w:t"), attributes, F.col("text")).alias("hash"))


@query("paragraph_groups", f"""
SELECT doc_id, para_idx, sha1(text) AS hash, sha1({normalised('text')}) AS normalised_hash FROM {PARAGRAPHS} WHERE text <> ''""")
def paragraph_groups(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", F.posexplode(X.word_and_space_tokens(F.col("text"))).alias("atom_idx", "text"))
    return V.paragraph_groups(rows).select("doc_id", "para_idx", "hash", "normalised_hash")


#: The orders of a customer as runs, with all that a run may look like.
_RUNS = (
    "o_custkey AS doc_id", "o_orderkey AS run_idx", "CASE WHEN o_totalprice > 490000 THEN '' ELSE o_orderpriority || ' ' END AS text", "o_orderstatus = 'F' AS bold", "o_orderpriority < '3' AS italic", "o_totalprice > 400000 AS underline", "o_totalprice < 30000 AS highlight",
    "CASE WHEN o_orderstatus = 'P' THEN 'FF0000' END AS color", "CASE WHEN o_orderpriority = '5-LOW' THEN 12 END AS size", "CASE WHEN o_totalprice < 60000 THEN 'Arial' END AS font", "CASE WHEN o_orderpriority = '2-HIGH' THEN 'http://x?a=1&b=<' || o_orderstatus || '>' END AS href",
    "CASE WHEN o_custkey % 2 = 0 THEN TRUE END AS base_bold", "CASE WHEN o_custkey % 3 = 0 THEN FALSE END AS base_italic", "o_orderkey % 17 = 0 AS is_header",
)


@query("emitted_tags", f"""
WITH r AS (SELECT {', '.join(_RUNS)} FROM orders),
o AS (SELECT *, CASE WHEN is_header THEN '' ELSE coalesce('<a href="' || replace(replace(replace(href, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '">', '')
   || CASE WHEN color IS NOT NULL OR size IS NOT NULL OR font IS NOT NULL THEN '<font ' || concat_ws(' ', 'color="' || color || '"', 'size="' || size || '"', 'face="' || font || '"') || '>' ELSE '' END
   || CASE WHEN bold AND NOT coalesce(base_bold, FALSE) THEN '<b>' ELSE '' END || CASE WHEN italic AND NOT coalesce(base_italic, FALSE) THEN '<i>' ELSE '' END || CASE WHEN underline THEN '<u>' ELSE '' END || CASE WHEN highlight THEN '<highlight>' ELSE '' END END AS tags FROM r WHERE text <> ''),
i AS (SELECT *, sum(CASE WHEN tags IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY run_idx) AS k FROM (SELECT *, lag(tags) OVER (PARTITION BY doc_id ORDER BY run_idx) AS p FROM o)),
s AS (SELECT doc_id, k, min(run_idx) AS run_idx, any_value(tags) AS tags, string_agg(text, '' ORDER BY run_idx) AS text FROM i GROUP BY doc_id, k)
SELECT doc_id, string_agg(tags || text || CASE WHEN contains(tags, '<highlight>') THEN '</highlight>' ELSE '' END || CASE WHEN contains(tags, '<u>') THEN '</u>' ELSE '' END || CASE WHEN contains(tags, '<i>') THEN '</i>' ELSE '' END
  || CASE WHEN contains(tags, '<b>') THEN '</b>' ELSE '' END || CASE WHEN contains(tags, '<font ') THEN '</font>' ELSE '' END || CASE WHEN contains(tags, '<a ') THEN '</a>' ELSE '' END, '' ORDER BY run_idx) AS tagged FROM s GROUP BY doc_id""")
def emitted_tags(spark, sf_dir):
    return V.tagged(corpus.table(spark, sf_dir, "orders").selectExpr(*_RUNS), ["doc_id"], "run_idx")


_WRITTEN = """CASE p_size % 6 WHEN 0 THEN '<b>' || p_name || '</b><b>!</b> & x < y <i><u>' || p_type || '</u></i>' WHEN 1 THEN '<font color="F00" size="10.5">' || p_name || '<font face=''A>B''>' || p_type || '</font></font>.'
 WHEN 2 THEN '<header>' || p_name || '</header><RunInHeader>:</RunInHeader> <highlight>a</highlight><highlighting>b</highlighting>' WHEN 3 THEN '<b>' || p_name WHEN 4 THEN p_name || '</font>' ELSE '<bold>' || p_name || '</bold>' END"""


@query("parsed_tags", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'b:' || p_name || '!|: & x < y |iu:' || p_type WHEN 1 THEN 'F00/21/:' || p_name || '|F00/21/A>B:' || p_type || '|:.' WHEN 2 THEN 'h:' || p_name || ':|: |m:ab' WHEN 5 THEN ':<bold>' || p_name || '</bold>' ELSE '' END AS told,
  CASE p_size % 6 WHEN 3 THEN 'unbalanced bold tags' WHEN 4 THEN 'unbalanced font tags' END AS error FROM part""")
def parsed_tags(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "part").select("p_partkey", V.parse_tagged(F.expr(_WRITTEN.replace("''A>B''", "\\'A>B\\'"))).alias("p"))
    flag = lambda s, c, sign: F.when(s[c], sign).otherwise("")
    font = lambda s: F.when(s["color"].isNotNull() | s["font"].isNotNull(), F.concat(F.coalesce(s["color"], F.lit("")), F.lit("/"), F.coalesce(s["half_points"].cast("string"), F.lit("")), F.lit("/"), F.coalesce(s["font"], F.lit("")))).otherwise("")
    told = lambda s: F.concat(*[flag(s, c, sign) for c, sign in (("bold", "b"), ("italic", "i"), ("underline", "u"), ("highlight", "m"), ("header", "h"))], font(s), F.lit(":"), s["text"])
    return rows.select("p_partkey", F.array_join(F.transform("p.segments", told), "|").alias("told"), F.col("p.error").alias("error"))


@query("tag_deltas", """
WITH s AS (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F'), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O'), []) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS missing, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS unexpected, list_sort(a) = list_sort(b) AS same FROM s""")
def tag_deltas(spark, sf_dir):
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = corpus.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(V.set_delta(of("F"), of("O")).alias("d"))
    return rows.select("o_custkey", F.array_join("d.missing", ",").alias("missing"), F.array_join("d.unexpected", ",").alias("unexpected"), "d.same")


@query("text_gate", "SELECT doc_id AS pair_id, doc_id % 3 <> 0 AS passed, CASE WHEN doc_id % 3 = 0 THEN 'accepted text differs' END AS reason FROM documents")
def text_gate(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("pair_id"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.concat("text", F.lit(" \n"))).alias("accepted"), F.col("text").alias("revised"), F.col("text").alias("rejected"), F.col("text").alias("original"))
    return V.text_gate(rows)


@query("formatting_gate", f"SELECT doc_id, para_idx FROM {PARAGRAPHS} WHERE para_idx % 4 = 1")
def formatting_gate(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", "lang")
    left, right = rows.withColumn("style", F.col("lang")), rows.withColumn("style", F.when(F.col("para_idx") % 4 == 1, "other").otherwise(F.col("lang")))
    return V.formatting_gate(left, right).select("doc_id", "para_idx")


#: A piece of markup for each customer, in prefixes by segment and nation, of which some are declared.
_MARKUP = "'<w:p xmlns:w=\"u\"' || CASE WHEN c_nationkey % 2 = 0 THEN ' xmlns:' || lower(c_mktsegment) || '=\"v\"' ELSE '' END || '><n' || c_nationkey || ':a/><' || lower(c_mktsegment) || ':b/><w:r/></w:p>'"


@query("undeclared_prefixes", """
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'n' || c_nationkey ELSE least('n' || c_nationkey, lower(c_mktsegment)) || ',' || greatest('n' || c_nationkey, lower(c_mktsegment)) END AS prefixes FROM customer""")
def undeclared_prefixes(spark, sf_dir):
    return corpus.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(V.undeclared_prefixes(F.expr(_MARKUP)), ",").alias("prefixes"))


@query("deterministic_rows", f"SELECT count(*) AS rows, TRUE AS same FROM {PARAGRAPHS}")
def deterministic_rows(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir)
    return V.same_rows(rows, rows.repartition(7))


@query("latest_sessions", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS session_id FROM events GROUP BY user_id")
def latest_sessions(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("last_used"))
    return V.latest(rows, ["user_id"])


@query("longest_runs", "SELECT conv_id, arg_max(turn, length(text) * 1000 - turn) AS turn FROM conversations GROUP BY conv_id")
def longest_runs(spark, sf_dir):
    return V.longest_run(corpus.table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("utc_stamps", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%SZ') AS stamp FROM events")
def utc_stamps(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").select("event_id", V.utc_stamp(F.col("ts")).alias("stamp"))


@query("clean_previews", "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS preview FROM documents")
def clean_previews(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text"), 60).alias("preview"))
