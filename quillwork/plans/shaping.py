"""Scalar functions, edits, plans and archives."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import counters as C
from ..functions import formatting as S
from ..functions import text as X
from ..lineage import shared_folder
from ..operators import edits as E
from ..operators import ordered as O
from ..operators import planning as P
from ..registry import query
from ..sources import archives as A
from ..sources import corpus
from ..sources import reports
from ..sources.zipped import register
from .ordering import ordinal_sql
from .sql import PARAGRAPHS, normalised, words


@query("word_counts", f"SELECT doc_id, CAST(len({words('text')}) AS INTEGER) AS words FROM documents")
def word_counts(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("paragraph_hashes", f"SELECT doc_id, para_idx, sha1({normalised('text')}) AS hash FROM {PARAGRAPHS}")
def paragraph_hashes(spark, sf_dir):
    return corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", X.paragraph_hash(F.col("text")).alias("hash"))


@query("word_tokens", r"SELECT item_id, regexp_extract_all(text, '\s+|\S+') AS tokens FROM benchmark")
def word_tokens(spark, sf_dir):
    return corpus.table(spark, sf_dir, "benchmark").select("item_id", X.word_and_space_tokens(F.col("text")).alias("tokens"))


#: Paragraphs behind a label of one of twelve kinds, or none, by their length.
LABELLED = """CASE length(text) % 13 WHEN 0 THEN 'Section 3.1(a) ' WHEN 1 THEN 'ARTICLE IV ' WHEN 2 THEN '1.2. ' WHEN 3 THEN '7) ' WHEN 4 THEN '(12)  ' WHEN 5 THEN '(iv) ' WHEN 6 THEN '(i) ' WHEN 7 THEN '(B)' WHEN 8 THEN '(ABC) '
 WHEN 9 THEN 'section ' WHEN 10 THEN '3.1 ' WHEN 11 THEN ' (a) ' ELSE '' END || text"""
_LABEL_SQL = [("SECTION", r"^(?i:section)\s+[\d.]+(\([a-zA-Z]\))?"), ("ARTICLE", r"^(?i:article)\s+[\dIVXLCDMivxlcdm.]+"), ("NUMBERED_HEADING", r"^\d+(\.\d+)*[.)]\s*"), ("NUMBER", r"^\(\d+\)\s*"), ("ROMAN", r"^\([ivxlcdmIVXLCDM]{2,}\)\s*"), ("LETTER", r"^\([a-zA-Z]+\)\s*")]


LABEL_PARTS = f"CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in _LABEL_SQL)} END AS kind, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}')" for _, p in _LABEL_SQL)} ELSE '' END AS hit"


@query("list_labels", rf"""
WITH p AS (SELECT doc_id, para_idx, {LABELLED} AS text FROM {PARAGRAPHS}), m AS (SELECT *, {LABEL_PARTS} FROM p)
SELECT doc_id, para_idx, nullif(regexp_replace(hit, '\s+$', ''), '') AS label, kind, CASE WHEN hit <> '' THEN regexp_replace(substr(text, length(hit) + 1), '^\s+', '') ELSE text END AS rest FROM m""")
def list_labels(spark, sf_dir):
    t = F.col("text")
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", F.expr(LABELLED).alias("text"))
    return rows.select("doc_id", "para_idx", X.label(t).alias("label"), X.label_type(t).alias("kind"), X.without_label(t).alias("rest"))


@query("labelled_paragraphs", f"SELECT doc_id, para_idx FROM {PARAGRAPHS} WHERE regexp_matches(text, '^\\d+(\\.\\d+)*[.)]|^\\(([a-zA-Z]+|\\d+)\\)|^(?i:section)\\s+[\\d.]+|^(?i:article)\\s+[\\dIVXLCDMivxlcdm.]+')")
def labelled_paragraphs(spark, sf_dir):
    return corpus.paragraphs(spark, sf_dir).where(X.label(F.col("text")).isNotNull()).select("doc_id", "para_idx")


#: What may be the heading of a paragraph: its first word, without the stop at its end, or something else.
_HEAD = "CASE length(text) % 4 WHEN 0 THEN lower(split_part(text, ' ', 1)) WHEN 1 THEN regexp_replace(split_part(text, ' ', 1), '[.,]+$', '') WHEN 2 THEN '' ELSE 'nothing' END"


@query("without_header", rf"""
WITH p AS (SELECT doc_id, para_idx, text, {_HEAD} AS head FROM {PARAGRAPHS}), k AS (SELECT *, lower(trim(head)) AS key, lower(text) AS low FROM p)
SELECT doc_id, para_idx, CASE WHEN head = '' THEN text {' '.join(rf"WHEN starts_with(low, key || '{m}') THEN regexp_replace(substr(text, length(key || '{m}') + 1), '^\s+', '')" for m in (':', '.', '-', ';', ''))} ELSE text END AS rest FROM k""")
def without_header(spark, sf_dir):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    n = F.length("text") % 4
    head = F.when(n == 0, F.lower(first)).when(n == 1, F.regexp_replace(first, "[.,]+$", "")).when(n == 2, "").otherwise("nothing")
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", "text", head.alias("head"))
    return rows.select("doc_id", "para_idx", X.without_header(F.col("text"), F.col("head")).alias("rest"))


@query("strip_tags", r"""
SELECT page_id, length(regexp_replace(html, '</?[biu]>', '', 'g')) AS formatting, length(regexp_replace(html, '<a\s+href="[^"]*">|</a>', '', 'g')) AS hyperlink,
 length(regexp_replace(html, '</?highlight(?:ing)?>', '', 'g')) AS highlight, sha1(regexp_replace(html, '</?(?:b|i|u|highlight|highlighting|a|font|header|RunInHeader|definition)(?:\s[^>]*)?>|<a\s+href="[^"]*">', '', 'g')) AS inline,
 regexp_matches(html, '</?[biu]>') AS has_formatting FROM pages""")
def strip_tags(spark, sf_dir):
    h = F.col("html")
    n = lambda k: F.length(X.without_tags(h, k)).cast("long")
    return corpus.table(spark, sf_dir, "pages").select("page_id", n("formatting").alias("formatting"), n("hyperlink").alias("hyperlink"), n("highlight").alias("highlight"), F.sha1(X.without_tags(h)).alias("inline"), X.has_tags(h, "formatting").alias("has_formatting"))


@query("escaped_text", """SELECT page_id, sha1(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM pages""")
def escaped_text(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", F.sha1(X.escaped_attribute(F.col("url"))).alias("escaped"))


#: Quotes put around and into each paragraph, and the style of its document.
_QUOTED = """'"' || text || '" ("x") ''y'' it''s' """
_QUOTE_OF = """CASE length(text) % 4 WHEN 0 THEN '“hi” ‘no’' WHEN 1 THEN 'plain' WHEN 2 THEN 'only ’ here' ELSE '„x“' END"""


def _styled_sql(text: str, plain: str, left: str, right: str) -> str:
    opening = f"CASE WHEN contains(q, '{left}') THEN '{left}' WHEN contains(q, '{right}') THEN '{right}' ELSE '{plain}' END"
    closing = f"CASE WHEN contains(q, '{right}') THEN '{right}' WHEN contains(q, '{left}') THEN '{left}' ELSE '{plain}' END"
    return rf"replace(replace(regexp_replace({text}, '(^|[\s(\[{{]){plain}', '\1' || chr(1), 'g'), '{plain}', {closing}), chr(1), {opening})"


@query("quote_style", f"""
WITH p AS (SELECT doc_id, para_idx, {_QUOTED} AS t, {_QUOTE_OF} AS q FROM {PARAGRAPHS})
SELECT doc_id, para_idx, {_styled_sql(_styled_sql('t', '"', '“', '”'), "''", '‘', '’')} AS styled FROM p""")
def quote_style(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", F.concat(F.lit('"'), F.col("text"), F.lit("\" (\"x\") 'y' it's")).alias("t"), F.expr(_QUOTE_OF).alias("q"))
    return rows.select("doc_id", "para_idx", X.in_quote_style(F.col("q"), F.col("t")).alias("styled"))


@query("merged_tags", f"""
WITH w AS (SELECT doc_id, para_idx, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM {PARAGRAPHS}),
f AS (SELECT *, length(w) % 2 = 0 AS b, length(w) % 3 = 0 AS u FROM w),
g AS (SELECT *, lag(b) OVER o AS pb, lead(b) OVER o AS nb, lag(u) OVER o AS pu, lead(u) OVER o AS nu FROM f WINDOW o AS (PARTITION BY doc_id, para_idx ORDER BY i))
SELECT doc_id, para_idx, string_agg(CASE WHEN b AND NOT coalesce(pb, FALSE) THEN '<b>' ELSE '' END || CASE WHEN u AND NOT coalesce(pu AND pb = b, FALSE) THEN '<i>' ELSE '' END || w ||
  CASE WHEN u AND NOT coalesce(nu AND nb = b, FALSE) THEN '</i>' ELSE '' END || CASE WHEN b AND NOT coalesce(nb, FALSE) THEN '</b>' ELSE '' END, '' ORDER BY i) AS merged FROM g GROUP BY ALL""")
def merged_tags(spark, sf_dir):
    """Words of each paragraph in tags of their own, then with tags that touch joined."""
    w = F.split("text", " ")
    put = lambda tag, on, t: F.when(on, F.concat(F.lit(f"<{tag}>"), t, F.lit(f"</{tag}>"))).otherwise(t)
    tagged = F.array_join(F.transform(w, lambda x: put("b", F.length(x) % 2 == 0, put("i", F.length(x) % 3 == 0, x))), "")
    return corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", X.merged_tags(tagged).alias("merged"))


@query("counter_formats", """
SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
  (WITH RECURSIVE spelt(rest, letters) AS (SELECT o_orderkey, '' UNION ALL SELECT (rest - 1) // 26, chr(CAST(97 + (rest - 1) % 26 AS INTEGER)) || letters FROM spelt WHERE rest > 0)
   SELECT letters FROM spelt WHERE rest <= 0) AS letters FROM orders""")
def counter_formats(spark, sf_dir):
    n = F.col("o_orderkey")
    return corpus.table(spark, sf_dir, "orders").select(n.alias("n"), C.ordinal(n).alias("ordinal"), C.letters(n).alias("letters"))


def _pick(values: list[str], index: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST({index} AS INTEGER)]"


_ROMAN_SQL = "repeat('M', CAST(n // 1000 AS INTEGER))" + "".join(" || " + _pick(["", *(x.replace("I", a).replace("V", b).replace("x", c) for x in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "Ix"))], f"(n // {d}) % 10 + 1") for d, a, b, c in ((100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X")))


@query("number_words", f"""
WITH o AS (SELECT o_orderkey, o_custkey % 120 + o_orderkey % 3 * 1000 AS n FROM orders)
SELECT o_orderkey, {_ROMAN_SQL} AS roman,
  CASE WHEN n BETWEEN 1 AND 19 THEN {_pick(C.ONES, 'n')} WHEN n BETWEEN 20 AND 99 THEN {_pick(C.TENS, 'n // 10 - 1')} || CASE WHEN n % 10 > 0 THEN '-' || {_pick(C.ONES, 'n % 10')} ELSE '' END ELSE CAST(n AS VARCHAR) END AS cardinal,
  CASE WHEN n BETWEEN 1 AND 12 THEN {_pick(C.ORDINALS, 'n')} ELSE {ordinal_sql('n')} END AS ordinal FROM o""")
def number_words(spark, sf_dir):
    n = F.col("n")
    rows = corpus.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 120 + F.col("o_orderkey") % 3 * 1000).alias("n"))
    return rows.select("o_orderkey", C.formatted(n, F.lit("upperRoman")).alias("roman"), C.formatted(n, F.lit("cardinalText")).alias("cardinal"), C.formatted(n, F.lit("ordinalText")).alias("ordinal"))


@query("legal_numbering", f"""
WITH l AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q, l_returnflag = 'R' AS legal FROM lineitem)
SELECT l_orderkey, n AS line, q AS quantity, CASE WHEN legal THEN n || '.' || q ELSE {_pick(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'], 'n')} || '.' || CASE WHEN q > 26 THEN chr(CAST(96 + (q - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(97 + (q - 1) % 26 AS INTEGER)) END AS label FROM l""")
def legal_numbering(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("quantity"), (F.col("l_returnflag") == "R").alias("legal"))
    label = C.expanded(F.lit("%1.%2"), F.array("line", "quantity"), F.array(F.lit("upperRoman"), F.lit("lowerLetter")), F.array(F.lit(False), F.col("legal")))
    return rows.select("l_orderkey", "line", "quantity", label.alias("label"))


@query("formatting_units", """
WITH l AS (SELECT o_orderkey, o_custkey % 1500 AS tw, CASE o_orderstatus WHEN 'F' THEN o_custkey % 900 END AS fl, CASE o_orderstatus WHEN 'O' THEN o_custkey % 700 END AS hg, CASE left(o_orderpriority, 1) WHEN '1' THEN 'both' WHEN '2' THEN 'center' WHEN '3' THEN 'right' WHEN '4' THEN 'start' END AS jc, o_orderstatus <> 'P' AS has, CASE left(o_orderpriority, 1) WHEN '1' THEN '0' WHEN '2' THEN 'OFF' WHEN '3' THEN '1' END AS val FROM orders)
SELECT o_orderkey, (tw + 1) // 2 / 10.0 AS points, CASE WHEN hg IS NOT NULL THEN (0 - (hg + 1) // 2) / 10.0 WHEN fl IS NOT NULL THEN (fl + 1) // 2 / 10.0 ELSE 0.0 END AS indent,
  CASE jc WHEN 'both' THEN 'JUSTIFY' WHEN 'center' THEN 'CENTER' WHEN 'right' THEN 'RIGHT' ELSE 'LEFT' END AS align, CASE WHEN has THEN coalesce(lower(val) NOT IN ('0', 'off'), TRUE) END AS bold FROM l""")
def formatting_units(spark, sf_dir):
    key, status, first = F.col("o_custkey"), F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1))
    indent = S.first_line_indent(F.when(status == "F", key % 900), F.when(status == "O", key % 700))
    align = S.alignment(F.try_element_at(F.create_map(*map(F.lit, ("1", "both", "2", "center", "3", "right", "4", "start"))), first))
    bold = S.toggle(status != "P", F.try_element_at(F.create_map(*map(F.lit, ("1", "0", "2", "OFF", "3", "1"))), first))
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", S.points(key % 1500).cast("double").alias("points"), indent.cast("double").alias("indent"), align.alias("align"), bold.alias("bold"))


def _diff_sql(when: str) -> str:
    """SQL for the sorted plain names of the properties of a row for which ``when`` holds (o and n: old and new value)."""
    pairs = (("bold", "b_old", "b_new"), ("fontSize", "s_old", "s_new"), ("italic", "i_old", "i_new"), ("verticalAlign", "v_old", "v_new"))
    return "list_filter([" + ", ".join(f"CASE WHEN {when.format(o=o, n=n)} THEN '{name}' END" for name, o, n in pairs) + "], lambda x: x IS NOT NULL)"


_PROPERTIES = (
    "CASE WHEN o_orderstatus <> 'F' THEN '1' END AS b_old", "CASE WHEN o_orderpriority > '3' THEN '1' END AS b_new", "CASE o_custkey % 3 WHEN 0 THEN '20' WHEN 1 THEN '22' ELSE '24' END AS s_old", "CASE o_orderkey % 3 WHEN 0 THEN '20' WHEN 1 THEN '22' ELSE '24' END AS s_new",
    "CASE WHEN o_totalprice > 200000 THEN 'x' END AS i_old", "CASE WHEN o_orderstatus = 'O' THEN 'y' END AS i_new", "CASE WHEN o_orderpriority < '3' THEN o_orderstatus END AS v_old", "CASE WHEN o_totalprice < 300000 THEN 'F' END AS v_new",
)


@query("property_set_diff", f"""
WITH p AS (SELECT o_orderkey, {', '.join(_PROPERTIES)} FROM orders)
SELECT o_orderkey, array_to_string({_diff_sql('{o} IS NULL AND {n} IS NOT NULL')}, ',') AS added, array_to_string({_diff_sql('{o} IS NOT NULL AND {n} IS NULL')}, ',') AS removed,
  array_to_string({_diff_sql('{o} <> {n}')}, ',') AS changed, array_to_string({_diff_sql('{o} IS DISTINCT FROM {n}')}, ',') AS names FROM p""")
def property_set_diff(spark, sf_dir):
    names = {"w:b": "b", "w:sz": "s", "w:i": "i", "w:vertAlign": "v"}
    rows = corpus.table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_PROPERTIES)
    side = lambda which: F.map_filter(F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(f"{c}_{which}"))]), lambda k, v: v.isNotNull())
    rows = rows.select("o_orderkey", side("old").alias("old"), side("new").alias("new")).withColumn("d", S.property_diff(F.col("old"), F.col("new")))
    plain = lambda c: F.array_join(F.array_sort(F.transform(c, lambda k: F.element_at(F.create_map(*[F.lit(x) for p in S.PROPERTY_NAMES.items() for x in p]), k))), ",")
    return rows.select("o_orderkey", plain(F.col("d.added")).alias("added"), plain(F.col("d.removed")).alias("removed"), plain(F.col("d.changed")).alias("changed"), F.array_join(S.changed_properties(F.col("old"), F.col("new")), ",").alias("names"))


@query("common_affixes", """
WITH p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT item_id, CAST(coalesce((SELECT max(i) FROM range(1, 400) t(i) WHERE i <= least(length(x), length(y)) AND left(x, CAST(i AS INTEGER)) = left(y, CAST(i AS INTEGER))), 0) AS INTEGER) AS prefix FROM p""")
def common_affixes(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "benchmark")
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y"))
    return rows.join(after, "item_id").select("item_id", X.common_prefix(F.col("text"), F.col("y")).alias("prefix"))


def _alike(x: str) -> str:
    for pattern, to in (("\\r\\n?", "\\n"), ("\\t", " "), (" +", " "), (" *\\n *", "\\n"), ("\\n{2,}", "\\n")):
        x = f"regexp_replace({x}, '{pattern}', {'chr(10)' if to != ' ' else repr(to)}, 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query("text_compare", f"""
WITH p AS (SELECT a.item_id, a.text AS x, CASE WHEN length(a.text) % 3 = 0 THEN replace(a.text, ' ', chr(9) || ' ') || chr(13) || chr(10) WHEN length(a.text) % 3 = 1 THEN a.text ELSE b.text END AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
n AS (SELECT *, {_alike('x')} AS nx, {_alike('y')} AS ny FROM p)
SELECT item_id, x = y AS identical, nx = ny AS normalised_identical,
 CASE WHEN nx <> ny THEN CAST(coalesce((SELECT max(i) FROM range(1, 2000) t(i) WHERE i <= least(length(nx), length(ny)) AND left(nx, CAST(i AS INTEGER)) = left(ny, CAST(i AS INTEGER))), 0) AS INTEGER) END AS first_difference FROM n""")
def text_compare(spark, sf_dir):
    """Each benchmark item against itself with other blanks, itself as it is, or the next item."""
    rows = corpus.table(spark, sf_dir, "benchmark")
    n = F.length("text") % 3
    other = F.when(n == 0, F.concat(F.replace("text", F.lit(" "), F.lit("\t ")), F.lit("\r\n"))).when(n == 1, F.col("text")).otherwise(F.col("after"))
    rows = rows.join(rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after")), "item_id").select("item_id", X.compared(F.col("text"), other).alias("c"))
    return rows.select("item_id", "c.identical", "c.normalised_identical", "c.first_difference")


@query("placeholder_leaks", "SELECT doc_id FROM documents WHERE regexp_matches(text, '\\{[A-Za-z_][A-Za-z0-9_]*\\}') OR regexp_matches(text, '\\[[^\\]]*\\]|«[^»]*»')")
def placeholder_leaks(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").where(X.leaks_placeholder(F.col("text")) | X.has_field_placeholder(F.col("text"))).select("doc_id")


@query("canonical_view", "SELECT conv_id AS doc_id, string_agg('P' || (turn + 1), ' ' ORDER BY turn) AS canonical FROM conversations GROUP BY conv_id")
def canonical_view(spark, sf_dir):
    rows = O.first_appearance(corpus.table(spark, sf_dir, "conversations").withColumn("para_id", X.short_id(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))), ["conv_id"], "para_id", "turn")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("P"), (F.col("index") + 1).cast("string")).alias("p")))), lambda x: x["p"])
    return rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(lines, " ").alias("canonical"))


# Edits.


_OLD = "CASE length(text) % 5 WHEN 0 THEN 'zq' || left(text, 10) ELSE left(text, 12) END"


@query("edit_apply", f"""
WITH e AS (SELECT doc_id, text, {_OLD} AS old FROM documents),
c AS (SELECT *, CASE WHEN old = '' OR NOT contains(text, old) THEN 0 WHEN contains(substr(text, instr(text, old) + 1), old) THEN 2 ELSE 1 END AS n FROM e)
SELECT doc_id, sha1(CASE WHEN n = 1 THEN 'REPLACED' || substr(text, length(old) + 1) ELSE text END) AS after, CASE WHEN n = 1 THEN 'unique' WHEN n = 0 THEN 'not_found' ELSE 'multiple' END AS status FROM c""")
def edit_apply(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_OLD).alias("old"), F.lit("REPLACED").alias("new"))
    return E.replace_unique(rows).select("doc_id", F.sha1("after").alias("after"), "status")


@query("minimal_edits", """
WITH c AS (SELECT c_custkey, c_mktsegment AS m, CASE WHEN c_acctbal < 0 THEN c_mktsegment || ' ' || c_mktsegment ELSE c_name || ' ' || c_mktsegment END AS text FROM customer)
SELECT c_custkey, CASE WHEN text LIKE 'Customer%' THEN left(text, length(text) - length(m)) || left(m, 3) || 'x' || right(m, 2) ELSE text END AS after,
  CASE WHEN text LIKE 'Customer%' THEN substr(m, 4, length(m) - 5) END AS changed_old, CASE WHEN text LIKE 'Customer%' THEN 'x' END AS changed_new FROM c""")
def minimal_edits(spark, sf_dir):
    m = F.col("c_mktsegment")
    text = F.when(F.col("c_acctbal") < 0, F.concat_ws(" ", m, m)).otherwise(F.concat_ws(" ", "c_name", m))
    new = F.concat(F.left(m, F.lit(3)), F.lit("x"), F.right(m, F.lit(2)))
    out = E.replace_unique(corpus.table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), m.alias("old"), new.alias("new")))
    return out.select("c_custkey", "after", "changed_old", F.when(F.col("changed_old").isNotNull(), F.col("changed_new")).alias("changed_new"))


@query("inserted_paragraphs", """
WITH p AS (SELECT conv_id AS doc_id, turn * 10 AS o, text FROM conversations UNION ALL SELECT conv_id, 5, 'first' FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, 6, 'second' FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, -1, 'head' FROM conversations WHERE turn = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS para_idx, text FROM p""")
def inserted_paragraphs(spark, sf_dir):
    paras = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("para_idx"), "text")
    spots = paras.where("para_idx = 0").select("doc_id", "para_idx")
    new = spots.select("*", F.lit("AFTER").alias("position"), F.lit("first\n\nsecond").alias("text")).unionByName(spots.select("*", F.lit("BEFORE").alias("position"), F.lit("head").alias("text")))
    return E.insert_paragraphs(paras, new)


@query("spacing_updates", "SELECT conv_id AS doc_id, turn AS para_idx, CASE WHEN turn = 1 THEN 12 ELSE CAST(turn AS INTEGER) END AS before FROM conversations")
def spacing_updates(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_idx"), F.col("turn").cast("int").alias("before"))
    return E.updated(rows, rows.where("para_idx = 1").withColumn("before", F.lit(12)), ["doc_id", "para_idx"], ["before"])[0]


@query("layout_errors", """
WITH l AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 5 - 1 END AS before, CASE WHEN o_totalprice > 250000 THEN o_custkey % 7 - 1 END AS after, CASE o_orderpriority WHEN '1-URGENT' THEN 'odd' WHEN '2-HIGH' THEN 'exact' WHEN '5-LOW' THEN NULL ELSE 'auto' END AS rule FROM orders)
SELECT o_orderkey, 'before is negative' AS error FROM l WHERE before < 0 UNION ALL SELECT o_orderkey, 'after is negative' FROM l WHERE after < 0 UNION ALL SELECT o_orderkey, 'unknown rule' FROM l WHERE rule = 'odd'
UNION ALL SELECT o_orderkey, 'nothing to change' FROM l WHERE before IS NULL AND after IS NULL""")
def layout_errors(spark, sf_dir):
    key, p = F.col("o_custkey"), F.col("o_orderpriority")
    rule = F.when(p == "1-URGENT", "odd").when(p == "2-HIGH", "exact").when(p != "5-LOW", "auto")
    rows = corpus.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", key % 5 - 1).alias("before"), F.when(F.col("o_totalprice") > 250000, key % 7 - 1).alias("after"), rule.alias("rule"))
    return E.layout_errors(rows).select("o_orderkey", F.explode("errors").alias("error"))


@query("cleared_formatting", "SELECT conv_id, turn, length(text) % 2 = 0 AS bold, CAST(NULL AS VARCHAR) AS color FROM conversations")
def cleared_formatting(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 2 == 0).alias("bold"), F.col("role").alias("color"))
    return E.cleared(rows, "color")


@query("note_edits", """
WITH n AS (SELECT conv_id AS doc_id, turn + 1 AS note_id, text FROM conversations), m AS (SELECT doc_id, max(note_id) AS last FROM n GROUP BY 1)
SELECT doc_id, note_id, CASE WHEN note_id = 1 THEN 'changed' ELSE text END AS text FROM n WHERE note_id <> 2 UNION ALL SELECT doc_id, last + 1, 'new' FROM m""")
def note_edits(spark, sf_dir):
    notes = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("note_id"), "text")
    docs = notes.select("doc_id").distinct()
    out = E.add_notes(notes, docs.withColumn("text", F.lit("new")))
    out = E.update_notes(out, docs.select("doc_id", F.lit(1).cast("long").alias("note_id"), F.lit("changed").alias("text")))
    return E.delete_notes(out, docs.select("doc_id", F.lit(2).cast("long").alias("note_id"))).select("doc_id", "note_id", "text")


# Plans.

#: Each order is a plan of two steps for its customer's document, which has four paragraphs.
_STEPS = """st AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS INTEGER) AS plan_index, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 4 END AS base_revision, 0 AS step_index,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 's1' ELSE 'auto_' || (o_orderkey + 1) || '_1' END AS step_id, 'replace_text' AS operation, CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS k,
    CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 40 AS INTEGER) END AS start, CASE o_orderstatus WHEN 'F' THEN '#' WHEN 'O' THEN 'U' ELSE '-' END AS old_string, '+' || o_orderstatus AS new_string, CAST(NULL AS VARCHAR) AS position FROM orders
  UNION ALL SELECT o_custkey, CAST(o_orderkey AS INTEGER), CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 4 END, 1, 'auto_' || (o_orderkey + 1) || '_2', CASE WHEN o_totalprice > 450000 THEN 'dance' ELSE 'insert_paragraph' END, CAST(left(o_orderpriority, 1) AS INTEGER) - 1,
    NULL, NULL, 'new ' || o_orderkey || chr(10) || chr(10) || 'more', CASE o_orderstatus WHEN 'F' THEN 'BEFORE' WHEN 'O' THEN 'AFTER' END FROM orders)"""
_PARAS = "pa AS (SELECT c_custkey AS doc_id, [c_name, c_mktsegment, '-' || c_mktsegment, c_name || '#' || c_mktsegment] AS t FROM customer)"


def plans(spark, sf_dir):
    """Orders as plans of two steps: a replacement and an insertion."""
    status, key, para = F.col("o_orderstatus"), F.col("o_orderkey"), F.concat(F.lit("p"), (F.left("o_orderpriority", F.lit(1)).cast("int") - 1).cast("string"))
    text = lambda **by: reduce(lambda c, x: F.when(status == x[0], x[1]).otherwise(c), by.items(), F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    spot = F.struct((key % 40).cast("int").alias("start"), (key % 40 + 6).cast("int").alias("end"))
    replace = F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "s1").alias("step_id"), F.lit(" Replace_Text ").alias("op"), none.alias("operation"), para.alias("target_paragraph_id"), none.alias("positional_anchor_node_id"), none.alias("position"), text(F="#", O="U", P="-").alias("old_string"), F.concat(F.lit("+"), status).alias("new_string"), F.when(F.col("o_custkey") % 2 == 0, spot).alias("range"))
    insert = F.struct(none.alias("step_id"), none.alias("op"), F.when(F.col("o_totalprice") > 450000, "dance").otherwise("insert_paragraph").alias("operation"), none.alias("target_paragraph_id"), para.alias("positional_anchor_node_id"), text(F="before", O="AFTER").alias("position"), none.alias("old_string"), F.concat(F.lit("new "), key.cast("string"), F.lit("\n\nmore")).alias("new_string"), F.lit(None).cast(spark.range(1).select(spot_type()).schema[0].dataType).alias("range"))
    return corpus.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.cast("int").alias("plan_index"), F.concat(F.lit("plan"), key.cast("string")).alias("plan_id"), F.when(status == "F", 3).when(status == "O", 4).alias("base_revision"), F.to_json(F.array(replace, insert)).alias("steps"))


def spot_type():
    return F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))


def plan_steps_of(spark, sf_dir):
    return P.steps(plans(spark, sf_dir))


def plan_paragraphs(spark, sf_dir):
    """Four paragraphs for each customer."""
    name, m = F.col("c_name"), F.col("c_mktsegment")
    texts = F.array(name, m, F.concat(F.lit("-"), m), F.concat(name, F.lit("#"), m))
    rows = corpus.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(texts).alias("para_idx", "text"))
    return rows.withColumn("para_id", F.concat(F.lit("p"), F.col("para_idx").cast("string")))


@query("plan_steps", f"WITH {_STEPS} SELECT doc_id, plan_index, CAST(step_index AS INTEGER) AS step_index, step_id, operation, position, start FROM st")
def plan_steps(spark, sf_dir):
    return plan_steps_of(spark, sf_dir).select("doc_id", "plan_index", "step_index", "step_id", "operation", "position", "start")


_CONFLICTS = f"""WITH {_STEPS},
ed AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (start IS NULL) OVER w AS unknown FROM st WHERE operation = 'replace_text' WINDOW w AS (PARTITION BY doc_id, k)),
sw AS (SELECT *, max(start + 6) OVER (PARTITION BY doc_id, k ORDER BY start, plan_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM ed WHERE n > 1 AND unknown = 0),
co AS (SELECT doc_id, 'DUPLICATE_STEP_ID' AS code, step_id AS subject, count(*) AS n FROM st GROUP BY doc_id, step_id HAVING count(*) > 1
  UNION ALL SELECT doc_id, 'UNKNOWN_REPLACE_RANGE', 'p' || k, count(*) FROM ed WHERE n > 1 AND unknown > 0 GROUP BY doc_id, k
  UNION ALL SELECT doc_id, 'OVERLAPPING_REPLACE_RANGE', 'p' || k, 2 FROM sw WHERE far > start
  UNION ALL SELECT doc_id, 'INSERT_SLOT_COLLISION', 'p' || k || '::' || position, count(*) FROM st WHERE operation = 'insert_paragraph' AND position IS NOT NULL GROUP BY doc_id, k, position HAVING count(*) > 1
  UNION ALL SELECT doc_id, 'BASE_REVISION_CONFLICT', string_agg(DISTINCT CAST(base_revision AS VARCHAR), ', ' ORDER BY CAST(base_revision AS VARCHAR)), 0 FROM st WHERE base_revision IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT base_revision) > 1)"""


@query("plan_conflicts", _CONFLICTS + " SELECT doc_id, code, subject, CAST(n AS INTEGER) AS n FROM co")
def plan_conflicts(spark, sf_dir):
    return P.conflicts(plan_steps_of(spark, sf_dir)).select("doc_id", "code", "subject", F.size("refs").alias("n"))


@query("merged_plan", _CONFLICTS + " SELECT doc_id, step_id, CAST(plan_index AS BIGINT) * 4294967296 + step_index AS place FROM st WHERE doc_id NOT IN (SELECT doc_id FROM co)")
def merged_plan(spark, sf_dir):
    return P.merged(plan_steps_of(spark, sf_dir)).select("doc_id", "step_id", F.col("order").alias("place"))


_COUNT = "CASE WHEN pa.t IS NULL OR st.k > 3 THEN NULL ELSE length(pa.t[st.k + 1]) - length(replace(pa.t[st.k + 1], old_string, '')) END"


@query("plan_validation", f"""
WITH {_STEPS}, {_PARAS}, v AS (SELECT st.*, {_COUNT} AS n FROM st LEFT JOIN pa USING (doc_id))
SELECT doc_id, step_id, 'unknown operation' AS error FROM v WHERE operation = 'dance' UNION ALL SELECT doc_id, step_id, 'unknown paragraph' FROM v WHERE k > 3
UNION ALL SELECT doc_id, step_id, 'no position' FROM v WHERE operation = 'insert_paragraph' AND position IS NULL
UNION ALL SELECT doc_id, step_id, 'old text: ' || CASE WHEN n = 0 THEN 'not_found' ELSE 'multiple' END FROM v WHERE operation = 'replace_text' AND k <= 3 AND n <> 1""")
def plan_validation(spark, sf_dir):
    return P.step_errors(plan_steps_of(spark, sf_dir), plan_paragraphs(spark, sf_dir)).select("doc_id", "step_id", F.explode("errors").alias("error"))


_AT_K = "CASE k WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 END"
_PUT = ", ".join(f"CASE WHEN why IS NULL AND operation = 'replace_text' AND k = {n} THEN replace(t{n}, old_string, new_string) ELSE t{n} END AS t{n}" for n in range(4))


@query("plan_apply", f"""
WITH RECURSIVE {_STEPS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY plan_index, step_index) AS i FROM st),
run AS (SELECT c_custkey AS doc_id, c_name AS t0, c_mktsegment AS t1, '-' || c_mktsegment AS t2, c_name || '#' || c_mktsegment AS t3, CAST(0 AS BIGINT) AS done, CAST(NULL AS VARCHAR) AS failed, CAST(NULL AS VARCHAR) AS reason FROM customer
  UNION ALL SELECT doc_id, {_PUT}, CASE WHEN why IS NULL THEN done + 1 ELSE done END, CASE WHEN why IS NOT NULL THEN step_id END, why FROM (
    SELECT run.doc_id, run.t0, run.t1, run.t2, run.t3, run.done, o.k, o.operation, o.old_string, o.new_string, o.step_id, CASE WHEN o.operation = 'dance' THEN 'unknown operation' WHEN o.k > 3 THEN 'unknown paragraph' WHEN o.operation = 'insert_paragraph' AND o.position IS NULL THEN 'no position'
      WHEN o.operation = 'replace_text' AND length({_AT_K}) - length(replace({_AT_K}, o.old_string, '')) <> 1 THEN 'old text does not match once' END AS why FROM run JOIN o ON o.doc_id = run.doc_id AND o.i = run.done + 1 WHERE run.failed IS NULL)),
last AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY done DESC, failed IS NOT NULL DESC) AS r FROM run),
fin AS (SELECT * FROM last WHERE r = 1),
ins AS (SELECT o.doc_id, o.k, CASE o.position WHEN 'BEFORE' THEN 0 ELSE 2 END AS side, CASE o.position WHEN 'BEFORE' THEN o.i ELSE -o.i END AS place, o.plan_index FROM o JOIN fin ON fin.doc_id = o.doc_id WHERE o.i <= fin.done AND o.operation = 'insert_paragraph'),
li AS (SELECT doc_id, k, side, place, 1 AS part, 'new ' || plan_index AS text FROM ins UNION ALL SELECT doc_id, k, side, place, 2, 'more' FROM ins
  UNION ALL SELECT doc_id, 0, 1, 0, 0, t0 FROM fin UNION ALL SELECT doc_id, 1, 1, 0, 0, t1 FROM fin UNION ALL SELECT doc_id, 2, 1, 0, 0, t2 FROM fin UNION ALL SELECT doc_id, 3, 1, 0, 0, t3 FROM fin),
tx AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY k, side, place, part) AS text FROM li GROUP BY doc_id)
SELECT tx.doc_id, tx.text, CAST(fin.done AS INTEGER) AS completed, fin.failed AS failed_step, fin.reason AS error FROM tx JOIN fin ON fin.doc_id = tx.doc_id""")
def plan_apply(spark, sf_dir):
    out = P.applied(plan_steps_of(spark, sf_dir), plan_paragraphs(spark, sf_dir))
    return out.select("doc_id", F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n").alias("text"), "completed", "failed_step", "error")


@query("plan_init", "SELECT c_custkey, 'plan_' || left(sha1(c_name || ':' || c_nationkey), 12) AS plan_context_id, c_nationkey AS base_revision FROM customer")
def plan_init(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("revision"))
    return P.opened(rows).select("c_custkey", "plan_context_id", "base_revision")


# Archives and reports.


def _archives(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.split("text", "\n").alias("paragraphs"))
    return A.packed(A.document_xml(docs))


@query("archive_round_trip", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, para_idx, text FROM {PARAGRAPHS}")
def archive_round_trip(spark, sf_dir):
    return A.paragraphs(A.entries(_archives(spark, sf_dir))).select("doc_id", "para_idx", F.coalesce("text", F.lit("")).alias("text"))


@query("archive_parts", """
SELECT CAST(doc_id AS VARCHAR) || '.docx' AS doc_id, 'meta/source.txt' AS part_uri, CAST(octet_length(encode(source)) AS BIGINT) AS uncompressed_bytes, source AS text FROM documents WHERE source IS NOT NULL
UNION ALL SELECT CAST(doc_id AS VARCHAR) || '.docx', 'meta/lang.txt', CAST(octet_length(encode(lang)) AS BIGINT), lang FROM documents WHERE lang IS NOT NULL""")
def archive_parts(spark, sf_dir):
    """Documents as files of three entries in the shared folder; two of them are read, and their texts stay on disk."""
    docs = corpus.table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("doc_id"), "source", "lang", "text")
    parts = F.array(*[F.struct(F.lit(u).alias("part_uri"), F.encode(c, "utf-8").alias("content")) for u, c in (("meta/source.txt", "source"), ("meta/lang.txt", "lang"), ("word/text.txt", "text"))])
    files = A.packed(docs.select("doc_id", F.inline(F.filter(parts, lambda p: p["content"].isNotNull()))))
    register(spark)
    folder = f"{shared_folder(spark)}/archives-{uuid4().hex}"
    files.write.format("archives").mode("append").save(folder)
    rows = spark.read.format("archives").load(folder).where(F.startswith("part_uri", F.lit("meta/")))
    return rows.select("doc_id", "part_uri", "uncompressed_bytes", F.decode("content", "utf-8").alias("text"))


@query("archive_guard", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS entries FROM documents")
def archive_guard(spark, sf_dir):
    return A.guarded(A.entries(_archives(spark, sf_dir), with_content=False)).where("violation IS NULL OR violation IS NOT NULL").select("doc_id", "entries")


#: Line items as entries of one archive a part: sizes by price, directories none.
_ENTRIES = "l_partkey AS k, 'f' || l_orderkey AS part_uri, CAST(l_quantity AS BIGINT) AS packed, CAST(floor(l_extendedprice * l_quantity * CASE WHEN l_discount > 0.09 THEN 20 ELSE 0.002 END) AS BIGINT) AS size"


@query("archive_limits", f"""
WITH e AS (SELECT {_ENTRIES} FROM lineitem)
SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN count(*) > 2000 THEN 'too many entries' WHEN max(size) > 52428800 THEN 'entry too large' WHEN sum(size) > 209715200 THEN 'archive too large' WHEN max(size / greatest(packed, 1)) > 200 THEN 'compression ratio too high' END AS violation FROM e GROUP BY k""")
def archive_limits(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS k", "'f' || l_orderkey AS part_uri", "CAST(l_quantity AS BIGINT) AS compressed_bytes", "CAST(floor(l_extendedprice * l_quantity * CASE WHEN l_discount > 0.09D THEN 20D ELSE 0.002D END) AS BIGINT) AS uncompressed_bytes")
    return A.guarded(rows.select(F.col("k").cast("string").alias("doc_id"), "part_uri", F.lit(False).alias("is_directory"), "compressed_bytes", "uncompressed_bytes")).select("doc_id", "violation")


@query("part_manifest", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'word/document.xml' AS part_uri FROM documents")
def part_manifest(spark, sf_dir):
    return A.manifest(A.entries(_archives(spark, sf_dir))).select("doc_id", "part_uri")


@query("document_text", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha1(text) AS hash FROM documents")
def document_text(spark, sf_dir):
    return A.document_text(A.paragraphs(A.entries(_archives(spark, sf_dir)))).select("doc_id", F.sha1("text").alias("hash"))


@query("missing_part", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'missing part: word/styles.xml' AS error FROM documents")
def missing_part(spark, sf_dir):
    return A.part(A.entries(_archives(spark, sf_dir)), A.PARTS[1]).select("doc_id", "error")


#: Paragraphs as lines of one markdown file a document: every fifth a heading, the others rows of a table or text.
_MARKDOWN = "CASE WHEN para_idx % 5 = 0 THEN '## ' || left(text, 20) WHEN length(text) % 7 = 0 THEN '| --- | --- |' WHEN length(text) % 2 = 0 THEN '| ' || replace(left(text, 15), '|', '') || ' | ' || length(text) || ' |' ELSE text END"


@query("markdown_rows", rf"""
WITH l AS (SELECT doc_id, para_idx, {_MARKDOWN} AS line FROM {PARAGRAPHS}),
h AS (SELECT *, last_value(nullif(regexp_extract(line, '^#+\s+(.*)$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS heading FROM l)
SELECT CAST(doc_id AS VARCHAR) AS file, para_idx AS line_no, heading, trim(string_split(regexp_replace(line, '^\s*\||\|\s*$', '', 'g'), '|')[1]) AS first FROM h WHERE regexp_matches(line, '^\s*\|.*\|\s*$') AND NOT regexp_matches(line, '^[\s|:-]+$')""")
def markdown_rows(spark, sf_dir):
    lines = corpus.paragraphs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.col("para_idx").alias("line_no"), F.expr(_MARKDOWN).alias("line"))
    return reports.markdown_rows(lines).select("file", "line_no", "heading", F.get("cells", F.lit(0)).alias("first"))


@query("markdown_report", "SELECT '| role | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || role || ' | ' || n || ' |', chr(10) ORDER BY role) AS report FROM (SELECT role, count(*) AS n FROM conversations GROUP BY role)")
def markdown_report(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    return reports.markdown_report(rows, ["role", "n"], "role")


@query("missing_files", "SELECT DISTINCT split_part(name, '/', 1) AS folder, name FROM (SELECT o_orderstatus || '/' || o_custkey AS name FROM orders) WHERE name NOT IN (SELECT 'F/' || c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_files(spark, sf_dir):
    manifest = corpus.table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderstatus", F.col("o_custkey").cast("string")).alias("name")).distinct()
    files = corpus.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("F/"), F.col("c_custkey").cast("string")).alias("name"))
    return reports.missing_files(manifest, files).select(F.split_part("name", F.lit("/"), F.lit(1)).alias("folder"), "name")
