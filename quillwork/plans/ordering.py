"""Islands, running state, counters and offsets over ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..registry import query
from ..sources import corpus
from .sql import PARAGRAPHS

_ATOMS = "atoms AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'Deleted' WHEN 'assistant' THEN CASE WHEN length(text) % 2 = 0 THEN 'Deleted' ELSE 'Inserted' END ELSE 'Equal' END AS status FROM conversations)"


def atoms(spark, sf_dir):
    """Turns as atoms with a status by role and length."""
    turns = corpus.table(spark, sf_dir, "conversations")
    status = F.when(F.col("role") == "user", "Deleted").when(F.col("role") == "assistant", F.when(F.length("text") % 2 == 0, "Deleted").otherwise("Inserted")).otherwise("Equal")
    return turns.select("conv_id", "turn", "text", status.alias("status"))


_ISLANDS = f"WITH {_ATOMS}, i AS (SELECT *, sum(CASE WHEN status IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, lag(status) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM atoms))"


@query("status_islands", _ISLANDS + " SELECT conv_id, turn, CAST(island AS BIGINT) AS island FROM i")
def status_islands(spark, sf_dir):
    return O.islands(atoms(spark, sf_dir), ["conv_id"], "turn", ["status"]).select("conv_id", "turn", "island")


@query("status_blocks", _ISLANDS + r""" SELECT conv_id, min(turn) AS turn, status, string_agg(text, '' ORDER BY turn) AS text, count(*) AS runs,
 CAST(len(list_filter(regexp_split_to_array(string_agg(text, '' ORDER BY turn), '\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM i WHERE status <> 'Equal' GROUP BY conv_id, island, status""")
def status_blocks(spark, sf_dir):
    return O.status_blocks(atoms(spark, sf_dir), ["conv_id"], "turn")


@query("deletions_first", f"""WITH {_ATOMS}, c AS (SELECT *, status <> 'Equal' AS ch FROM atoms),
b AS (SELECT *, sum(CASE WHEN ch IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS blk FROM (SELECT *, lag(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c))
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY blk, CASE WHEN ch AND status = 'Inserted' THEN 1 ELSE 0 END, turn) AS INTEGER) AS place FROM b""")
def deletions_first(spark, sf_dir):
    return O.deletions_first(atoms(spark, sf_dir), ["conv_id"], "turn").select("conv_id", "turn", "place")


@query("noop_pairs", f"""WITH {_ATOMS}, l AS (SELECT conv_id, turn, status, length(text) % 3 AS k, lead(status) OVER w AS ns, lead(length(text) % 3) OVER w AS nk, lag(status) OVER w AS ps, lag(length(text) % 3) OVER w AS pk FROM atoms WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn FROM l WHERE NOT coalesce(status = 'Deleted' AND ns = 'Inserted' AND k = nk, FALSE) AND NOT coalesce(ps = 'Deleted' AND status = 'Inserted' AND k = pk, FALSE)""")
def noop_pairs(spark, sf_dir):
    rows = atoms(spark, sf_dir).withColumns({"runs": F.lit(1), "rpr_hash": F.lit("x"), "content_hash": F.length("text") % 3})
    return O.without_noops(rows, ["conv_id"], "turn").select("conv_id", "turn")


_CHANGES = "CASE event_type WHEN 'view' THEN 'Deleted' WHEN 'click' THEN 'Inserted' ELSE 'Equal' END"


@query("blank_on_both_sides", f"""
WITH a AS (SELECT user_id, event_id, {_CHANGES} AS status, value < 30 AS blank FROM events),
l AS (SELECT *, lag(status) OVER w AS p, lead(status) OVER w AS n FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS doc_id, event_id AS turn, unnest(CASE WHEN status = 'Equal' AND blank AND p <> 'Equal' AND n <> 'Equal' THEN ['Deleted', 'Inserted'] ELSE [status] END) AS status FROM l""")
def blank_on_both_sides(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("turn"), F.expr(_CHANGES).alias("status"), F.when(F.col("value") < 30, " ").otherwise("x").alias("text"))
    return O.blank_on_both_sides(rows, ["doc_id"], "turn").select("doc_id", "turn", "status")


_KINDS = "CASE event_type WHEN 'view' THEN 'ins' WHEN 'click' THEN 'del' WHEN 'error' THEN 'moveTo' ELSE 'text' END"


@query("bridged_wrappers", f"""
WITH a AS (SELECT user_id, event_id, {_KINDS} AS k, CASE WHEN {_KINDS} <> 'text' THEN 'a' || length(props) END AS a, value < 60 AS blank FROM events),
l AS (SELECT *, lag(k) OVER w AS pk, lag(a) OVER w AS pa, lead(k) OVER w AS nk, lead(a) OVER w AS na FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, coalesce(k = 'text' AND blank AND pk IN ('ins', 'moveTo') AND pk = nk AND pa = na, FALSE) AS inside FROM l),
c AS (SELECT user_id, event_id, CASE WHEN inside THEN pk ELSE k END AS k, CASE WHEN inside THEN pa ELSE a END AS a FROM b),
d AS (SELECT *, k IS DISTINCT FROM lag(k) OVER w OR a IS DISTINCT FROM lag(a) OVER w AS opens FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS doc_id, event_id AS turn, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS wrapper FROM d""")
def bridged_wrappers(spark, sf_dir):
    kind = F.expr(_KINDS)
    rows = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("turn"), kind.alias("kind"), F.when(kind != "text", F.concat(F.lit("a"), F.length("props").cast("string"))).alias("author"), F.lit("d").alias("date"), F.when(F.col("value") < 60, " ").otherwise("x").alias("text"))
    return O.bridged(rows, ["doc_id"], "turn").select("doc_id", "turn", "wrapper")


@query("punctuation_attached", r"""
WITH t AS (SELECT item_id, unnest(range(0, len(w))) AS i, unnest(w) AS text FROM (SELECT item_id, regexp_extract_all(text, '[[:alnum:]\x{00C0}-\x{024F}]+|[[:punct:]]+') AS w FROM benchmark)),
g AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^[[:punct:]]+$') AND i > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY i) AS k FROM t)
SELECT item_id, CAST(min(i) AS INTEGER) AS i, string_agg(text, '' ORDER BY i) AS text FROM g GROUP BY item_id, k""")
def punctuation_attached(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"([\p{Alnum}\x{00C0}-\x{024F}]+|\p{Punct}+)"), 1)
    rows = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(found).alias("i", "text")).withColumns({"rev_tag": F.lit("x"), "rpr_hash": F.lit("y")})
    return O.punctuation_attached(rows, ["item_id"], "i").select("item_id", "i", "text")


_MARK = "CASE event_type WHEN 'signup' THEN 'begin' WHEN 'click' THEN 'separate' WHEN 'error' THEN 'end' END"
#: Rows of the events of each user as the marks of nested fields, with the running depth of each.
FIELDS = f"""m AS (SELECT user_id AS doc_id, event_id AS turn, {_MARK} AS mark, CASE WHEN {_MARK} IS NULL THEN event_type || ' ' ELSE '' END AS text FROM events),
r AS (SELECT *, sum(CASE mark WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER w AS raw, last_value(mark IGNORE NULLS) OVER w AS state FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, raw - least(min(raw) OVER w, 0) AS depth, coalesce(mark = 'end', FALSE) AND raw < coalesce(least(min(raw) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS excess
  FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


def fields(spark, sf_dir):
    """Events as marks and texts of nested fields."""
    return corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("turn"), F.expr(_MARK).alias("mark"), F.expr(f"CASE WHEN {_MARK} IS NULL THEN event_type || ' ' ELSE '' END").alias("text"))


@query("visible_runs", f"WITH {FIELDS} SELECT doc_id, turn, text, depth > 0 AS is_field_result FROM d WHERE mark IS NULL AND NOT (depth > 0 AND coalesce(state = 'begin', FALSE))")
def visible_runs(spark, sf_dir):
    return O.visible_runs(fields(spark, sf_dir), ["doc_id"], "turn").select("doc_id", "turn", "text", "is_field_result")


@query("field_errors", f"""
WITH {FIELDS}, e AS (SELECT doc_id, count(*) FILTER (excess) AS excess_ends, CAST(arg_max(depth, turn) AS BIGINT) AS open_at_end FROM d GROUP BY doc_id)
SELECT * FROM e WHERE excess_ends > 0 OR open_at_end > 0""")
def field_errors(spark, sf_dir):
    return O.field_errors(fields(spark, sf_dir), ["doc_id"], "turn")


@query("empty_context", f"""
WITH p AS (SELECT doc_id, para_idx, CASE WHEN para_idx % 3 = 1 THEN '' ELSE text END AS text FROM {PARAGRAPHS}),
f AS (SELECT *, regexp_matches(text, '\\S') AS ok FROM p),
b AS (SELECT *, last_value(CASE WHEN ok THEN sha1(text) END IGNORE NULLS) OVER w AS prev, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS blk FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, blk ORDER BY para_idx) - CASE WHEN blk > 0 THEN 1 ELSE 0 END AS k FROM b)
SELECT doc_id, para_idx, CASE WHEN ok THEN sha1(text) ELSE sha1(coalesce(prev, '') || '|' || k) END AS context_hash FROM r""")
def empty_context(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", F.when(F.col("para_idx") % 3 == 1, "").otherwise(F.col("text")).alias("text"))
    return O.empty_context(rows).select("doc_id", "para_idx", "context_hash")


@query("note_numbers", """
WITH f AS (SELECT conv_id, length(text) % 5 AS note, min(turn) AS first_ref FROM conversations WHERE length(text) % 5 > 1 GROUP BY ALL)
SELECT conv_id, CAST(note AS INTEGER) AS note, first_ref, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_ref) AS INTEGER) AS display_number FROM f""")
def note_numbers(spark, sf_dir):
    refs = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 5).cast("int").alias("note"))
    return O.first_numbers(refs, ["conv_id"], "note", "turn", F.col("note") > 1)


@query("first_appearance", """
WITH f AS (SELECT conv_id, turn, role, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations)
SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS INTEGER) AS index FROM f""")
def first_appearance(spark, sf_dir):
    return O.first_appearance(corpus.table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn").select("conv_id", "turn", "index")


@query("run_offsets", """
SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS stop, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def run_offsets(spark, sf_dir):
    return O.run_offsets(corpus.table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "start", "stop")


@query("overlap_template", """
WITH o AS (SELECT conv_id, turn, sum(length(text)) OVER w - length(text) AS a, sum(length(text)) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, least(b, 400) - greatest(a, 100) AS n FROM o)
SELECT conv_id, arg_max(turn, n * 1000 - turn) AS turn, CAST(max(n) AS BIGINT) AS overlap FROM x WHERE n > 0 GROUP BY conv_id""")
def overlap_template(spark, sf_dir):
    return O.overlap_template(corpus.table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.lit(100), F.lit(400))


@query("split_runs", """
WITH o AS (SELECT conv_id, turn, text, 300 - (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text)) AS cut FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN cut > 0 AND cut < length(text) THEN [left(text, CAST(cut AS INTEGER)), substr(text, CAST(cut AS INTEGER) + 1)] ELSE [text] END AS p FROM o)
SELECT conv_id, turn, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part, unnest(p) AS text FROM s""")
def split_runs(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return O.split_runs(rows, ["conv_id"], "turn", F.lit(300)).select("conv_id", "turn", "part", "text")


@query("marked_texts", "SELECT item_id, left(text, 3) || '[1]' || substr(text, 4, 5) || '[2]' || substr(text, 9) AS text FROM benchmark")
def marked_texts(spark, sf_dir):
    marks = F.array(F.struct(F.lit(3).alias("at"), F.lit("[1]").alias("mark")), F.struct(F.lit(8).alias("at"), F.lit("[2]").alias("mark")))
    return O.with_markers(corpus.table(spark, sf_dir, "benchmark"), marks).select("item_id", "text")


@query("run_in_headers", rf"""
WITH w AS (SELECT doc_id, para_idx, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM {PARAGRAPHS}),
f AS (SELECT *, min(CASE WHEN regexp_matches(word, '^[A-Z]') OR right(word, 1) = ',' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para_idx ORDER BY i) AS head FROM w),
g AS (SELECT doc_id, para_idx, trim(string_agg(word || ' ', '' ORDER BY i)) AS header, CAST(sum(length(word) + 1) AS BIGINT) AS chars, arg_min(length(word) % 2 = 0, i) AS italic FROM f WHERE head = 1 GROUP BY doc_id, para_idx)
SELECT * FROM g WHERE right(header, 1) IN ('.', ':', '-')""")
def run_in_headers(spark, sf_dir):
    words = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", F.posexplode(F.split("text", " ")).alias("turn", "word"))
    rows = words.select("doc_id", "para_idx", "turn", F.regexp_like("word", F.lit("^[A-Z]")).alias("bold"), (F.length("word") % 2 == 0).alias("italic"), F.endswith("word", F.lit(",")).alias("underline"), F.concat("word", F.lit(" ")).alias("text"))
    return O.run_in_header(rows, ["doc_id", "para_idx"], "turn")


@query("nearest_header", f"""
WITH p AS (SELECT doc_id, para_idx, CASE WHEN length(text) < 120 THEN para_idx END AS own FROM {PARAGRAPHS}),
n AS (SELECT doc_id, para_idx, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM p)
SELECT doc_id, para_idx, CASE WHEN para_idx - a <= 3 AND para_idx - a <= coalesce(b - para_idx, 99999) THEN a WHEN b - para_idx <= 3 THEN b END AS nearest FROM n""")
def nearest_header(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", "text")
    return O.nearest(rows, ["doc_id"], "para_idx", F.length("text") < 120, 3).select("doc_id", "para_idx", "nearest")


@query("carried_headings", f"""
SELECT doc_id, para_idx, last_value(CASE WHEN length(text) < 120 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS heading FROM {PARAGRAPHS}""")
def carried_headings(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir)
    return O.carried(rows, "para_idx", F.when(F.length("text") < 120, F.col("text")), "heading", ["doc_id"]).select("doc_id", "para_idx", "heading")


@query("merged_runs", """
WITH r AS (SELECT conv_id, turn, text, length(text) % 2 = 0 AS bold FROM conversations),
i AS (SELECT *, sum(CASE WHEN bold IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT *, lag(bold) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM r))
SELECT conv_id, min(turn) AS turn, bold, string_agg(text, '' ORDER BY turn) AS text, count(*) AS runs FROM i GROUP BY conv_id, k, bold""")
def merged_runs(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.length("text") % 2 == 0).alias("bold"))
    return O.merged_runs(rows, ["conv_id"], "turn", ["bold"])


def list_items(spark, sf_dir):
    """Paragraphs as items of one list a document, three levels deep by their length."""
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", F.lit(1).cast("long").alias("num_id"), "para_idx", (F.length("text") % 3).cast("int").alias("level"))
    return rows.withColumns({"starts": F.array(F.lit(1), F.lit(1), F.lit(1)), "formats": F.array(F.lit("decimal"), F.lit("ordinal"), F.lit("decimal")), "templates": F.array(F.lit("%1."), F.lit("%1.%2"), F.lit("%1.%2.(%3)"))})


def ordinal_sql(n: str) -> str:
    """SQL for a number with its English ending."""
    return f"({n} || CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)"


@query("list_counters", f"""
WITH i AS (SELECT doc_id, para_idx, length(text) % 3 AS level FROM {PARAGRAPHS}),
a AS (SELECT *, count(*) FILTER (level = 0) OVER w AS n0, count(*) FILTER (level <= 1) OVER w AS g1, first_value(level) OVER w AS f0 FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, n0 + CASE WHEN f0 > 0 THEN 1 ELSE 0 END AS c0,
  count(*) FILTER (level = 1) OVER s + CASE WHEN first_value(CASE WHEN level > 0 THEN level END IGNORE NULLS) OVER s = 2 THEN 1 ELSE 0 END AS c1,
  count(*) FILTER (level = 2) OVER (PARTITION BY doc_id, g1 ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS c2
  FROM a WINDOW s AS (PARTITION BY doc_id, n0 ORDER BY para_idx ROWS UNBOUNDED PRECEDING))
SELECT doc_id, para_idx, c0 || '.' || CASE WHEN level > 0 THEN {ordinal_sql('c1')} ELSE '' END || CASE WHEN level > 1 THEN '.(' || c2 || ')' ELSE '' END AS label FROM b""")
def list_counters(spark, sf_dir):
    return O.list_labels(list_items(spark, sf_dir)).select("doc_id", "para_idx", "label")


@query("flat_counters", "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS para_idx, '(' || (turn + 1) || ')' AS label FROM conversations")
def flat_counters(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).cast("long").alias("num_id"), F.col("turn").cast("int").alias("para_idx"), F.lit(0).alias("level"))
    rows = rows.withColumns({"starts": F.array(F.lit(1)), "formats": F.array(F.lit("decimal")), "templates": F.array(F.lit("(%1)"))})
    return O.list_labels(rows).select("doc_id", "para_idx", "label")
