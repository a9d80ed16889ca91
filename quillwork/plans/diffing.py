"""Character-level differences, fields and numbered atoms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chars as C
from ..registry import query
from ..sources import corpus
from .ordering import FIELDS, fields
from .sql import PARAGRAPHS


def _neighbours(spark, sf_dir):
    """Each benchmark item and the next one."""
    rows = corpus.table(spark, sf_dir, "benchmark")
    return rows.join(rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after")), "item_id")


@query("char_diff_round_trip", "SELECT a.item_id, a.text AS before_text, b.text AS after_text, TRUE AS adds_up FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def char_diff_round_trip(spark, sf_dir):
    rows = C.spread(_neighbours(spark, sf_dir)).withColumn("ops", C.diff_ops("text", "after")).withColumn("n", C.change_counts(F.col("ops")))
    adds_up = (F.col("n.equal") + F.col("n.deleted") == F.length("text")) & (F.col("n.equal") + F.col("n.inserted") == F.length("after"))
    return rows.select("item_id", C.rebuilt(F.col("ops"), C.DELETE).alias("before_text"), C.rebuilt(F.col("ops"), C.INSERT).alias("after_text"), adds_up.alias("adds_up"))


_EDITED = "CASE p_size % 3 WHEN 0 THEN left(p_name, 4) || '#' || substr(p_name, 6) WHEN 1 THEN left(p_name, 4) || '##' || substr(p_name, 5) ELSE left(p_name, 4) || substr(p_name, 6) END"


@query("char_diffs", """
SELECT p_partkey, '=' || left(p_name, 4) || CASE p_size % 3 WHEN 0 THEN ' -' || substr(p_name, 5, 1) || ' +#' WHEN 1 THEN ' +##' ELSE ' -' || CASE WHEN substr(p_name, 4, 1) = substr(p_name, 5, 1) THEN '' ELSE substr(p_name, 5, 1) END END || ' =' || substr(p_name, CASE p_size % 3 WHEN 1 THEN 5 ELSE 6 END) AS ops
FROM part WHERE p_size % 3 < 2
UNION ALL SELECT p_partkey, '-' || (length(p_name) - length(replace(left(p_name, 4) || substr(p_name, 6), '#', ''))) AS ops FROM part WHERE p_size % 3 = 2""")
def char_diffs(spark, sf_dir):
    """Names of parts against names with a letter replaced, two signs put in, or a letter less.

    Which of two equal letters was taken out cannot be told, so there only their number is.
    """
    signs = F.create_map(F.lit(-1), F.lit("-"), F.lit(0), F.lit("="), F.lit(1), F.lit("+"))
    rows = C.spread(corpus.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).withColumn("edited", F.expr(_EDITED)).withColumn("o", C.diff_ops("p_name", "edited"))
    told = F.array_join(F.transform("o", lambda x: F.concat(F.element_at(signs, x["op"]), x["text"])), " ")
    return rows.select("p_partkey", F.when(F.col("p_size") % 3 < 2, told).otherwise(F.concat(F.lit("-"), C.change_counts(F.col("o"))["deleted"].cast("string"))).alias("ops"))


@query("collapsed_fields", f"""
WITH {FIELDS},
i AS (SELECT *, depth > 0 OR lag(depth, 1, 0) OVER w > 0 AS inside, CASE WHEN depth = 1 AND lag(depth, 1, 0) OVER w = 0 THEN 1 ELSE 0 END AS opens FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY turn)),
f AS (SELECT *, CASE WHEN inside THEN sum(opens) OVER (PARTITION BY doc_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS field FROM i),
s AS (SELECT *, max(CASE WHEN mark = 'separate' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, field ORDER BY turn ROWS UNBOUNDED PRECEDING) AS separated FROM f)
SELECT doc_id, min(turn) AS turn, string_agg(CASE WHEN mark IS NULL AND (NOT inside OR separated = 1) THEN text ELSE '' END, '' ORDER BY turn) AS text, bool_or(inside) AS is_field FROM s GROUP BY doc_id, field, CASE WHEN NOT inside THEN turn END""")
def collapsed_fields(spark, sf_dir):
    return C.collapsed_fields(fields(spark, sf_dir), ["doc_id"], "turn").select("doc_id", "turn", "text", "is_field")


@query("numbered_hashes", f"SELECT doc_id, para_idx, sha1(CASE WHEN para_idx % 2 = 0 THEN '(' || para_idx || '):' || text ELSE text END) AS hash FROM {PARAGRAPHS}")
def numbered_hashes(spark, sf_dir):
    rows = corpus.paragraphs(spark, sf_dir).select("doc_id", "para_idx", F.lit(0).alias("atom_idx"), "text")
    labels = rows.where("para_idx % 2 = 0").select("doc_id", "para_idx", F.concat(F.lit("("), F.col("para_idx").cast("string"), F.lit(")")).alias("label"))
    return C.numbered_hashes(rows, labels).select("doc_id", "para_idx", "hash")
