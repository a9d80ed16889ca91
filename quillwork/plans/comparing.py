"""Comparison of document pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import alignment as G
from ..operators import edits as E
from ..operators import groups
from ..registry import query
from ..sources import archives as A
from ..sources import corpus

_PAIRS = """pairs AS (SELECT doc_id AS pair_id, prev AS original_id FROM
  (SELECT doc_id, lag(doc_id) OVER (PARTITION BY sha1(string_split(text, chr(10))[1]) ORDER BY doc_id) AS prev FROM documents) WHERE prev IS NOT NULL)"""


def pairs(spark, sf_dir) -> DataFrame:
    """Each document and the one before it with the same first line: (pair_id, original, revised) paragraphs."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    heads = docs.select("doc_id", F.sha1(F.get(F.split("text", "\n"), F.lit(0))).alias("head"))
    before = heads.select("doc_id", F.lag("doc_id").over(Window.partitionBy("head").orderBy("doc_id")).alias("original_id")).where("original_id is not null")
    # either side is the same shuffle of the texts, which is made once; they are cut into paragraphs behind it
    own, old = (docs.select(F.col("doc_id").alias(i), F.col("text").alias(t)) for i, t in (("pair_id", "revised"), ("original_id", "original")))
    found = before.withColumnRenamed("doc_id", "pair_id").join(own, "pair_id").join(old, "original_id")
    return found.select("pair_id", "original_id", *[F.split(t, "\n").alias(t) for t in ("original", "revised")])


@query("document_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def document_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", "original_id")


@query("token_lcs")
def token_lcs(spark, sf_dir):
    atoms = G.compare_pairs(pairs(spark, sf_dir), joined=G.STATUSES)
    return atoms.where("status = 'Equal'").groupBy("pair_id").agg(F.sum("tokens").alias("matches"))


@query("hierarchical_diff_stats")
def hierarchical_diff_stats(spark, sf_dir):
    atoms = G.compare_pairs(pairs(spark, sf_dir)).withColumn("para_idx", F.coalesce(F.nullif("rev_para", F.lit(-1)), -F.col("orig_para") - 1))
    return groups.change_stats(atoms, ["pair_id"])


@query("round_trip_ok", f"WITH {_PAIRS} SELECT pair_id, TRUE AS accepts, TRUE AS rejects FROM pairs")
def round_trip_ok(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return G.round_trip(G.compare_pairs(rows, joined=G.STATUSES), rows)


@query("accepted_text", f"WITH {_PAIRS} SELECT pair_id, sha1(text) AS hash FROM pairs JOIN documents ON doc_id = pair_id")
def accepted_text(spark, sf_dir):
    return G.side_text(E.accept_all(G.compare_pairs(pairs(spark, sf_dir), joined=G.STATUSES)), True).select("pair_id", F.sha1("text").alias("hash"))


@query("rejected_text", f"WITH {_PAIRS} SELECT pair_id, sha1(text) AS hash FROM pairs JOIN documents ON doc_id = original_id")
def rejected_text(spark, sf_dir):
    return G.side_text(E.reject_all(G.compare_pairs(pairs(spark, sf_dir), joined=G.STATUSES)), False).select("pair_id", F.sha1("text").alias("hash"))


@query("self_compare", "SELECT doc_id AS pair_id, CAST(0 AS BIGINT) AS changes FROM documents")
def self_compare(spark, sf_dir):
    lines = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.split("text", "\n").alias("original")).withColumn("revised", F.col("original"))
    return G.compare_pairs(lines, joined=G.STATUSES).groupBy("pair_id").agg(F.sum(F.when(F.col("status") != "Equal", F.col("tokens")).otherwise(0)).alias("changes"))


def _moved(spark, sf_dir) -> DataFrame:
    """All paragraphs of each document, where every third moves from the end of the one two before to the end of the one before.

    A document of one or two paragraphs has nothing that moves and is compared with itself.
    """
    lines = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.split("text", "\n").alias("l"))
    at = lambda i: F.get("l", i)
    taken = lambda i, by: F.when((i % 3 == 2 - by) & (i + by < F.size("l")), F.concat(at(i), F.lit(" "), at(i + by)))
    side = lambda by: F.filter(F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.when((i % 3 == 2), F.lit(None)).otherwise(F.coalesce(taken(i, by), at(i)))), lambda x: x.isNotNull())
    return lines.where("l is not null").select("pair_id", side(2).alias("original"), side(1).alias("revised"))


@query("moves")
def moves(spark, sf_dir):
    return G.move_ids(G.pair_moves(_moved(spark, sf_dir)))


@query("moved_atoms")
def moved_atoms(spark, sf_dir):
    return G.compare_with_moves(_moved(spark, sf_dir)).groupBy("pair_id", "status").agg(F.sum("tokens").alias("n"))


@query("revision_extract")
def revision_extract(spark, sf_dir):
    return G.pair_revisions(pairs(spark, sf_dir), 0, 50).select("pair_id", "para_key", "kind", "before", "after", "entries")


@query("format_changes", "SELECT item_id, ['bold'] AS names FROM benchmark WHERE item_id % 2 = 0")
def format_changes(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.lit("Equal").alias("status"), F.create_map(F.lit("w:b"), F.when(F.col("item_id") % 2 == 0, "1").otherwise("0")).alias("old_props"), F.create_map(F.lit("w:b"), F.lit("0")).alias("new_props"))
    return G.format_changes(rows).select("item_id", "names")


@query("word_jaccard_pairs", rf"""WITH {_PAIRS},
s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM documents)
SELECT pair_id, round(CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS similarity
FROM pairs JOIN s a ON a.doc_id = pair_id JOIN s b ON b.doc_id = original_id""")
def word_jaccard_pairs(spark, sf_dir):
    text = lambda c: F.array_join(c, "\n")
    return pairs(spark, sf_dir).select("pair_id", F.round(X.jaccard(text("revised"), text("original")), 6).alias("similarity"))


@query("similar_texts", r"""
WITH s AS (SELECT list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS w, min(item_id) AS id FROM benchmark GROUP BY 1)
SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared FROM s a JOIN s b ON a.id < b.id WHERE len(list_intersect(a.w, b.w))   >= 0.12 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""")
def similar_texts(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return G.candidate_pairs(rows, 0.12).select("a", "b", "shared")


@query("best_similar", r"""
WITH s AS (SELECT list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS w, min(item_id) AS id FROM benchmark GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM s a JOIN s b ON a.id < b.id)
SELECT a, arg_max(b, round(i / u, 9) * 1000000 - b * 0.000001) AS b, round(max(i / u), 6) AS score FROM p WHERE i >= 0.12 * u GROUP BY a""")
def best_similar(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = G.best_match(G.candidate_pairs(rows, 0.12), "a", "b", F.col("shared") / F.col("total"))
    return found.select("a", "b", F.round("score", 6).alias("score"))


def _items(spark, sf_dir) -> DataFrame:
    return corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


@query("word_set_classes")
def word_set_classes(spark, sf_dir):
    """The class of each item; ``similar_texts`` has pairs of their representatives."""
    return G.word_set_classes(_items(spark, sf_dir))


@query("class_links")
def class_links(spark, sf_dir):
    """Different items with the same words, which ``similar_texts`` folds."""
    return G.class_links(_items(spark, sf_dir))


@query("best_partners")
def best_partners(spark, sf_dir):
    """The best partner of each item on either side; ``best_similar`` and its SQL look at greater ids only."""
    return G.best_partners(_items(spark, sf_dir), 0.12).select("id", "partner", F.round("score", 6).alias("score"))


@query("similar_documents")
def similar_documents(spark, sf_dir):
    """Benchmark items against documents."""
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return G.similar_across(_items(spark, sf_dir), docs, 0.12).select(F.col("item").alias("item_id"), F.col("id").alias("doc_id"), "shared", "total")


@query("tracked_markup", f"WITH {_PAIRS} SELECT CAST(pair_id AS VARCHAR) AS doc_id, TRUE AS same FROM pairs")
def tracked_markup(spark, sf_dir):
    """The markup of each comparison, parsed again: what it keeps when accepted is the revision."""
    rows = pairs(spark, sf_dir)
    atoms = G.compare_pairs(rows, joined=G.STATUSES).select(F.col("pair_id").cast("string").alias("doc_id"), F.coalesce(F.nullif("rev_para", F.lit(-1)), F.lit(-1) - F.col("orig_para")).alias("para_idx"), "atom_idx", "status", "text")
    files = A.tracked_xml(atoms, "reviewer", "2020-01-01T00:00:00Z")
    runs = A.runs(files).where("coalesce(rev_tag, '') <> 'del'")
    texts = runs.groupBy("doc_id", "para_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_idx", "text"))), lambda x: x["text"]), "").alias("t"))
    found = texts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "t"))), lambda x: x["t"]), "").alias("t"))
    want = rows.select(F.col("pair_id").cast("string").alias("doc_id"), F.array_join("revised", "").alias("w"))
    return want.join(found, "doc_id", "left").select("doc_id", (F.coalesce("t", F.lit("")) == F.col("w")).alias("same"))
