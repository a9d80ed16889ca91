"""Checks of whole documents, put together from the rules of single relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered, relations


def validated(starts: DataFrame, ends: DataFrame, wrappers: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, rule, subject): all warnings of documents, from bookmarks, revision wrappers and fields.

    ``starts`` and ``ends``: doc_id, name of bookmarks; ``wrappers``: doc_id, wrapper_idx,
    id, author, date, children; ``marks``: doc_id, mark_idx, mark of fields.
    """
    lone = relations.unmatched(starts, ends, ["doc_id", "name"]).select("doc_id", F.concat(F.lit("bookmark without "), F.when(F.col("side") == "start", "end").otherwise("start")).alias("rule"), F.col("name").cast("string").alias("subject"))
    poor = relations.wrapper_errors(wrappers).select("doc_id", F.concat(F.lit("wrapper "), F.col("warning")).alias("rule"), F.col("wrapper_idx").cast("string").alias("subject"))
    wrong = ordered.field_errors(marks, ["doc_id"], "mark_idx")
    rules = F.array_compact(F.array(F.when(F.col("excess_ends") > 0, F.struct(F.lit("field ends too often").alias("rule"), F.col("excess_ends").cast("string").alias("subject"))), F.when(F.col("open_at_end") > 0, F.struct(F.lit("field does not end").alias("rule"), F.col("open_at_end").cast("string").alias("subject")))))
    return reduce(DataFrame.unionByName, [lone, poor, wrong.select("doc_id", F.explode(rules).alias("x")).select("doc_id", "x.rule", "x.subject")])


def structural_gate(documents: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(doc_id, passed, kinds): a document fails if any diagnostic (doc_id, kind) tells something of it; kinds are sorted."""
    found = diagnostics.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    rows = documents.select("doc_id").distinct().join(found, "doc_id", "left")
    return rows.select("doc_id", F.col("kinds").isNull().alias("passed"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def score_extras(atoms: DataFrame) -> DataFrame:
    """(pair_id, has_moves, edits_in_cells) of atoms (pair_id, status, in_table)."""
    moved = F.col("status").isin("MovedSource", "MovedDestination")
    return atoms.groupBy("pair_id").agg(F.bool_or(moved).alias("has_moves"), F.bool_or((F.col("status") != "Equal") & F.col("in_table")).alias("edits_in_cells"))


def mismatches(pairs: DataFrame, a: str = "found", b: str = "wanted") -> DataFrame:
    """(pair_id, para_idx, found, wanted) of every paragraph in which two texts differ; null where a text has no such paragraph."""
    both = F.arrays_zip(F.split(F.col(a), "\n").alias("x"), F.split(F.col(b), "\n").alias("y"))
    rows = pairs.select("pair_id", F.posexplode(both).alias("para_idx", "z"))
    return rows.where(~F.col("z.x").eqNullSafe(F.col("z.y"))).select("pair_id", "para_idx", F.col("z.x").alias(a), F.col("z.y").alias(b))


def mismatch_summary(found: DataFrame) -> DataFrame:
    """(pair_id, paragraphs, first) of the rows of ``mismatches``."""
    return found.groupBy("pair_id").agg(F.count("*").alias("paragraphs"), F.min("para_idx").alias("first"))


def only_nodes(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose node is among those wanted; repeated wishes give no repeated rows."""
    return rows.join(wanted.select(*key).distinct(), key, "left_semi")


def allowed_path(path: Column, *roots: str) -> Column:
    """Whether a path, its ``.`` and ``..`` resolved, lies in one of these folders; one that climbs above its start does not."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))
    walk = F.aggregate(
        steps,
        start,
        lambda a, s: F.struct(
            F.when(s == "..", F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0)))).otherwise(F.array_append(a["at"], s)).alias("at"),
            (a["ok"] & ((s != "..") | (F.size(a["at"]) > 0))).alias("ok"),
        ),
    )
    whole = F.concat(F.lit("/"), F.array_join(walk["at"], "/"), F.lit("/"))
    inside = reduce(lambda x, y: x | y, [F.startswith(whole, F.lit(r.rstrip("/") + "/")) for r in roots], F.lit(False))
    return F.coalesce(walk["ok"] & F.startswith(path, F.lit("/")) & inside, F.lit(False))
