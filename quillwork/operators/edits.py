"""Edits of document relations; each gives the relation after the edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .search import unique_match, unique_span

GONE, NEW = ("Deleted", "MovedSource"), ("Inserted", "MovedDestination")


def accept_all(atoms: DataFrame) -> DataFrame:
    """Keeps what was inserted or moved here, drops what was deleted or moved away."""
    return atoms.where(~F.col("status").isin(*GONE)).withColumn("status", F.lit("Equal"))


def reject_all(atoms: DataFrame) -> DataFrame:
    """Keeps what was deleted or moved away, drops what was inserted or moved here."""
    return atoms.where(~F.col("status").isin(*NEW)).withColumn("status", F.lit("Equal"))


def replace_unique(edits: DataFrame) -> DataFrame:
    """Replaces ``old`` by ``new`` in ``text`` where it matches once; tells status, mode and the text after.

    Only what differs between the match and its replacement counts as changed:
    ``changed_old`` and ``changed_new`` lack their common start and end. Quotes of the
    replacement take the style of the text.
    """
    settle = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))  # noqa: E731  (a value used often is computed once)
    rows = settle(edits, "found", unique_match(F.col("text"), F.col("old")))
    unique, exact = F.col("found.status") == "unique", F.col("found.mode") == "exact"
    at = F.instr("text", F.col("old")) - 1
    mapped = unique_span(F.when(unique & ~exact, F.col("text")), F.col("old"))  # only what later stages find goes to Python
    rows = rows.withColumn("__mapped", mapped)
    rows = settle(rows, "span", F.when(unique & exact, F.struct(at.alias("start"), (at + F.length("old")).alias("stop"))).when(unique, F.col("__mapped")))
    match = F.substring("text", F.col("span.start") + 1, F.col("span.stop") - F.col("span.start"))
    rows = settle(rows, "__two", F.struct(match.alias("match"), F.when(F.col("span").isNotNull(), X.in_quote_style(F.col("text"), F.col("new"))).otherwise(F.col("new")).alias("new")))
    rows = rows.withColumn("match", F.col("__two.match")).withColumn("new", F.col("__two.new"))
    rows = settle(rows, "__head", X.common_prefix(F.col("match"), F.col("new")))
    rows = settle(rows, "__tail", X.common_suffix(F.col("match"), F.col("new"), F.col("__head")))
    inner = lambda c: F.substring(c, F.col("__head") + 1, F.length(c) - F.col("__head") - F.col("__tail"))
    after = F.concat(F.substring("text", F.lit(1), F.col("span.start")), F.col("new"), F.substring("text", F.col("span.stop") + 1, F.length("text")))
    rows = rows.withColumn("changed_old", inner("match")).withColumn("changed_new", inner("new"))
    return rows.withColumn("after", F.when(F.col("span").isNotNull(), after).otherwise(F.col("text"))).withColumns({"status": F.col("found.status"), "mode": F.col("found.mode")}).drop("found", "span", "__mapped", "__two", "__head", "__tail")


def insert_paragraphs(paragraphs: DataFrame, new: DataFrame) -> DataFrame:
    """Inserts texts (doc_id, para_idx, position BEFORE or AFTER, text); a blank line begins another paragraph.

    Paragraphs are numbered anew; what is inserted takes the style of its anchor.
    """
    parts = new.select("doc_id", F.col("para_idx").alias("__at"), F.when(F.col("position") == "BEFORE", -1).otherwise(1).alias("__side"), F.posexplode(F.split("text", r"\n{2,}")).alias("__part", "text"))
    anchors = paragraphs.select("doc_id", F.col("para_idx").alias("__at"), *[c for c in paragraphs.columns if c not in ("doc_id", "para_idx", "text")])
    rows = parts.join(anchors, ["doc_id", "__at"])
    old = paragraphs.withColumnRenamed("para_idx", "__at").withColumns({"__side": F.lit(0), "__part": F.lit(0)})
    w = Window.partitionBy("doc_id").orderBy("__at", "__side", "__part")
    return old.unionByName(rows).withColumn("para_idx", (F.row_number().over(w) - 1).cast("int")).select(*paragraphs.columns)


def updated(rows: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the non-null new values, keys that no row has): paragraph spacing, row height, cell padding."""
    new = changes.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])
    return out, changes.select(*key).join(rows, key, "left_anti")


def layout_errors(changes: DataFrame) -> DataFrame:
    """Layout changes that cannot be made: a negative measure, an unknown rule, or nothing to change."""
    measures = ("before", "after", "line", "height", "padding")
    have = [c for c in measures if c in changes.columns]
    bad = [F.when(F.col(c) < 0, F.lit(f"{c} is negative")) for c in have]
    rule = [F.when(~F.col("rule").isin("auto", "exact", "atLeast"), F.lit("unknown rule"))] if "rule" in changes.columns else []
    none = F.when(F.coalesce(*[F.col(c).cast("double") for c in have]).isNull(), F.lit("nothing to change"))
    return changes.withColumn("errors", F.array_compact(F.array(*bad, *rule, none)))


def cleared(runs: DataFrame, *flags: str) -> DataFrame:
    """Runs without the formatting named: bold, italic, underline, highlight, color, font."""
    kinds = dict(runs.dtypes)
    return runs.withColumns({c: F.lit(None).cast(kinds[c]) for c in flags})


def add_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Appends notes (doc_id, text) under the next ids of each document, in the order of their text."""
    last = notes.groupBy("doc_id").agg(F.max("note_id").alias("__last"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    rows = new.withColumn("__n", rank).join(last, "doc_id", "left").withColumn("note_id", F.coalesce("__last", F.lit(0)) + F.col("__n"))
    return notes.unionByName(rows.select("doc_id", "note_id", "text"), allowMissingColumns=True)


def update_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    return updated(notes, new, ["doc_id", "note_id"], ["text"])[0]


def delete_notes(notes: DataFrame, gone: DataFrame) -> DataFrame:
    return notes.join(gone, ["doc_id", "note_id"], "left_anti")


def normalised_runs(runs: DataFrame) -> DataFrame:
    """Runs with neighbours of equal formatting merged inside their paragraph."""
    from .ordered import merged_runs

    return merged_runs(runs, ["doc_id", "para_idx"], "run_idx", ["bold", "italic", "underline"])


def clear_identities(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.drop("para_id")


def preserved_case(flag: Column) -> Column:
    """A command-line flag as a boolean: 1, true, yes and on hold."""
    return F.lower(F.trim(flag)).isin("1", "true", "yes", "on")
