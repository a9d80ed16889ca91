"""Joins over document relations: comments, notes, tables, styles, references, and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..lineage import settled


def _rounds(rows: DataFrame) -> int:
    """Doublings after which nothing but a cycle can be left of a climb within one document."""
    return int(rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0).bit_length()


def threads(comments: DataFrame) -> DataFrame:
    """Adds root_id and depth to comments (doc_id, comment_id, parent_id), by rounds of self-joins.

    A missing parent makes a comment a root. Each round doubles the distance climbed, so
    a thread of any depth takes log2 rounds. Comments whose parents lead into a cycle
    have no root: their root_id and depth are null.
    """
    known = comments.select("doc_id", F.col("comment_id").alias("parent_id"), F.lit(True).alias("__known"))
    rows = comments.join(known, ["doc_id", "parent_id"], "left")
    rows = rows.withColumn("parent_id", F.when(F.col("__known"), F.col("parent_id"))).drop("__known")
    top = rows.where("parent_id is null").select("doc_id", "comment_id", F.col("comment_id").alias("root_id"), F.lit(0).alias("depth"))
    up = rows.where("parent_id is not null").select("doc_id", "comment_id", F.col("parent_id").alias("above"), F.lit(1).alias("depth"))
    found, up = settled(top), settled(up)
    for _ in range(_rounds(comments)):
        if up.isEmpty():
            break
        at_root = found.select("doc_id", F.col("comment_id").alias("above"), "root_id", F.col("depth").alias("__more"))
        reached = up.join(at_root, ["doc_id", "above"]).select("doc_id", "comment_id", "root_id", (F.col("depth") + F.col("__more")).alias("depth"))
        far = up.select("doc_id", F.col("comment_id").alias("above"), F.col("above").alias("__top"), F.col("depth").alias("__more"))
        up = settled(up.join(far, ["doc_id", "above"]).select("doc_id", "comment_id", F.col("__top").alias("above"), (F.col("depth") + F.col("__more")).alias("depth")))
        found = settled(found.unionByName(reached))
    return rows.join(found, ["doc_id", "comment_id"], "left")


def replies(comments: DataFrame) -> DataFrame:
    """Each comment with the sorted ids of its direct replies."""
    kids = comments.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("comment_id")).agg(F.array_sort(F.collect_list("comment_id")).alias("replies"))
    return comments.join(kids, ["doc_id", "comment_id"], "left").withColumn("replies", F.coalesce("replies", F.array().cast("array<bigint>")))


def delete_comments(comments: DataFrame, doomed: DataFrame) -> DataFrame:
    """Comments without those named and all replies below them, at any depth.

    Each round looks twice as far up, so every comment has one row at all times and
    replies on a cycle end too.
    """
    named = doomed.select("doc_id", "comment_id").distinct().withColumn("__named", F.lit(True))
    state = comments.select("doc_id", "comment_id", F.col("parent_id").alias("above")).join(named, ["doc_id", "comment_id"], "left")
    state = settled(state.select("doc_id", "comment_id", "above", F.col("__named").isNotNull().alias("gone")))
    for _ in range(_rounds(comments)):
        if state.where("above is not null and not gone").isEmpty():
            break
        upper = state.select("doc_id", F.col("comment_id").alias("above"), F.col("above").alias("__top"), F.col("gone").alias("__gone"))
        state = settled(state.join(upper, ["doc_id", "above"], "left").select("doc_id", "comment_id", F.col("__top").alias("above"), (F.col("gone") | F.coalesce("__gone", F.lit(False))).alias("gone")))
    return comments.join(state.where("gone").select("doc_id", "comment_id"), ["doc_id", "comment_id"], "left_anti")


def add_comments(comments: DataFrame, new: DataFrame) -> DataFrame:
    """Appends comments (doc_id, parent_id, author, text) under the next free ids; a document without any begins at 0."""
    last = comments.groupBy("doc_id").agg(F.max("comment_id").alias("__last"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("author", "text"))
    rows = new.withColumn("__n", rank).join(last, "doc_id", "left").withColumn("comment_id", F.coalesce("__last", F.lit(-1)) + F.col("__n"))
    return comments.unionByName(rows.select(*comments.columns))


def initials(author: Column) -> Column:
    return F.upper(F.left(F.trim(author), F.lit(1)))


def notes_shown(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """Footnotes with their display number and the paragraph of their first reference; unreferenced ones last."""
    first = refs.groupBy("doc_id", "note_id").agg(F.min("ref_idx").alias("first_ref"), F.min_by("para_idx", "ref_idx").alias("para_idx"))
    own = notes.where(~F.coalesce(F.col("type").isin("separator", "continuationSeparator"), F.lit(False)))
    shown = own.join(first, ["doc_id", "note_id"], "left")
    rank = F.when(F.col("first_ref").isNotNull(), F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("first_ref").asc_nulls_last())))
    return shown.withColumn("display_number", rank)


def attach(rows: DataFrame, comments: DataFrame) -> DataFrame:
    """Rows by paragraph with the comments that are anchored there, in order."""
    by = comments.groupBy("doc_id", "para_id").agg(F.array_sort(F.collect_list(F.struct("comment_id", "author", "text"))).alias("comments"))
    return rows.join(by, ["doc_id", "para_id"], "left")


# Missing, unmatched and repeated references.


def missing(refs: DataFrame, defined: DataFrame, key: list[str]) -> DataFrame:
    """References to what is not defined."""
    return refs.select(*key).distinct().join(defined, key, "left_anti")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unmatched(starts: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """Starts without an end and ends without a start, told apart by ``side``."""
    a, b = starts.select(*key).distinct(), ends.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("start")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("end")))


def unresolved(texts: DataFrame, defined: DataFrame, pattern: str = r"(?:REF|PAGEREF)\s+(\S+)") -> DataFrame:
    """Names that instructions in ``text`` refer to and that are not defined (doc_id, name)."""
    named = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("name")).distinct()
    return named.join(defined, ["doc_id", "name"], "left_anti")


def part_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Parts (doc_id, part_uri, sha, size) of pairs of archives: only_in_left, only_in_right, same or different.

    Parts meet within their document, so pairs of any number are compared at once.
    """
    a = left.select("doc_id", "part_uri", F.col("sha").alias("left_sha"), F.col("size").alias("left_size"))
    b = right.select("doc_id", "part_uri", F.col("sha").alias("right_sha"), F.col("size").alias("right_size"))
    status = F.when(F.col("right_sha").isNull(), "only_in_left").when(F.col("left_sha").isNull(), "only_in_right").when((F.col("left_sha") == F.col("right_sha")) & (F.col("left_size") == F.col("right_size")), "same").otherwise("different")
    return a.join(b, ["doc_id", "part_uri"], "full_outer").withColumn("status", status)


def copy_missing(own: DataFrame, other: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """Own definitions and those of the other document that are used here and not defined."""
    return own.unionByName(other.join(own, key, "left_anti").join(used, key, "left_semi"))


def section_errors(sections: DataFrame, rels: DataFrame) -> DataFrame:
    """Broken rules of sections (doc_id, child_idx, last_idx, parent, rid): rule and what broke it."""
    rule = lambda df, name: df.select("doc_id", F.lit(name).alias("rule"))
    body = sections.where("parent = 'body'")
    many = body.groupBy("doc_id").agg(F.count_distinct("child_idx").alias("n")).where("n > 1")
    late = body.where("child_idx <> last_idx")
    odd = sections.where("parent NOT IN ('body', 'pPr')")
    empty = sections.where("rid = ''")
    any_ = rels.select("doc_id").distinct()
    lost = sections.where("rid <> ''").join(any_, "doc_id", "left_semi").join(rels, ["doc_id", "rid"], "left_anti")
    found = [rule(many, "more than one body section"), rule(late, "body section is not last"), rule(odd, "invalid parent"), rule(empty, "missing id"), rule(lost, "dangling id")]
    return reduce(DataFrame.unionByName, found).distinct()


def wrapper_errors(wrappers: DataFrame) -> DataFrame:
    """Revision wrappers without an id, author or date, or without content."""
    problem = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"missing {c}")) for c in ("id", "author", "date")], F.when(F.col("children") == 0, F.lit("empty"))))
    return wrappers.select("doc_id", "wrapper_idx", F.explode(problem).alias("warning"))


# Styles.


def style_chains(style_defs: DataFrame) -> DataFrame:
    """(doc_id, style_id, depth, ancestor): each style, then what it is based on; a cycle ends the chain.

    Each round doubles the distance climbed. A style that comes again, further up, is on
    a cycle, so the least depth of each ancestor is its place in the chain.
    """
    known = style_defs.select("doc_id", F.col("style_id").alias("above"))
    jump = style_defs.select("doc_id", "style_id", F.col("based_on").alias("above")).join(known, ["doc_id", "above"], "left_semi")
    jump = settled(jump.select("doc_id", "style_id", "above"))
    chain, n, step = settled(style_defs.select("doc_id", "style_id", F.col("style_id").alias("ancestor"), F.lit(0).alias("depth"))), -1, 1
    while (now := chain.count()) != n:
        n = now
        up = jump.select("doc_id", F.col("style_id").alias("ancestor"), "above")
        more = chain.join(up, ["doc_id", "ancestor"]).select("doc_id", "style_id", F.col("above").alias("ancestor"), (F.col("depth") + step).alias("depth"))
        chain = settled(chain.unionByName(more).groupBy("doc_id", "style_id", "ancestor").agg(F.min("depth").alias("depth")))
        far = jump.select("doc_id", F.col("style_id").alias("above"), F.col("above").alias("__top"))
        jump, step = settled(jump.join(far, ["doc_id", "above"]).select("doc_id", "style_id", F.col("__top").alias("above"))), 2 * step
    return chain.select("doc_id", "style_id", "depth", "ancestor")


def inherited(style_defs: DataFrame, columns: list[str]) -> DataFrame:
    """The nearest value of each paragraph property along a style's chain."""
    own = style_defs.select("doc_id", F.col("style_id").alias("ancestor"), *columns)
    rows = style_chains(style_defs).join(own, ["doc_id", "ancestor"])
    return rows.groupBy("doc_id", "style_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c) for c in columns])


def first_run_style(style_defs: DataFrame, columns: list[str]) -> DataFrame:
    """The run properties of the nearest style in a chain that has any; they do not mix with those above it."""
    has = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    own = style_defs.where(has).select("doc_id", F.col("style_id").alias("ancestor"), F.struct(*columns).alias("__own"))
    rows = style_chains(style_defs).join(own, ["doc_id", "ancestor"])
    out = rows.groupBy("doc_id", "style_id").agg(F.min_by("__own", "depth").alias("__own"))
    return out.select("doc_id", "style_id", *[F.col("__own")[c].alias(c) for c in columns])


def effective(columns: list[str], *levels: str) -> list[Column]:
    """Each property from the first of the struct columns ``levels`` that has it: run, run style, mark, paragraph style."""
    return [F.coalesce(*[F.col(level)[c] for level in levels]).alias(c) for c in columns]


def raised(style_defs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose superscript and raised position would lift them twice lose the position."""
    near = inherited(style_defs, ["vert_align", "position"]).withColumnsRenamed({"vert_align": "__v", "position": "__p"})
    rows = runs.join(near, ["doc_id", "style_id"], "left")
    twice = (F.coalesce("vert_align", "__v") == "superscript") & (F.coalesce("position", "__p", F.lit(0)) > 0)
    return rows.withColumn("position", F.when(twice, 0).otherwise(F.col("position"))).drop("__v", "__p")


# Tables.


def span(value: Column) -> Column:
    """Grid columns of a cell: 1 unless it says more."""
    return F.greatest(F.coalesce(value, F.lit(1)), F.lit(1))


def merge_kind(h_merge: Column, v_merge: Column, grid_span: Column) -> Column:
    return F.when(h_merge.isNotNull(), "hMerge").when(v_merge.isNotNull(), "vMerge").when(span(grid_span) > 1, "gridSpan")


def cell_columns(cells: DataFrame) -> DataFrame:
    """Adds grid_col (from 0), the sum of the spans before a cell in its row."""
    w = Window.partitionBy("doc_id", "table_idx", "row_idx").orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("grid_col", F.coalesce(F.sum(span(F.col("grid_span"))).over(w), F.lit(0)))


def table_metadata(cells: DataFrame) -> DataFrame:
    """Rows, grid columns and header texts of each table; a header stands in every column it spans."""
    rows = cells.groupBy("doc_id", "table_idx", "row_idx").agg(F.sum(span(F.col("grid_span"))).alias("cols"), F.array_sort(F.collect_list(F.struct("cell_idx", F.array_repeat("text", span(F.col("grid_span"))).alias("texts")))).alias("cells"))
    return rows.groupBy("doc_id", "table_idx").agg(F.count("*").alias("n_rows"), F.max("cols").alias("n_cols"), F.flatten(F.transform(F.min_by("cells", "row_idx"), lambda c: c["texts"])).alias("headers"))


def extract_tables(cells: DataFrame, headers: list[list[str]] | None = None, reject_merged: bool = True, trim: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, diagnostics): body rows of tables as maps from header to text, and their cells as they stand (texts).

    A table with merged cells or with a header twice is left out and told in the
    diagnostics. ``headers`` keeps only tables with one of these exact header lists.
    In the map, cells beyond the headers are left out and missing ones are empty.
    """
    text = F.trim("text") if trim else F.col("text")
    by_row = cells.groupBy("doc_id", "table_idx", "row_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("cell_idx"), text.alias("t")))), lambda c: c["t"]).alias("texts"),
        F.bool_or(merge_kind(F.col("h_merge"), F.col("v_merge"), F.col("grid_span")).isNotNull()).alias("merged"),
    )
    w = Window.partitionBy("doc_id", "table_idx")
    rows = by_row.withColumn("head", F.min_by("texts", "row_idx").over(w)).withColumn("merged", F.bool_or("merged").over(w)).withColumn("first", F.min("row_idx").over(w))
    twice = F.size(F.array_distinct("head")) < F.size("head")
    why = F.when(F.col("merged") & F.lit(reject_merged), "merged cells").when(twice, "duplicate headers")
    rows = rows.withColumn("why", why)
    told = rows.where("why is not null").select("doc_id", "table_idx", "why").distinct()
    kept = rows.where("why is null AND row_idx > first")
    if headers is not None:
        kept = kept.where(F.col("head").isin(*[F.array(*map(F.lit, h)) for h in headers]))
    padded = F.transform(F.sequence(F.lit(1), F.size("head")), lambda i: F.coalesce(F.try_element_at("texts", i), F.lit("")))
    return kept.select("doc_id", "table_idx", "row_idx", F.when(~twice, F.map_from_arrays("head", padded)).alias("row"), "texts"), told


# Rendering.


def rendered(nodes: DataFrame) -> DataFrame:
    """One text a document: a header line, table markers and a line of five columns for each node."""
    from .ordered import table_markers

    marked = table_markers(nodes)
    line = F.concat_ws(" | ", "para_id", F.coalesce("list_label", F.lit("")), F.coalesce("header", F.lit("")), F.coalesce("style", F.lit("")), "text")
    parts = F.concat(F.when(F.col("opens_table"), F.concat(F.lit("#TABLE "), F.col("table_idx").cast("string"), F.lit("\n"))).otherwise(""), line, F.when(F.col("closes_table"), "\n#END_TABLE").otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", parts.alias("line")))), lambda x: x["line"]), "\n")
    return marked.groupBy("doc_id").agg(F.concat(F.lit("#SCHEMA id | list_label | header | style | text\n"), body).alias("rendered"))


def rendered_json(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("para_idx", "para_id", "text")))).alias("rendered"))


def rendered_simple(nodes: DataFrame, width: int = 80) -> DataFrame:
    line = F.concat_ws(" | ", "para_id", X.preview(F.col("text"), width))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("rendered"))
