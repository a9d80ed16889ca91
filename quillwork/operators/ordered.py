"""Operators that depend on order: islands, running state, numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import counters as C


def islands(rows: DataFrame, group: list[str], order: str, same: list[str], name: str = "island") -> DataFrame:
    """Numbers the runs of neighbouring rows that agree in ``same``, from 1."""
    w = Window.partitionBy(*group).orderBy(order)
    now = F.struct(*same)
    starts = ~F.coalesce(now.eqNullSafe(F.lag(now).over(w)), F.lit(False)) | (F.row_number().over(w) == 1)
    rows = rows.withColumn("__starts", starts.cast("int"))
    return rows.withColumn(name, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def merged_runs(runs: DataFrame, group: list[str], order: str, same: list[str], barrier: Column | None = None) -> DataFrame:
    """Neighbouring runs of equal formatting as one, their texts in order; a barrier stands alone."""
    if barrier is not None:
        runs = runs.withColumn("__barrier", F.when(barrier, F.col(order)))
        same = [*same, "__barrier"]
    numbered = islands(runs, group, order, same)
    out = numbered.groupBy(*group, "island", *same).agg(F.min(order).alias(order), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "").alias("text"), F.count("*").alias("runs"))
    return out.drop("__barrier", "island")


def status_blocks(atoms: DataFrame, group: list[str], order: str, keep: tuple[str, ...] = ("Deleted", "Inserted")) -> DataFrame:
    """Runs of neighbouring atoms with one status, of those that may be moves, with their text and words."""
    from ..functions.text import word_count

    out = merged_runs(atoms, group, order, ["status"])
    return out.where(F.col("status").isin(*keep)).withColumn("words", word_count(F.col("text")))


def bridged(wrappers: DataFrame, group: list[str], order: str) -> DataFrame:
    """Numbers insertions of one author and date that only blank text parts; deletions are never bridged.

    ``wrappers``: kind, author, date, text. A blank row between two insertions alike joins them.
    """
    w = Window.partitionBy(*group).orderBy(order)
    here = F.struct("kind", "author", "date")
    blank = (F.col("kind") == "text") & F.regexp_like("text", F.lit(r"^\s*$"))
    inside = blank & F.lag(here).over(w).eqNullSafe(F.lead(here).over(w)) & F.lag("kind").over(w).isin("ins", "moveTo")
    rows = wrappers.withColumns({c: F.when(inside, F.lag(c).over(w)).otherwise(F.col(c)) for c in ("kind", "author", "date")})
    return islands(rows, group, order, ["kind", "author", "date"], "wrapper")


def without_noops(groups: DataFrame, group: list[str], order: str) -> DataFrame:
    """Drops neighbouring delete and insert pairs whose runs, properties and content are the same."""
    w = Window.partitionBy(*group).orderBy(order)
    content = F.struct("runs", "rpr_hash", "content_hash")
    opens = (F.col("status") == "Deleted") & (F.lead("status").over(w) == "Inserted") & (F.col("runs") > 0) & content.eqNullSafe(F.lead(content).over(w))
    rows = groups.withColumn("__opens", F.coalesce(opens, F.lit(False)))
    rows = rows.withColumn("__closes", F.coalesce(F.lag("__opens").over(w), F.lit(False)))
    return rows.where(~F.col("__opens") & ~F.col("__closes")).drop("__opens", "__closes")


def deletions_first(groups: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds place: inside each run of changes the deletion-like rows stand before the insertion-like ones."""
    away, here = ("Deleted", "MovedSource"), ("Inserted", "MovedDestination")
    changed = groups.withColumn("__change", F.col("status").isin(*away, *here))
    rows = islands(changed, group, order, ["__change"], "__block")
    rank = F.when(F.col("status").isin(*here), 1).otherwise(0)
    key = [F.col("__block"), F.when(F.col("__change"), rank).otherwise(0), F.col(order)]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*key))).drop("__change", "__block")


def blank_on_both_sides(groups: DataFrame, group: list[str], order: str) -> DataFrame:
    """Blank equal rows between changes count as deleted and as inserted."""
    w = Window.partitionBy(*group).orderBy(order)
    change = ("Deleted", "Inserted")
    inside = (F.col("status") == "Equal") & F.regexp_like("text", F.lit(r"^\s+$")) & F.lag("status").over(w).isin(*change) & F.lead("status").over(w).isin(*change)
    both = F.when(F.coalesce(inside, F.lit(False)), F.array(F.lit("Deleted"), F.lit("Inserted"))).otherwise(F.array("status"))
    return groups.withColumn("__as", both).withColumn("status", F.explode("__as")).drop("__as")


def punctuation_attached(atoms: DataFrame, group: list[str], order: str) -> DataFrame:
    """Punctuation joined to the atom before it, if that has the same revision and formatting."""
    w = Window.partitionBy(*group).orderBy(order)
    mark = F.regexp_like("text", F.lit(r"^[\p{P}\p{S}]+$"))
    joins = mark & F.struct("rev_tag", "rpr_hash").eqNullSafe(F.lag(F.struct("rev_tag", "rpr_hash")).over(w)) & (F.row_number().over(w) > 1)
    rows = atoms.withColumn("__starts", (~joins).cast("int"))
    rows = rows.withColumn("__word", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(*group, "__word").agg(F.min(order).alias(order), text.alias("text"), F.min_by("rev_tag", order).alias("rev_tag"), F.min_by("rpr_hash", order).alias("rpr_hash")).drop("__word")


def field_depth(marks: DataFrame, group: list[str], order: str) -> DataFrame:
    """Running depth of (mark: begin, separate, end) rows, held at 0 after an excess end."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("mark") == "begin", 1).when(F.col("mark") == "end", -1).otherwise(0)
    rows = marks.withColumn("__raw", F.sum(step).over(w))
    return rows.withColumn("depth", F.col("__raw") - F.least(F.min("__raw").over(w), F.lit(0))).withColumn("excess_end", (F.col("mark") == "end") & (F.col("__raw") < F.coalesce(F.least(F.lit(0), F.min("__raw").over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0)))).drop("__raw")


def field_errors(marks: DataFrame, group: list[str], order: str) -> DataFrame:
    """Groups whose fields end too often or do not end."""
    rows = field_depth(marks, group, order)
    out = rows.groupBy(*group).agg(F.count_if("excess_end").alias("excess_ends"), F.max_by("depth", order).alias("open_at_end"))
    return out.where("excess_ends > 0 OR open_at_end > 0")


def visible_runs(children: DataFrame, group: list[str], order: str) -> DataFrame:
    """Runs that a reader sees: field codes are hidden, field results and all else are kept.

    ``children``: mark (begin, separate, end or null) and text of each child in order.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = field_depth(children, group, order).withColumn("__state", F.last("mark", True).over(w))
    code = (F.col("depth") > 0) & (F.col("__state") == "begin")
    return rows.withColumn("is_field_result", (F.col("depth") > 0) & ~code).where(F.col("mark").isNull() & ~F.coalesce(code, F.lit(False))).drop("__state", "depth", "excess_end", "mark")


def empty_context(paragraphs: DataFrame) -> DataFrame:
    """Adds context_hash: for an empty paragraph, the last content before it and how many empty ones followed."""
    w = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    full = F.regexp_like("text", F.lit(r"\S"))
    rows = paragraphs.withColumn("__content", F.when(full, F.sha1("text"))).withColumn("__last", F.last("__content", True).over(w)).withColumn("__block", F.sum(full.cast("int")).over(w))
    rank = F.row_number().over(Window.partitionBy("doc_id", "__block").orderBy("para_idx")) - F.when(F.col("__block") > 0, 1).otherwise(0)
    return rows.withColumn("context_hash", F.when(~full, F.sha1(F.concat_ws("|", F.coalesce("__last", F.lit("")), rank.cast("string")))).otherwise(F.col("__content"))).drop("__content", "__last", "__block")


def first_numbers(refs: DataFrame, group: list[str], note: str, order: str, counts: Column | None = None) -> DataFrame:
    """Display numbers of notes by their first reference; rows where ``counts`` is false take none."""
    first = refs.where(counts if counts is not None else F.lit(True)).groupBy(*group, note).agg(F.min(order).alias("first_ref"))
    return first.withColumn("display_number", F.row_number().over(Window.partitionBy(*group).orderBy("first_ref")))


def first_appearance(rows: DataFrame, group: list[str], key: str, order: str, name: str = "index") -> DataFrame:
    """Adds the rank of each key by its first row, from 0."""
    first = rows.withColumn("__first", F.min(order).over(Window.partitionBy(*group, key)))
    return first.withColumn(name, F.dense_rank().over(Window.partitionBy(*group).orderBy("__first")) - 1).drop("__first")


def run_offsets(runs: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds start and stop of each run in the text of its group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = runs.withColumn("stop", F.sum(F.length("text")).over(w))
    return rows.withColumn("start", F.col("stop") - F.length("text"))


def overlap_template(runs: DataFrame, group: list[str], order: str, start: Column, stop: Column) -> DataFrame:
    """The run of each group that overlaps a span most; the first wins a tie."""
    rows = run_offsets(runs, group, order)
    shared = F.least("stop", stop) - F.greatest("start", start)
    return rows.withColumn("overlap", shared).where("overlap > 0").groupBy(*group).agg(F.max_by(order, F.struct("overlap", -F.col(order))).alias(order), F.max("overlap").alias("overlap"))


def split_runs(runs: DataFrame, group: list[str], order: str, at: Column) -> DataFrame:
    """Runs cut in two where ``at`` (an offset in the group's text) falls inside one."""
    rows = run_offsets(runs, group, order)
    cut = at - F.col("start")
    parts = F.when((cut > 0) & (cut < F.length("text")), F.array(F.substring("text", F.lit(1), cut), F.substring("text", cut + 1, F.length("text")))).otherwise(F.array("text"))
    return rows.select(*[c for c in rows.columns if c not in ("text", "start", "stop")], F.posexplode(parts).alias("part", "text"))


def with_markers(paragraphs: DataFrame, marks: Column) -> DataFrame:
    """Inserts (at, mark) pairs into each text, from the right, so that offsets stay true."""
    ordered = F.reverse(F.array_sort(marks))
    put = F.aggregate(ordered, F.col("text"), lambda t, m: F.concat(F.substring(t, F.lit(1), m["at"]), m["mark"], F.substring(t, m["at"] + 1, F.length(t))))
    return paragraphs.withColumn("text", put)


def run_in_header(runs: DataFrame, group: list[str], order: str) -> DataFrame:
    """The leading bold or underlined runs of each group, if their text ends with a period, colon or dash."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    heads = runs.withColumn("__head", F.min((F.col("bold") | F.col("underline")).cast("int")).over(w)).where("__head = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "")
    out = heads.groupBy(*group).agg(F.trim(text).alias("header"), F.sum(F.length("text")).alias("chars"), F.min_by("italic", order).alias("italic"))
    return out.where(F.right("header", F.lit(1)).isin(".", ":", "-"))


def nearest(rows: DataFrame, group: list[str], order: str, wanted: Column, within: int) -> DataFrame:
    """Adds nearest: the order of the nearest wanted row other than itself, at most ``within`` away; the earlier wins a tie."""
    w = Window.partitionBy(*group).orderBy(order)
    own = F.when(wanted, F.col(order))
    rows = rows.withColumn("__own", own)
    before = F.last("__own", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy(*group).orderBy(F.desc(order))  # from the end, so that a running frame does
    after = F.last("__own", True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__before", before).withColumn("__after", after)
    a, b = F.col(order) - F.col("__before"), F.col("__after") - F.col(order)
    pick = F.when((a <= within) & (a <= F.coalesce(b, a)), F.col("__before")).when(b <= within, F.col("__after"))
    return rows.withColumn("nearest", pick).drop("__own", "__before", "__after")


def carried(rows: DataFrame, order: str, value: Column, name: str, group: list[str]) -> DataFrame:
    """Adds the last non-null value up to each row, as a heading holds for the rows below it."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, True).over(w))


def table_markers(nodes: DataFrame) -> DataFrame:
    """Adds opens_table and closes_table, true at the first and last row of each run of one table."""
    w = Window.partitionBy("doc_id").orderBy("para_idx")
    same = lambda f: F.col("table_idx").eqNullSafe(f("table_idx").over(w))
    inside = F.col("table_idx").isNotNull()
    return nodes.withColumn("opens_table", inside & ~same(F.lag)).withColumn("closes_table", inside & ~same(F.lead))


def list_labels(items: DataFrame) -> DataFrame:
    """Counters and labels of multi-level lists: (doc_id, num_id, para_idx, level) items with their definitions.

    ``starts``, ``formats`` and ``templates`` are arrays by level. A level's counter
    begins at its start and grows by one an item; deeper counters begin again. This is
    state over all earlier items, so each (doc_id, num_id) list is folded in order.
    """
    schema = "doc_id long, num_id long, para_idx int, level int, counters array<int>"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                now: list[int] = []
                for para, level in row.steps:
                    for k in range(len(now), level + 1):
                        now.append(int(row.starts[k]) - (k == level))
                    now[level] += 1
                    del now[level + 1 :]
                    out.append((row.doc_id, row.num_id, para, level, list(now)))
            yield pd.DataFrame(out, columns=["doc_id", "num_id", "para_idx", "level", "counters"])

    steps = F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "level"))), lambda s: F.array(s["para_idx"], s["level"]))
    lists = items.groupBy("doc_id", "num_id").agg(steps.alias("steps"), F.any_value("starts").alias("starts"))
    counted = lists.mapInPandas(fold, schema)
    levels = items.select("doc_id", "num_id", "para_idx", "formats", "templates")
    out = counted.join(levels, ["doc_id", "num_id", "para_idx"])
    return out.withColumn("label", C.expanded(F.get("templates", F.col("level")), F.col("counters"), F.col("formats"))).drop("formats", "templates")


def continued_labels(items: DataFrame) -> DataFrame:
    """As ``list_labels``, where a level whose start is the counter above it plus one continues that level.

    The level used last belongs to its own list, so lists of other documents do not matter.
    """
    rows = list_labels(items)
    starts = items.select("doc_id", "num_id", "para_idx", F.col("starts").alias("__starts"), F.get("templates", F.lit(0)).alias("__top"), F.col("formats").alias("__formats"))
    rows = rows.join(starts, ["doc_id", "num_id", "para_idx"])
    own, above = F.get("counters", F.col("level")), F.get("counters", F.col("level") - 1)
    goes_on = (F.col("level") > 0) & (F.get("__starts", F.col("level")) == above + 1)
    return rows.withColumn("label", F.when(goes_on, C.expanded(F.col("__top"), F.array(own), F.col("__formats"))).otherwise(F.col("label"))).drop("__starts", "__top", "__formats")
