"""Grouped views: identities, style catalogues, modal formatting, change counts, quality summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formatting as S
from ..functions import text as X


def identities(paragraphs: DataFrame) -> DataFrame:
    """Adds para_id: a hash of a paragraph's and its neighbours' texts, salted by rank where they repeat."""
    w = Window.partitionBy("doc_id").orderBy("para_idx")
    own = X.normalised(F.col("text"))
    rows = paragraphs.withColumn("__own", own)
    near = lambda c: F.coalesce(c, F.lit(""))
    rows = rows.withColumn("__seed", F.concat_ws("|", "__own", near(F.lag("__own").over(w)), near(F.lead("__own").over(w))))
    rank = F.row_number().over(Window.partitionBy("doc_id", "__seed").orderBy("para_idx"))
    seed = F.concat("__seed", F.when(rank > 1, F.concat(F.lit("|salt:"), (rank - 1).cast("string"))).otherwise(""))
    return rows.withColumn("para_id", X.short_id(seed)).drop("__own", "__seed")


def style_catalogue(nodes: DataFrame) -> DataFrame:
    """Groups of equal formatting in each document, named in the order of their first paragraph.

    ``nodes``: doc_id, para_idx, para_id, text, list_level, left_indent, first_indent, style, align,
    label_type. A name that is taken gets _1, _2 ...; the example is the middle paragraph.
    """
    key = ["doc_id", "list_level", "left_indent", "first_indent", "style", "align"]
    w = Window.partitionBy(*key)
    rows = nodes.withColumn("__n", F.row_number().over(w.orderBy("para_idx")) - 1).withColumn("__count", F.count("*").over(w))
    middle = F.col("__n") == F.floor(F.col("__count") / 2)
    groups = rows.groupBy(*key).agg(
        F.count("*").alias("count"),
        F.min("para_idx").alias("first_idx"),
        F.max(F.when(middle, F.col("para_id"))).alias("example_id"),
        F.max(F.when(middle, F.left("text", F.lit(80)))).alias("example_text"),
        F.min_by("label_type", F.when(F.col("label_type").isNotNull(), F.col("para_idx"))).alias("label_type"),
    )
    groups = groups.withColumn("base", S.base_style(F.col("list_level"), F.col("label_type"), F.col("left_indent"), F.col("style")))
    rank = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("first_idx")) - 1
    return groups.withColumn("style_id", F.concat("base", F.when(rank > 0, F.concat(F.lit("_"), rank.cast("string"))).otherwise(""))).drop("base")


def mode_of(runs: DataFrame, group: list[str], value: list[str], weight: Column, order: str) -> DataFrame:
    """The value of each group that covers most characters; the earliest wins a tie. Adds share."""
    sums = runs.groupBy(*group, *value).agg(F.sum(weight).alias("chars"), F.min(order).alias("first"))
    best = F.max_by(F.struct(*value, "chars"), F.struct(F.col("chars"), -F.col("first")))
    out = sums.groupBy(*group).agg(best.alias("best"), F.sum("chars").alias("total"))
    return out.select(*group, *[F.col("best")[v].alias(v) for v in value], F.col("best")["chars"].alias("chars"), (F.col("best")["chars"] / F.col("total")).alias("share"))


def modal_flags(runs: DataFrame, group: list[str], suppress_at: float = 0.60) -> DataFrame:
    """Modal bold, italic and underline of each group; suppressed (a baseline) at 60 % of the characters."""
    out = mode_of(runs, group, ["bold", "italic", "underline"], F.length("text"), "run_idx")
    return out.withColumn("suppressed", F.col("share") >= suppress_at)


def font_baseline(runs: DataFrame, group: list[str]) -> DataFrame:
    """Modal colour, font and size of each group in one pass; a mode that is empty is null."""
    names = ("color", "font", "size")
    kinds = {f.name: f.dataType for f in runs.schema.fields}
    values = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in names])
    sums = runs.select(*group, F.inline(values), F.length("text").alias("n"), "run_idx").groupBy(*group, "kind", "value").agg(F.sum("n").alias("chars"), F.min("run_idx").alias("first"))
    # a null mode is one like any other, so it is held in a struct
    most = lambda c: F.max_by(F.struct("value"), F.when(F.col("kind") == c, F.struct("chars", -F.col("first"))))["value"]
    return sums.groupBy(*group).agg(*[F.nullif(most(c), F.lit("")).cast(kinds[c]).alias(c) for c in names])


# Elements that mark tracked changes.
MARKERS = ("ins", "del", "moveFrom", "moveTo", "rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange")


def marker_counts(tags: DataFrame) -> DataFrame:
    """For each document of (doc_id, tag): ten counts, content and property subtotals, the total."""
    counts = {m: F.count_if(F.col("tag") == m) for m in MARKERS}
    rows = tags.groupBy("doc_id").agg(*[c.alias(m) for m, c in counts.items()])
    add = lambda names: reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return rows.withColumns({"content_changes": add(MARKERS[:4]), "property_changes": add(MARKERS[4:]), "total": add(MARKERS)}).withColumn("has_changes", F.col("total") > 0)


def change_stats(atoms: DataFrame, group: list[str]) -> DataFrame:
    """Insertions, deletions, moves (pairs), format changes and paragraphs of (status, para_idx) atoms."""
    n = lambda s: F.count_if(F.col("status") == s)
    return atoms.groupBy(*group).agg(n("Inserted").alias("insertions"), n("Deleted").alias("deletions"), F.floor((n("MovedSource") + n("MovedDestination")) / 2).alias("moves"), n("FormatChanged").alias("format_changes"), n("Equal").alias("equal"), F.count_distinct("para_idx").alias("paragraphs"))


def modified_paragraphs(atoms: DataFrame, group: list[str]) -> DataFrame:
    """How many paragraphs hold both insertions and deletions, or a change of format."""
    rows = atoms.groupBy(*group, "para_idx").agg(F.bool_or(F.col("status") == "Deleted").alias("d"), F.bool_or(F.col("status") == "Inserted").alias("i"), F.bool_or(F.col("status") == "FormatChanged").alias("f"))
    return rows.groupBy(*group).agg(F.count_if((F.col("d") & F.col("i")) | F.col("f")).alias("modified"))


def worst_status(rows: DataFrame, group: list[str], status: str = "status") -> DataFrame:
    """FAIL if any failed, NOT_COVERED if all are, else PASS; with the count of each."""
    s = F.col(status)
    out = F.when(F.bool_or(s == "FAIL"), "FAIL").when(F.bool_and(s == "NOT_COVERED"), "NOT_COVERED").otherwise("PASS")
    return rows.groupBy(*group).agg(out.alias("overall"), *[F.count_if(s == x).alias(x.lower()) for x in ("PASS", "FAIL", "NOT_COVERED")])


def gates(rows: DataFrame, group: list[str]) -> DataFrame:
    """Whether all hard gates of (gate, hard, passed) passed, and the names of those that failed."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("gate"))))
    return rows.groupBy(*group).agg(F.bool_and(F.col("passed") | ~F.col("hard")).alias("passed"), failed.alias("failed"))


def minimality(rows: DataFrame) -> DataFrame:
    """Adds minimality: changed characters over those of a reference diff; null without any."""
    return rows.withColumn("minimality", (F.col("insertions") + F.col("deletions")) / F.nullif(F.col("best_insertions") + F.col("best_deletions"), F.lit(0)))


def coverage(rows: DataFrame, group: list[str]) -> DataFrame:
    """Covered over total lines of each group, the plain mean of its files, and the files with most uncovered lines."""
    share = F.col("covered") / F.nullif("total", F.lit(0)) * 100
    return rows.groupBy(*group).agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"), F.round(F.sum("covered") / F.nullif(F.sum("total"), F.lit(0)) * 100, 1).alias("percent"), F.round(F.avg(share), 1).alias("mean_percent"))


def most_uncovered(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("uncovered", F.col("total") - F.col("covered")).orderBy(F.desc("uncovered"), "file").limit(n)


def ratchet(now: DataFrame, baseline: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Packages (name, percent) that fell below their baseline by more than ``tolerance`` points."""
    old = baseline.select("name", F.col("percent").alias("baseline"))
    return now.join(old, "name").where(F.round(F.col("percent") - F.col("baseline"), 6) < -tolerance)


def stories(results: DataFrame) -> DataFrame:
    """Distinct stories, a count of each status, the last stop time and the share that is covered."""
    s = F.col("status")
    return results.agg(F.count_distinct("story").alias("stories"), F.count("*").alias("results"), *[F.count_if(F.coalesce(s, F.lit("unknown")) == x).alias(x) for x in ("passed", "failed", "broken", "skipped", "unknown")], F.max("stop").alias("last_stop"), F.round(F.count_distinct(F.when(s == "passed", F.col("story"))) / F.nullif(F.count_distinct("story"), F.lit(0)) * 100, 1).alias("percent_covered"))
