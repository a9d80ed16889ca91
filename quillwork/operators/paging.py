"""Offsets, limits and budgets over the ordered paragraphs of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import token_estimate

TOKEN_BUDGET = 14_000


def numbered(rows: DataFrame, group: str = "doc_id", order: str = "para_idx") -> DataFrame:
    """Adds n (from 1) and total in each group."""
    w = Window.partitionBy(group)
    return rows.withColumn("n", F.row_number().over(w.orderBy(order))).withColumn("total", F.count("*").over(w))


def page(rows: DataFrame, offset: int = 1, limit: int | None = None, group: str = "doc_id", order: str = "para_idx") -> DataFrame:
    """Rows from a 1-based offset on; a negative one counts from the end, 0 is the start.

    Adds has_more and next_offset, which tell how to go on.
    """
    start = F.lit(max(offset - 1, 0)) if offset >= 0 else F.greatest(F.col("total") + offset, F.lit(0))
    rows = numbered(rows, group, order).withColumn("__start", start)
    kept = rows.where(F.col("n") > F.col("__start"))
    if limit is not None:
        kept = kept.where(F.col("n") <= F.col("__start") + limit)
    stop = F.least(F.col("__start") + (limit if limit is not None else F.col("total")), F.col("total"))
    more = stop < F.col("total")
    return kept.withColumn("has_more", more).withColumn("next_offset", F.when(more, stop + 1)).drop("__start")


def revision_page(rows: DataFrame, offset: int = 0, limit: int = 50, group: str = "doc_id", order: str = "para_idx") -> DataFrame:
    """Rows from a 0-based offset on; the limit is between 1 and 500."""
    limit = min(max(limit, 1), 500)
    return numbered(rows, group, order).where((F.col("n") > offset) & (F.col("n") <= offset + limit))


def within_budget(rows: DataFrame, length: Column, budget: int = TOKEN_BUDGET, group: str = "doc_id", order: str = "para_idx") -> DataFrame:
    """Rows in order until their running token estimate passes the budget; at least one of each group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used_chars", F.sum(length + 1).over(w)).withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return rows.where((F.col("__n") == 1) | (token_estimate(F.col("used_chars")) <= budget)).drop("__n")


def index_lists(wanted: Column, size: Column) -> Column:
    """struct(found, missing): sorted distinct indexes inside and outside 0 .. size - 1."""
    own = F.array_sort(F.array_distinct(wanted))
    return F.struct(F.filter(own, lambda i: (i >= 0) & (i < size)).alias("found"), F.filter(own, lambda i: (i < 0) | (i >= size)).alias("missing"))
