"""Character-level differences, collapsed fields and numbered atoms."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..lineage import tasks
from .alignment import lcs, tokenise
from .scripts import DELETE, EQUAL, INSERT, readable, shortest_script


def character_diff(a: str, b: str, clean: bool = True) -> list[tuple[int, str]]:
    """(op, text) operations that turn ``a`` into ``b``: a shortest script by characters; with ``clean``, made readable."""
    ops = shortest_script(a, b)
    return readable(ops) if clean else ops


_OPS = T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("text", T.StringType())]))


def _told(script: Callable[[str, str], list[tuple[int, str]]], a: pa.Array, b: pa.Array) -> pa.Array:
    """The operations of each pair of texts as lists of one array; null counts as empty."""
    bounds, ops = [0], []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        ops += script(x or "", y or "")
        bounds.append(len(ops))
    kinds, texts = pa.array([o for o, _ in ops], pa.int32()), pa.array([t for _, t in ops], pa.string())
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([kinds, texts], names=["op", "text"]))


@F.arrow_udf(_OPS)
def diff_ops(a: pa.Array, b: pa.Array) -> pa.Array:
    """The operations between two columns of texts; null counts as empty."""
    return _told(character_diff, a, b)


@F.arrow_udf(_OPS)
def word_ops(a: pa.Array, b: pa.Array) -> pa.Array:
    """The operations between two columns of texts, word by word; neighbours of one kind are one. Null counts as empty."""
    return _told(word_diff, a, b)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores by number: few bytes can be much work, so a file that is one task by its size is more."""
    return rows.repartition(tasks(rows.sparkSession))


def word_diff(a: str, b: str) -> list[tuple[int, str]]:
    """Operations that turn one text into another, over words and the white space between them."""
    x, y = tokenise(a), tokenise(b)
    out: list[tuple[int, str]] = []

    def add(op: int, tokens: list[str]) -> None:
        if tokens:
            out.append((op, "".join(tokens)))

    p = q = 0
    same: list[str] = []
    for i, j in [*lcs(x, y), (len(x), len(y))]:
        if i > p or j > q:
            add(EQUAL, same)
            same = []
            add(DELETE, x[p:i])
            add(INSERT, y[q:j])
        same += x[i : i + 1]
        p, q = i + 1, j + 1
    add(EQUAL, same)
    return out


def change_counts(ops: Column) -> Column:
    """struct(inserted, deleted, equal): characters by kind of operation."""
    n = lambda k: F.aggregate(F.filter(ops, lambda o: o["op"] == k), F.lit(0), lambda s, o: s + F.length(o["text"]))
    return F.struct(n(INSERT).alias("inserted"), n(DELETE).alias("deleted"), n(EQUAL).alias("equal"))


def rebuilt(ops: Column, side: int) -> Column:
    """The text before (DELETE) or after (INSERT) the operations."""
    return F.array_join(F.transform(F.filter(ops, lambda o: (o["op"] == EQUAL) | (o["op"] == side)), lambda o: o["text"]), "")


def collapsed_fields(atoms: DataFrame, group: list[str], order: str) -> DataFrame:
    """Each outermost field (mark: begin, separate, end) as one atom that holds the text of its result.

    Atoms outside fields stay; a field that does not end stays open to the end of its group.
    """
    from .ordered import field_depth

    w = Window.partitionBy(*group).orderBy(order)
    rows = field_depth(atoms, group, order)
    before = F.coalesce(F.lag("depth").over(w), F.lit(0))
    rows = rows.withColumn("__inside", (F.col("depth") > 0) | (before > 0)).withColumn("__opens", (F.col("depth") == 1) & (before == 0))
    rows = rows.withColumn("__field", F.when(F.col("__inside"), F.sum(F.col("__opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    separated = F.max((F.col("mark") == "separate").cast("int")).over(Window.partitionBy(*group, "__field").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__result", F.when(F.col("__inside"), F.coalesce(separated, F.lit(0)) == 1).otherwise(True))
    key = F.when(F.col("__inside"), F.concat(F.lit("f"), F.col("__field").cast("string"))).otherwise(F.concat(F.lit("a"), F.col(order).cast("string")))
    shown = F.when(F.col("mark").isNull() & F.col("__result"), F.col("text")).otherwise("")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), shown.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(*group, key.alias("__key")).agg(F.min(order).alias(order), text.alias("text"), F.any_value("__inside").alias("is_field")).drop("__key")


def numbered_hashes(atoms: DataFrame, labels: DataFrame) -> DataFrame:
    """Hashes of atoms, where a paragraph's list label counts as part of its first atom."""
    rows = atoms.join(labels.select("doc_id", "para_idx", "label"), ["doc_id", "para_idx"], "left")
    first = F.col("atom_idx") == F.min("atom_idx").over(Window.partitionBy("doc_id", "para_idx"))
    return rows.withColumn("hash", F.sha1(F.when(first & F.col("label").isNotNull(), F.concat_ws(":", "label", "text")).otherwise(F.col("text")))).drop("label")
