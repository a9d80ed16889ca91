"""Looks carried through a comparison: what equal text looked like on either side, and how that changed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formatting import changed_properties
from ..lineage import tasks
from .edits import GONE, NEW


def properties(look: Column) -> Column:
    """The properties of a look (markup such as ``<w:b/><w:sz w:val="24"/>``) as a map of names and values; one without a value is on."""
    tags = F.regexp_extract_all(look, F.lit(r"<(\w+:\w+)((?:\s[^>]*?)?)/?>"), 0)
    name = lambda t: F.regexp_extract(t, r"<(\w+:\w+)", 1)
    value = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r'w:val="([^"]*)"', 1), F.lit("")), F.lit("true"))
    return F.map_from_entries(F.transform(tags, lambda t: F.struct(name(t).alias("key"), value(t).alias("value"))))


def token_places(atoms: DataFrame) -> DataFrame:
    """Atoms with old_start and new_start: where each begins in its paragraph of the original and of the revision."""
    side = {"old_start": ("orig_para", NEW), "new_start": ("rev_para", GONE)}
    for name, (para, other) in side.items():
        on = ~F.col("status").isin(*other)
        w = Window.partitionBy("pair_id", para).orderBy("atom_idx").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.sum(F.when(on, F.length("text")).otherwise(0)).over(w)
        atoms = atoms.withColumn(name, F.when(on, upto - F.length("text")))
    return atoms


def _look_at(tokens: DataFrame, spans: DataFrame, para: str, start: str, name: str) -> DataFrame:
    """Adds ``name``: the look of the span that holds the first character of each token, by a running window over both."""
    marks = spans.select("pair_id", F.col("para_idx").alias("p"), F.col("start").alias("s"), "look")
    own = tokens.withColumns({"p": F.col(para), "s": F.col(start)})
    both = own.withColumn("token", F.lit(1)).unionByName(marks.withColumn("token", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("pair_id", "p").orderBy("s", "token").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.when(F.col("s").isNotNull(), F.last("look", True).over(w))).where("token = 1").drop("p", "s", "look", "token")


def look_changes(atoms: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Atoms of a comparison with old_look, new_look, and status FormatChanged and ``names`` where equal text looks different.

    ``old`` and ``new`` are the spans (pair_id, para_idx, start, look) of either side's
    paragraphs. ``names`` are the properties that were added, removed or changed.
    """
    rows = token_places(atoms)
    rows = _look_at(rows, old, "orig_para", "old_start", "old_look")
    rows = _look_at(rows, new, "rev_para", "new_start", "new_look")
    names = changed_properties(properties(F.coalesce("old_look", F.lit(""))), properties(F.coalesce("new_look", F.lit(""))))
    rows = rows.withColumn("names", F.when(F.col("status") == "Equal", names))
    changed = F.coalesce(F.size("names") > 0, F.lit(False))
    return rows.withColumn("status", F.when(changed, "FormatChanged").otherwise(F.col("status"))).select("pair_id", "atom_idx", "status", "orig_para", "rev_para", "text", "old_look", "new_look", F.when(changed, F.col("names")).alias("names"))


def _counted(atoms: DataFrame) -> DataFrame:
    """Paragraphs numbered without gaps, as they stand in the array of texts."""
    return atoms.withColumn("para_idx", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("para_idx").asc_nulls_first())) - 1)


def look_spans(atoms: DataFrame) -> DataFrame:
    """(pair_id, para_idx, start, look) of the comparison atoms of parts, whose ids name the pairs; empty ones have no place."""
    w = Window.partitionBy("doc_id", "para_idx").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = _counted(atoms).where("text <> ''").withColumn("start", F.sum(F.length("text")).over(w) - F.length("text"))
    return rows.select(F.col("doc_id").alias("pair_id"), "para_idx", "start", "look")


def paragraph_texts(atoms: DataFrame, name: str) -> DataFrame:
    """(pair_id, name): the texts of the paragraphs of comparison atoms in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "")
    paras = _counted(atoms).groupBy("doc_id", "para_idx").agg(text.alias("t"))
    return paras.groupBy(F.col("doc_id").alias("pair_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "t"))), lambda x: x["t"]).alias(name))


#: Atoms of one pair of looks, as they leave the task that compares.
_PAIRED = "pair_id long, old_look string, new_look string, atoms array<struct<atom_idx:long,status:string,orig_para:int,rev_para:int,text:string>>"
_ATOM = pa.struct([("atom_idx", pa.int64()), ("status", pa.string()), ("orig_para", pa.int32()), ("rev_para", pa.int32()), ("text", pa.string())])
_ROWS = pa.schema([("pair_id", pa.int64()), ("old_look", pa.string()), ("new_look", pa.string()), ("atoms", pa.list_(_ATOM))])


def _looks_of(paras: list[list[tuple[str, str]]], para: np.ndarray, size: np.ndarray, on: np.ndarray, kinds: list[str | None]) -> np.ndarray:
    """The number among ``kinds`` (0: none) of the look of the first character of each atom, by its paragraph and its length.

    ``on`` are the atoms that this side has. Those of a paragraph follow each other, so
    a running sum of lengths tells where each begins; ``kinds`` gets the looks of this side.
    """
    number = {k: n for n, k in enumerate(kinds)}
    spans = [(p, len(text), number.setdefault(look, len(number))) for p, own in enumerate(paras) for text, look in own if text]
    kinds += list(number)[len(kinds) :]
    out = np.zeros(len(para), np.int64)
    here = np.flatnonzero(on)
    if not len(here) or not spans:
        return out
    home, long, look = np.array(spans, np.int64).T
    # paragraphs lie one behind the other, a place apart
    begin = np.cumsum(long) - long + home
    first = np.zeros(len(paras) + 1, np.int64)
    np.add.at(first, home + 1, long)
    first = np.cumsum(first) + np.arange(len(paras) + 1)
    mine, upto = para[here], np.cumsum(size[here]) - size[here]
    turns = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    upto = upto - np.repeat(upto[turns], np.diff(np.append(turns, len(mine))))
    found = np.searchsorted(begin, first[mine] + upto, "right") - 1
    out[here] = np.where((found >= 0) & (home[found] == mine), look[found], 0)
    return out


def _compared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of parts compared with their looks, one after another; atoms go back by their two looks."""
    from .alignment import BATCH_ROWS, STATUSES, _compared
    from .markup import looked_paragraphs

    for batch in batches:
        pairs, olds, news, sizes, columns, held = [], [], [], [], [[] for _ in _ATOM], 0
        for pair, *sides in zip(*batch.columns):
            old, new = (looked_paragraphs(side.as_py() or "") for side in sides)
            told = _compared(*[["".join(t for t, _ in own) for own in side] for side in (old, new)])
            if told:
                n = [len(tokens) for _, _, _, tokens, _ in told]
                status, i, j = (np.repeat(np.array(c, np.int64), n) for c in ([STATUSES.index(t[0]) for t in told], [t[1] for t in told], [t[2] for t in told]))
                tokens = [t for c in told for t in c[3]]
                size = np.fromiter(map(len, tokens), np.int64, len(tokens))
                kinds: list[str | None] = [None]
                looks = [_looks_of(old, i, size, status != STATUSES.index("Inserted"), kinds), _looks_of(new, j, size, status != STATUSES.index("Deleted"), kinds)]
                key = looks[0] * len(kinds) + looks[1]
                order = np.argsort(key, kind="stable")
                some, counts = np.unique(key, return_counts=True)
                pairs += [pair.as_py()] * len(some)
                olds += [kinds[k // len(kinds)] for k in some]
                news += [kinds[k % len(kinds)] for k in some]
                sizes += counts.tolist()
                told_of = (pa.array(order), pa.array(np.array(STATUSES)[status[order]].tolist(), pa.string()), pa.array(i[order].astype(np.int32)), pa.array(j[order].astype(np.int32)), pa.array(tokens, pa.string()).take(pa.array(order)))
                for own, c in zip(columns, told_of):
                    own.append(c)
                held += len(tokens)
            if held >= BATCH_ROWS:
                yield _made(pairs, olds, news, sizes, columns)
                pairs, olds, news, sizes, columns, held = [], [], [], [], [[] for _ in _ATOM], 0
        if held:
            yield _made(pairs, olds, news, sizes, columns)


def _made(pairs: list, olds: list, news: list, sizes: list, columns: list[list[pa.Array]]) -> pa.RecordBatch:
    atoms = pa.StructArray.from_arrays([pa.concat_arrays(c) for c in columns], fields=list(_ATOM))
    bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(olds, pa.string()), pa.array(news, pa.string()), pa.ListArray.from_arrays(bounds, atoms)], schema=_ROWS)


def compared_parts(original: DataFrame, revised: DataFrame) -> DataFrame:
    """The comparison of two sets of parts, one of each id a side, looks included: what ``look_changes`` tells.

    Both parts of a pair meet in one task, which walks the markup of each once and
    compares; no tag, run or span is a row. Atoms come back by their two looks, so
    properties are told once for each two looks of a pair. Changes that a side has
    tracked already count as text. Paragraphs without text are no paragraphs here.
    """
    # few bytes of markup can be much work: pairs are dealt out by number, and the join takes that as it is
    dealt = [p.select(F.col("doc_id").alias("pair_id"), F.col("text").alias(n)).repartition(tasks(p.sparkSession), "pair_id") for p, n in ((original, "original"), (revised, "revised"))]
    pairs = dealt[0].join(dealt[1], "pair_id", "full_outer").select(F.col("pair_id").cast("long").alias("pair_id"), "original", "revised")
    rows = pairs.mapInArrow(_compared_batches, _PAIRED)
    names = changed_properties(properties(F.coalesce("old_look", F.lit(""))), properties(F.coalesce("new_look", F.lit(""))))
    # names of looks that are the same markup are none, and need not be told
    rows = rows.withColumn("names", F.when(~F.col("old_look").eqNullSafe(F.col("new_look")), names)).withColumn("names", F.when(F.size("names") > 0, F.col("names")))
    rows = rows.select("pair_id", "old_look", "new_look", "names", F.inline("atoms"))
    changed = (F.col("status") == "Equal") & F.col("names").isNotNull()
    return rows.select("pair_id", "atom_idx", F.when(changed, "FormatChanged").otherwise(F.col("status")).alias("status"), "orig_para", "rev_para", "text", "old_look", "new_look", F.when(changed, F.col("names")).alias("names"))
