"""Nested elements and comments: hashes of whole subtrees, threads as one value, atoms and their status."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import settled
from .relations import threads
from .views import element_hash, leaf_text

# The status of what stands in a revision wrapper.
STATUS = {"ins": "Inserted", "del": "Deleted", "moveFrom": "MovedSource", "moveTo": "MovedDestination"}


def deep_hashes(nodes: DataFrame) -> DataFrame:
    """Adds deep_hash to elements (doc_id, node, parent, pos, tag, attributes, text): of the element and all below it.

    Depths take as many rounds as the depth has binary digits; then a level is hashed
    from the one below it, which alone is read and written in its round. Elements on a
    cycle, and below one, get no hash.
    """
    own = nodes.select("doc_id", "node", "parent", "pos", element_hash(F.col("tag"), F.col("attributes"), F.col("text")).alias("own"))
    depths = threads(nodes.select("doc_id", F.col("node").alias("comment_id"), F.col("parent").alias("parent_id")))
    rows = settled(own.join(depths.where("root_id is not null").select("doc_id", F.col("comment_id").alias("node"), "depth"), ["doc_id", "node"]))
    levels: list[DataFrame] = []
    for depth in range(rows.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here, hashed = rows.where(F.col("depth") == depth), F.col("own")
        if levels:
            below = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node", "deep_hash"))), lambda x: x["deep_hash"]), ",")
            here = here.join(levels[-1].groupBy("doc_id", F.col("parent").alias("node")).agg(below.alias("below")), ["doc_id", "node"], "left")
            hashed = F.when(F.col("below").isNull(), F.col("own")).otherwise(F.sha1(F.concat_ws("|", "own", "below")))
        levels.append(settled(here.select("doc_id", "node", "parent", "pos", hashed.alias("deep_hash"))))
    done = reduce(DataFrame.unionByName, (x.select("doc_id", "node", "deep_hash") for x in levels))
    return nodes.join(done, ["doc_id", "node"], "left")


def deepest_first(nodes: DataFrame) -> DataFrame:
    """Adds depth and place: the order in which nested marks are taken out, the deepest first, then by node."""
    rows = threads(nodes.select("doc_id", F.col("node").alias("comment_id"), F.col("parent").alias("parent_id"))).select("doc_id", F.col("comment_id").alias("node"), "depth")
    w = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("depth"), "node")
    return nodes.join(rows, ["doc_id", "node"]).withColumn("place", F.row_number().over(w))


def nested_comments(comments: DataFrame) -> DataFrame:
    """(doc_id, root_id, thread): each thread of comments (doc_id, comment_id, parent_id, author) as nested JSON.

    A thread is one value, so its comments meet in one row; it is put together without
    recursion, at any depth.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                below: dict = {}
                for c in r.comments:
                    below.setdefault(c["parent_id"], []).append(c)
                pieces, todo = [], [below[None][0]]
                while todo:  # a closing text, or a comment still to be opened
                    c = todo.pop()
                    if isinstance(c, str):
                        pieces.append(c)
                        continue
                    pieces.append(f'{{"comment_id":{c["comment_id"]},"author":{json.dumps(c["author"], ensure_ascii=False)},"replies":[')
                    kids = below.get(c["comment_id"], [])
                    todo.append("]}")
                    for k, kid in enumerate(reversed(kids)):
                        todo += [kid] if k == len(kids) - 1 else [kid, ","]
                out.append((r.doc_id, r.root_id, "".join(pieces)))
            yield pd.DataFrame(out, columns=["doc_id", "root_id", "thread"])

    rows = threads(comments.select("doc_id", "comment_id", "parent_id")).where("root_id is not null")
    rows = rows.join(comments.select("doc_id", "comment_id", "author"), ["doc_id", "comment_id"])
    by = rows.groupBy("doc_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("comment_id", "parent_id", "author"))).alias("comments"))
    return by.mapInPandas(fold, "doc_id long, root_id long, thread string")


def status_of(ancestors: Column) -> Column:
    """The status of what stands below these tags, from the root inwards: the nearest revision wrapper decides."""
    wrappers = F.filter(ancestors, lambda t: t.isin(*STATUS))
    names = F.create_map(*[F.lit(x) for p in STATUS.items() for x in p])
    return F.coalesce(F.element_at(names, F.try_element_at(wrappers, F.lit(-1))), F.lit("Equal"))


def atoms_of(leaves: DataFrame) -> DataFrame:
    """Leaves (ancestors, tag, attributes, text and what else they have) as atoms: status, text, hash and nearest paragraph property."""
    text = leaf_text(F.col("tag"), F.col("text"))
    rows = leaves.withColumn("status", status_of(F.col("ancestors"))).withColumn("hash", element_hash(F.col("tag"), F.col("attributes"), F.col("text")))
    return rows.withColumn("in_table", F.array_contains("ancestors", "tbl")).withColumn("text", text)


def joined_pairs(runs: DataFrame, group: list[str], order: str) -> DataFrame:
    """Chains of deletion and insertion pairs, parted by nothing but blanks, as one deletion and one insertion.

    ``runs``: kind (del, ins or text), author, date, text. A chain is two or more
    neighbouring pairs of one author and date, each a deletion and then an insertion;
    the blanks between pairs stand on both sides of the result. Whole pairs only: what
    is left over stays as it is. Returns the group, order, chain (null outside one),
    kind, author, date and text.
    """
    w = Window.partitionBy(*group).orderBy(order)
    who = F.struct("author", "date")
    rows = runs.withColumn("__opens", (F.col("kind") == "del") & (F.lead("kind").over(w) == "ins") & who.eqNullSafe(F.lead(who).over(w)))
    rows = rows.withColumn("__opens", F.coalesce("__opens", F.lit(False))).withColumn("__closes", F.coalesce(F.lag("__opens").over(w), F.lit(False)))
    paired = F.col("__opens") | F.col("__closes")
    rows = rows.withColumn("__paired", paired)
    same = F.lag(who).over(w).eqNullSafe(F.lead(who).over(w))
    blank = (F.col("kind") == "text") & F.regexp_like("text", F.lit(r"^\s+$")) & F.lag("__closes").over(w) & F.lead("__opens").over(w) & same
    rows = rows.withColumn("__blank", F.coalesce(blank, F.lit(False)))
    goes_on = F.col("__closes") | F.col("__blank") | (F.col("__opens") & (F.coalesce(F.lag("__blank").over(w), F.lit(False)) | (F.coalesce(F.lag("__closes").over(w), F.lit(False)) & F.lag(who).over(w).eqNullSafe(who))))
    rows = rows.withColumn("__chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = F.sum(F.col("__opens").cast("int")).over(Window.partitionBy(*group, "__chain"))
    rows = rows.withColumn("__chain", F.when((F.col("__paired") | F.col("__blank")) & (pairs > 1), F.col("__chain")))
    rest = rows.where("__chain is null").select(*group, F.col(order), F.lit(None).cast("long").alias("chain"), "kind", "author", "date", "text")
    dealt = rows.where("__chain is not null").withColumn("__to", F.explode(F.when(F.col("kind") == "text", F.array(F.lit("del"), F.lit("ins"))).otherwise(F.array("kind"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "")
    one = dealt.groupBy(*group, "__chain", "__to").agg(F.min(order).alias(order), F.max("author").alias("author"), F.max("date").alias("date"), text.alias("text"))
    return rest.unionByName(one.select(*group, order, F.col("__chain").cast("long").alias("chain"), F.col("__to").alias("kind"), "author", "date", "text"))
