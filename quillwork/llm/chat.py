"""Chat formatting: reply trees to root-to-leaf conversations, marked turns and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import stored

# Fixed values of the template.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>"


def escaped(text: Column) -> Column:
    """``\\`` doubled, then ``<|`` written ``<\\|``: no control string is left, and it can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given: only an added backslash stands alone between ``<`` and ``|``."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _known_parents(nodes: DataFrame) -> DataFrame:
    """The nodes, with null for a parent that is not in its tree."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    kept = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return stored(kept)


def _twice(jump: DataFrame) -> DataFrame:
    """Jumps of double length."""
    far = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
    return stored(jump.join(far, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")))


def _rounds(kept: DataFrame) -> int:
    """Doublings after which only nodes that lead into a cycle still have something above them."""
    return int(kept.groupBy("tree").count().agg(F.max("count")).first()[0] or 0).bit_length()


def endless(nodes: DataFrame) -> DataFrame:
    """(tree, node) of the nodes whose parents lead into a cycle; they have no root and are on no path."""
    kept = _known_parents(nodes.withColumn("score", F.lit(0.0)))
    jump = kept.select("tree", "node", F.col("parent").alias("above")).where("above is not null")
    for _ in range(_rounds(kept)):
        jump = _twice(jump)
        if jump.isEmpty():
            break
    return jump.select("tree", "node")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """Every root-to-leaf path of the reply trees in ``nodes`` (tree, node, parent, score).

    Iterative self-joins: round k joins each row with the node 2**k replies above, so
    a path of n turns takes log2(n) rounds. Rows of paths are keyed by tree and node,
    so a tree of any size is spread over all tasks. A parent that is not in its tree
    counts as none (the node is a root); nodes that lead into a cycle reach no root
    and are on no path (``endless`` tells them).
    Returns tree, leaf, node, up (0 at the leaf), score.
    """
    kept = _known_parents(nodes)
    inner = kept.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    paths = kept.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    paths = stored(paths)
    jump = kept.select("tree", "node", F.col("parent").alias("above")).where("above is not null")
    for k in range(_rounds(kept)):
        more = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = stored(paths.unionByName(more))
        jump = _twice(jump)
        if jump.isEmpty():
            break
    else:
        paths = paths.join(jump.select("tree", F.col("node").alias("leaf")), ["tree", "leaf"], "left_anti")
    return paths.join(kept.select("tree", "node", "score"), ["tree", "node"])


def format_trees(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """Format reply trees (tree, node, parent, score, role, text) as conversations.

    Branches of a tree are ranked by the sum of their scores, then by length, then by
    leaf; the best ``branches`` of each tree are kept (all where None). Each becomes
    one string of marked turns and the spans of it that are assistant texts.

    Defined cases: a null role or text counts as empty; a null score as 0; an empty
    table gives no rows; other columns are not looked at; very long texts are formatted
    whole, a conversation being one cell. Nodes must be unique in their tree; those
    that lead into a cycle are on no path. Returns tree, leaf, rank, formatted, loss_spans (start from 0, length;
    code points of ``formatted``).
    """
    paths = reply_paths(nodes.select("tree", "node", "parent", F.col("score").cast("double").alias("score")))
    scored = paths.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("up").alias("deepest"))
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("deepest"), "leaf")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.select("tree", "leaf", "node", "up").join(said, ["tree", "node"])
    piece = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE), escaped(F.col("text")), F.lit(CLOSE))
    head = F.length(F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE)))
    turns = turns.select("tree", "leaf", (-F.col("up")).alias("at"), piece.alias("piece"), F.length(piece).alias("n"), head.alias("head"), F.length(escaped(F.col("text"))).alias("body"), (F.col("role") == "assistant").alias("loss"))
    so_far = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("from", F.coalesce(F.sum("n").over(so_far), F.lit(0)).cast("int"))
    span = F.when(F.col("loss"), F.struct((F.col("from") + F.col("head")).alias("start"), F.col("body").alias("length")))
    told = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    told = told.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), "loss_spans")
    return told.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])


def read_back(formatted: Column) -> Column:
    """The (role, text) turns that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")
    said = F.transform(parts, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(said, lambda p: F.struct(unescaped(F.split_part(p, F.lit(MIDDLE), F.lit(1))).alias("role"), unescaped(F.split_part(p, F.lit(MIDDLE), F.lit(2))).alias("text")))


def threads(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each row answers the row before it; null turns come first, equal ones stand by role, then text.

    ``tree`` is a struct of the id, so rows without one are a conversation too.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.struct("conv_id").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1, formatted and read back."""
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    out = format_trees(threads(convs.unionByName(extra)))
    out = out.withColumn("turns", read_back(F.col("formatted")))
    texts = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    out = out.withColumn("loss", F.array_join(texts, ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\\\'), '<|', '<\\|')"


OP8_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(MIDDLE) + len(CLOSE)} + length({_sql_escaped('role')}) + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
