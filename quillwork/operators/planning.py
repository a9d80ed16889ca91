"""Edit plans: steps from JSON, conflicts between plans, validation, application."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import settled
from .search import match_span

STEP = "struct<step_id:string,operation:string,op:string,target_paragraph_id:string,positional_anchor_node_id:string,position:string,old_string:string,new_string:string,range:struct<start:int,`end`:int>>"
PLAN_BYTES = 1 << 20
LIST = r"^\s*\["


def steps(plans: DataFrame) -> DataFrame:
    """Steps of plans (doc_id, plan_index, plan_id, base_revision, steps as JSON text), one row each.

    A step without an id is named after its place. A range counts only if it is not
    empty and not negative. Plans without steps here are told by ``plan_errors``.
    """
    parsed = F.from_json(F.when((F.octet_length("steps") <= PLAN_BYTES) & F.regexp_like("steps", F.lit(LIST)), F.col("steps")), f"array<{STEP}>")
    rows = plans.select("doc_id", "plan_index", "plan_id", "base_revision", F.posexplode(parsed).alias("step_index", "s"))
    auto = F.concat(F.lit("auto_"), (F.col("plan_index") + 1).cast("string"), F.lit("_"), (F.col("step_index") + 1).cast("string"))
    op = F.lower(F.trim(F.coalesce("s.operation", "s.op")))
    good = (F.col("s.range.start") >= 0) & (F.col("s.range.end") > F.col("s.range.start"))
    return rows.select(
        "doc_id", "plan_index", "plan_id", "base_revision", "step_index",
        F.coalesce(F.nullif(F.trim("s.step_id"), F.lit("")), auto).alias("step_id"), op.alias("operation"),
        F.col("s.target_paragraph_id").alias("para_id"), F.col("s.positional_anchor_node_id").alias("anchor_id"), F.upper("s.position").alias("position"),
        F.when(good, F.col("s.range.start")).alias("start"), F.when(good, F.col("s.range.end")).alias("stop"),
        F.col("s.old_string").alias("old_string"), F.col("s.new_string").alias("new_string"),
    )


def plan_errors(plans: DataFrame) -> DataFrame:
    """Plans that are refused, with the reason: over 1 MiB, or no list of steps."""
    over = F.octet_length("steps") > PLAN_BYTES
    parsed = F.from_json(F.when(~over, F.col("steps")), f"array<{STEP}>")
    why = F.when(over, "plan file over 1 MiB").when(parsed.isNull() | ~F.regexp_like("steps", F.lit(LIST)), "not a list of steps")
    return plans.withColumn("error", why).where("error is not null").select("doc_id", "plan_index", "plan_id", "error")


REF = ("plan_index", "step_index", "step_id")
# The codes of conflicts.
DUPLICATE_ID, UNKNOWN_RANGE, OVERLAP, SLOT, REVISION = "DUPLICATE_STEP_ID", "UNKNOWN_REPLACE_RANGE", "OVERLAPPING_REPLACE_RANGE", "INSERT_SLOT_COLLISION", "BASE_REVISION_CONFLICT"


def conflicts(all_steps: DataFrame, shared_revision: bool = True) -> DataFrame:
    """(doc_id, code, subject, refs): what keeps the plans of a document from being merged.

    Repeated step ids; base revisions that differ; replacements in one paragraph whose
    spans overlap or are unknown; insertions into one slot. Spans are swept by their
    start: each that begins before the furthest end so far is told once, with the step
    that reaches that far, so a paragraph with many edits gives no pairs of them all.
    """
    all_steps = settled(all_steps)  # parsed once for all rules
    ref = F.struct(*REF)
    told = lambda df, code, subject, refs: df.select("doc_id", F.lit(code).alias("code"), subject.cast("string").alias("subject"), refs.alias("refs"))
    refs = F.array_sort(F.collect_list(ref)).alias("refs")
    ids = all_steps.groupBy("doc_id", "step_id").agg(refs, F.count("*").alias("n")).where("n > 1")
    slots = all_steps.where("operation = 'insert_paragraph' AND anchor_id IS NOT NULL AND position IS NOT NULL").withColumn("slot", F.concat_ws("::", "anchor_id", "position")).groupBy("doc_id", "slot").agg(refs, F.count("*").alias("n")).where("n > 1")
    edits = all_steps.where("operation = 'replace_text' AND para_id IS NOT NULL")
    by = edits.groupBy("doc_id", "para_id").agg(refs, F.count("*").alias("n"), F.count_if(F.col("start").isNull()).alias("unknown"))
    unknown = by.where("n > 1 AND unknown > 0")
    clear = edits.join(by.where("n > 1 AND unknown = 0").select("doc_id", "para_id"), ["doc_id", "para_id"], "left_semi").select("doc_id", "para_id", "start", "stop", ref.alias("r"))
    before = Window.partitionBy("doc_id", "para_id").orderBy("start", "r").rowsBetween(Window.unboundedPreceding, -1)
    swept = clear.withColumn("far", F.max(F.struct("stop", "r")).over(before)).where("far.stop > start")
    found = [told(ids, DUPLICATE_ID, F.col("step_id"), F.col("refs")), told(unknown, UNKNOWN_RANGE, F.col("para_id"), F.col("refs")), told(swept, OVERLAP, F.col("para_id"), F.array("far.r", "r")), told(slots, SLOT, F.col("slot"), F.col("refs"))]
    if shared_revision:
        revs = all_steps.groupBy("doc_id").agg(F.array_sort(F.collect_set("base_revision")).alias("revs")).where(F.size("revs") > 1)
        none = F.array().cast(all_steps.select(F.array(ref)).schema[0].dataType)
        found.append(told(revs, REVISION, F.array_join("revs", ", "), none))
    return reduce(DataFrame.unionByName, found)


def merged(all_steps: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The steps of each document's plans with a key of their order: plan by plan, step by step.

    A document whose plans conflict (``found``, or what ``conflicts`` finds) gets no
    merged plan.
    """
    if found is None:
        found = conflicts(all_steps)
    rows = all_steps.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows.withColumn("order", F.shiftleft(F.col("plan_index").cast("long"), 32) + F.col("step_index"))


def step_errors(all_steps: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Steps with what is wrong with each: unknown operation, unknown paragraph, missing text, no single match."""
    from .search import unique_match

    texts = paragraphs.select("doc_id", F.col("para_id").alias("__id"), F.col("text").alias("__text"))
    rows = all_steps.withColumn("__id", F.coalesce("para_id", "anchor_id")).join(texts.withColumn("__known", F.lit(True)), ["doc_id", "__id"], "left")
    replaces, inserts = F.col("operation") == "replace_text", F.col("operation") == "insert_paragraph"
    found = unique_match(F.col("__text"), F.col("old_string"))["status"]
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(replaces | inserts, F.lit(False)), F.lit("unknown operation")),
        F.when((replaces & F.col("para_id").isNull()) | (inserts & F.col("anchor_id").isNull()), F.lit("no paragraph named")),
        F.when(F.coalesce("para_id", "anchor_id").isNotNull() & F.col("__known").isNull(), F.lit("unknown paragraph")),
        F.when(F.col("new_string").isNull(), F.lit("no new text")),
        F.when(inserts & ~F.coalesce(F.col("position").isin("BEFORE", "AFTER"), F.lit(False)), F.lit("no position")),
        F.when(replaces & F.col("old_string").isNull(), F.lit("no old text")),
        F.when(replaces & F.col("__known").isNotNull() & F.col("old_string").isNotNull() & (found != "unique"), F.concat(F.lit("old text: "), found)),
    ))
    return rows.withColumn("errors", errors).drop("__id", "__text", "__known")


def _run_plan(paras: list[list], todo: list[dict]) -> tuple[int, dict | None, str | None]:
    """Carry out steps on [id, text] paragraphs in place; how many were done, the step that failed, and why."""
    for n, step in enumerate(todo):
        replaces = step["operation"] == "replace_text"
        target = step["para_id"] if replaces else step["anchor_id"]
        at = next((i for i, p in enumerate(paras) if p[0] == target), None)
        if step["operation"] not in ("replace_text", "insert_paragraph"):
            return n, step, "unknown operation"
        if at is None:
            return n, step, "unknown paragraph"
        if replaces:
            span = match_span(paras[at][1], step["old_string"])
            if span is None:
                return n, step, "old text does not match once"
            paras[at][1] = paras[at][1][: span[0]] + (step["new_string"] or "") + paras[at][1][span[1] :]
        elif step["position"] not in ("BEFORE", "AFTER"):
            return n, step, "no position"
        else:
            new = [[f"{step['step_id']}_{k}", t] for k, t in enumerate(re.split(r"\n{2,}", step["new_string"] or ""), 1)]
            at += step["position"] == "AFTER"
            paras[at:at] = new
    return len(todo), None, None


def applied(all_steps: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, completed, failed_index, failed_step, error): each document after its plan.

    ``paragraphs``: doc_id, para_idx, para_id, text. Steps run in their order and see
    what those before them did, so each document is one fold; its plan stops at the
    first step that fails, and steps done before it stay done. Inserted paragraphs get
    the step's id and a number. Documents without a plan are as they were.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                paras = [[p["para_id"], p["text"]] for p in r.paras]
                done, failed, why = _run_plan(paras, list(r.steps) if r.steps is not None else [])
                out.append((r.doc_id, [{"para_id": a, "text": b} for a, b in paras], done, done if failed else None, failed["step_id"] if failed else None, why))
            yield pd.DataFrame(out, columns=["doc_id", "paragraphs", "completed", "failed_index", "failed_step", "error"]).astype({"failed_index": "Int32"})

    todo = all_steps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("plan_index", "step_index", "step_id", "operation", "para_id", "anchor_id", "position", "old_string", "new_string"))).alias("steps"))
    docs = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_idx", "para_id", "text"))).alias("paras"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(todo, "doc_id", "left").mapInPandas(fold, f"doc_id {kind}, paragraphs array<struct<para_id:string,text:string>>, completed int, failed_index int, failed_step string, error string")


def opened(documents: DataFrame) -> DataFrame:
    """A new plan for each document (name, revision): its context id and the revision that it is made for."""
    seed = F.sha1(F.concat_ws(":", "name", F.col("revision").cast("string")))
    return documents.withColumn("plan_context_id", F.concat(F.lit("plan_"), F.left(seed, F.lit(12)))).withColumn("base_revision", F.col("revision"))
