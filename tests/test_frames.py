"""Windows look ahead by running frames from the end: one that shrinks is read anew for each row."""

import re

from pyspark.sql import functions as F

from quillwork.operators import overlay, redline

SHRINKS = re.compile(r"windowframe\((?:RowFrame|RangeFrame), (?!unboundedpreceding)[^)]*?(?:\(\))?, unboundedfollowing", re.I)


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_run_changes_look_ahead_by_running_frames(spark):
    runs = spark.createDataFrame([(1, 0, "ab", True), (1, 1, "cd", False)], "doc long, run int, text string, bold boolean")
    pairs = spark.createDataFrame([(1, [(0, "abc"), (-1, "d")])], "doc long, ops array<struct<op: int, text: string>>")
    told = overlay.run_changes(pairs, runs, runs.where("run = 0").unionByName(runs.where("run = 1").withColumn("text", F.lit("c"))), ["doc"], "run", ["bold"])
    assert not SHRINKS.search(plan_of(told))
    assert [(r.op, r.text, r.from_run) for r in told.orderBy("place").collect()] == [(0, "ab", 0), (0, "c", 1), (-1, "d", 1)]


def test_redlining_looks_ahead_by_running_frames(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(redline, "settled", lambda df: plans.append(df) or df.limit(0))
    parts = spark.createDataFrame([(1, "p", "<w:document/>")], "doc_id long, part_uri string, text string")
    plans.append(redline.in_place(parts, parts, "a", "2024-01-01"))
    assert not any(SHRINKS.search(plan_of(p)) for p in plans)


def test_marks_of_fields_are_dealt_by_number(spark):
    """Partitions of small rows were joined by their bytes, so a task's memory grew with the input."""
    from quillwork.lineage import tasks
    from quillwork.operators.markup import field_spans

    marks = spark.range(60).selectExpr("id div 6 AS doc_id", "id % 6 AS at", "element_at(array('begin', 'begin', 'separate', 'end', 'end', 'end'), cast(id % 6 AS int) + 1) AS mark")
    out = field_spans(marks, ["doc_id"], "at")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and f"{4 * tasks(spark)}), REPARTITION_BY_NUM" in plan
    assert sorted(tuple(r) for r in out.where("doc_id = 3").collect()) == [(3, 0, None, 4, 1, None), (3, 1, 2, 3, 2, 0)]


def test_similar_texts_across_tables_are_told_by_the_words_they_meet_in(spark):
    """Word sets were sorted, grouped, joined and intersected; rows of one id count apart."""
    from quillwork.operators.alignment import similar_across

    items = spark.createDataFrame([(1, "A b c d"), (2, "x"), (3, None)], "id long, text string")
    texts = spark.createDataFrame([(7, "a b c"), (7, "d c b a a"), (8, "d e f g h i j k"), (9, ""), (10, "A B C")], "id long, text string")
    out = similar_across(items, texts, 0.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "array_intersect" not in plan
    assert sorted(tuple(r) for r in out.collect()) == [(1, 7, 3, 4), (1, 7, 4, 4), (1, 10, 3, 4)]
    assert dict(out.dtypes) == {"item": "bigint", "id": "bigint", "shared": "int", "total": "int"}
