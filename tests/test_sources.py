"""File sources: plans, results, fixtures, archives on disk."""

import json

import pytest

from pyspark.sql import functions as F

from quillwork.operators import planning as P
from quillwork.sources import archives as A
from quillwork.sources import reports as R


def test_plan_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"operation": "replace_text", "target_paragraph_id": "p", "old_string": "x", "new_string": "y"}]))
    (tmp_path / "big.json").write_text("[" + " " * (1 << 20) + "]")
    steps = P.steps(R.plan_files(spark, str(tmp_path))).collect()
    assert [(s.operation, s.para_id) for s in steps] == [("replace_text", "p")]


def test_results_and_stories(spark, tmp_path):
    from quillwork.operators.groups import stories

    for i, body in enumerate(['{"story": "a", "status": "passed", "stop": 5}', '{"story": "b", "status": "failed", "stop": 9}', "no json"]):
        (tmp_path / f"{i}.json").write_text(body)
    rows = R.test_results(spark, str(tmp_path))
    assert sorted(r.status for r in rows.collect()) == ["failed", "passed", "unknown"]
    m = stories(rows).first()
    assert (m.stories, m.results, m.unknown, m.last_stop, m.percent_covered) == (2, 3, 1, 9, 50.0)


def test_discovery_and_archives(spark, tmp_path):
    docs = spark.createDataFrame([("d", ["one", "two & <three>"])], "doc_id string, paragraphs array<string>")
    content = A.packed(A.document_xml(docs)).first().content
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "simple-1.docx").write_bytes(content)
    (tmp_path / "other.txt").write_text("x")
    found = R.discovered(spark, str(tmp_path)).collect()
    assert [(f.name, f.size, f.category) for f in found] == [("simple-1.docx", len(content), "simple")]
    rows = A.entries(A.archives(spark, str(tmp_path / "sub")))
    assert A.document_text(A.paragraphs(rows)).first().text == "one\ntwo & <three>"
    assert R.missing_files(spark.createDataFrame([("simple-1.docx",), ("gone.docx",)], "name string"), R.discovered(spark, str(tmp_path))).first().name == "gone.docx"


def test_styles_and_numbering(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {ns}><w:style w:styleId="A"><w:name w:val="Base"/><w:pPr><w:jc w:val="both"/></w:pPr></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:b w:val="0"/><w:sz w:val="22"/></w:rPr></w:style></w:styles>'
    numbering = f'<w:numbering {ns}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="9"/></w:lvlOverride></w:num></w:numbering>'
    rels = '<Relationships><Relationship Id="r1" Type="http://x/hyperlink" Target="http://t"/><Relationship Id="r2" Type="http://x/image" Target="i"/></Relationships>'
    parts = [("d", "word/styles.xml", styles.encode()), ("d", "word/numbering.xml", numbering.encode()), ("d", "word/_rels/document.xml.rels", rels.encode())]
    rows = spark.createDataFrame(parts, "doc_id string, part_uri string, content binary")
    assert [(s.style_id, s.based_on, s.align, s.bold, s.size) for s in A.styles(rows).orderBy("style_id").collect()] == [("A", None, "both", None, None), ("B", "A", None, False, 22)]
    assert [(n.num_id, n.level, n.start, n.format) for n in A.number_levels(rows).orderBy("num_id").collect()] == [(1, 0, 3, "upperRoman"), (2, 0, 9, "upperRoman")]
    assert [tuple(r) for r in A.relationships(rows).collect()] == [("d", "r1", "http://t")]


def test_continued_numbering(spark):
    from quillwork.operators.ordered import continued_labels

    rows = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 1, 1), (1, 1, 2, 0)], "doc_id long, num_id long, para_idx int, level int")
    rows = rows.withColumns({"starts": F.array(F.lit(4), F.lit(5)), "formats": F.array(F.lit("decimal"), F.lit("decimal")), "templates": F.array(F.lit("%1."), F.lit("%1.%2"))})
    assert [r.label for r in continued_labels(rows).orderBy("para_idx").collect()] == ["4.", "5.", "5."]


def test_saved_archives_are_not_overwritten(spark, tmp_path):
    from quillwork.operators import alignment

    rows = spark.createDataFrame([(1, ["one", "two"], ["one", "three"])], "pair_id long, original array<string>, revised array<string>")
    files = A.variants(alignment.compare_pairs(rows), "a", "2020-01-01T00:00:00Z")
    A.save(files, f"{tmp_path}/out")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        A.save(files, f"{tmp_path}/out")
    A.save(files, f"{tmp_path}/out", overwrite=True)
    assert {r.variant for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"clean", "tracked"}


def test_oversized_parts_and_plans_are_told(spark, monkeypatch):
    from quillwork.operators import planning

    monkeypatch.setattr(A, "MAX_ENTRY_BYTES", 10)
    texts = spark.createDataFrame([("1", ["far too long a paragraph"])], "doc_id string, paragraphs array<string>")
    rows = A.entries(A.packed(A.document_xml(texts)))
    assert [r.error for r in rows.collect()] == ["entry too large"] and "too large" in A.part(rows, A.PARTS[0]).first().error
    plans = spark.createDataFrame([(1, 0, "a", 1, "[" + " " * (1 << 20) + "]"), (1, 1, "b", 1, '{"steps": 1}'), (1, 2, "c", 1, '[{"operation": "insert_paragraph"}]')], "doc_id long, plan_index int, plan_id string, base_revision int, steps string")
    assert {(r.plan_id, r.error) for r in planning.plan_errors(plans).collect()} == {("a", "plan file over 1 MiB"), ("b", "not a list of steps")}
    assert [r.plan_id for r in planning.steps(plans).collect()] == ["c"]


def test_archives_are_read_in_one_pass_and_few_batches(spark):
    """Each archive once had a frame of its own at every step, was packed and read twice for one part, and thousands met in one task."""
    texts = spark.range(200).selectExpr("cast(id AS string) AS doc_id", "array('a', cast(id AS string)) AS paragraphs")
    rows = A.entries(A.packed(A.document_xml(texts)))
    part = A.part(rows, A.PARTS[1])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan and "REPARTITION_BY_NUM" in plan
    assert {(r.text, r.error) for r in part.collect()} == {(None, "missing part: word/styles.xml")}
    assert {(r.doc_id, r.para_idx, r.text) for r in A.paragraphs(rows).collect()} == {(str(i), k, t) for i in range(200) for k, t in enumerate(("a", str(i)))}


def test_small_batches_and_repeated_parts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(A, "BATCH_BYTES", 64)
    texts = spark.range(40).repartition(1).selectExpr("cast(id AS string) AS doc_id", "array('some text') AS paragraphs")
    assert A.paragraphs(A.entries(A.packed(A.document_xml(texts)))).count() == 40
    # a part asked for twice in an archive is told twice
    twice = spark.createDataFrame([("a", "x", b"1", None), ("a", "x", b"2", None), ("b", "y", b"3", None)], "doc_id string, part_uri string, content binary, error string")
    assert sorted((r.doc_id, r.text or "", r.error or "") for r in A.part(twice, "x").collect()) == [("a", "1", ""), ("a", "2", ""), ("b", "", "missing part: x")]
