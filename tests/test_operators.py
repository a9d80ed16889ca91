"""Operators on small cases, round trips and properties."""

import random

import pytest
from pyspark.sql import functions as F

from quillwork.functions import text as X
from quillwork.operators import alignment as G
from quillwork.operators import search as S
from quillwork.sources import archives as A


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_lcs_is_the_same_at_any_size(monkeypatch):
    """Memory is bounded without another choice among equal alignments."""
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(2))
        told = []
        for cells in (4_000_000, 200, 1):
            monkeypatch.setattr(G, "TABLE_CELLS", cells)
            told.append(G.lcs(a, b))
        assert told[0] == told[1] == told[2]


@pytest.mark.parametrize("cells", [4_000_000, 4])
def test_lcs(monkeypatch, cells):
    monkeypatch.setattr(G, "TABLE_CELLS", cells)
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(13))] for _ in range(2))
        pairs = G.lcs(a, b)
        assert len(pairs) == brute_lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_unique_matches_are_those_of_brute_force(spark, tmp_path):
    from quillwork import plans  # noqa: F401
    from quillwork.registry import QUERIES

    docs = ["Thing.\nErlyeash went  over the hill today", "so “one two three four five six” said", "x <b>one</b> two three four five sixth", "short item, short item", "pre(one two three four five six", "one two three four and no more", "a b", "", None]
    items = ["Thing.\nErlyeash went over the hill", "one two three four five six", '"one two three four five six"', "short item", "b", "  ", "", None, "<b>one</b> two three four five six"]
    tables = {"documents": ("doc_id", docs), "benchmark": ("item_id", items)}
    for name, (key, texts) in tables.items():
        spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    pairs = spark.createDataFrame([(d, i, t, n) for d, t in enumerate(docs) for i, n in enumerate(items)], "doc_id long, item_id long, text string, needle string")
    every = pairs.select("doc_id", "item_id", S.unique_match(F.col("text"), F.col("needle")).alias("m"), S.unique_span(F.col("text"), F.col("needle")).alias("s")).where("m.status <> 'not_found'").collect()
    got = {(r.doc_id, r.item_id): r.status for r in QUERIES["unique_match_status"](spark, str(tmp_path)).collect()}
    hits = {(r.doc_id, r.item_id): r.m.status for r in every}
    assert {k: v for k, v in got.items() if v != "not_found"} == hits and (0, 0) in hits and (4, 1) in hits and (3, 3) in hits
    spans = {(r.doc_id, r.item_id): (r.start, r.stop) for r in QUERIES["unique_match_span"](spark, str(tmp_path)).collect()}
    assert spans.keys() == got.keys() and all(spans[r.doc_id, r.item_id] == (r.s.start, r.s.stop) for r in every)


def test_similar_texts_are_those_of_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    texts += ["one two three", "three two one", "one two three", "", "  ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {i: frozenset(t.split()) for i, t in enumerate(texts) if t and t.split()}
    score = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert {r.id: r.representative for r in G.word_set_classes(df).collect()} == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    links = {(r.a, r.b) for r in G.class_links(df).collect()}
    assert (40, 41) in links and (40, 42) not in links
    best = {i: max(((score(i, j), -j) for j in sets if j != i)) for i in sets}
    got = {r.id: (r.score, -r.partner) for r in G.best_partners(df, 0.5).collect()}
    assert got == {i: v for i, v in best.items() if v[0] >= 0.5}
    across = [(r.item, r.id) for r in G.similar_across(df.where("id % 3 = 0"), df, 0.5).collect()]
    assert sorted(across) == sorted((i, j) for i in sets if i % 3 == 0 for j in sets if score(i, j) >= 0.5)


def test_moves_hold_all_paragraphs(spark, tmp_path):
    from quillwork.plans.comparing import _moved

    texts = ["a", "a\nb", "a\nb\nc", "a\nb\nc\nd\ne\nf\ng", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.pair_id: (r.original, r.revised) for r in _moved(spark, str(tmp_path)).collect()}
    assert got == {0: (["a"], ["a"]), 1: (["a", "b"], ["a", "b"]), 2: (["a c", "b"], ["a", "b c"]), 3: (["a c", "b", "d f", "e", "g"], ["a", "b c", "d", "e f", "g"]), 4: ([""], [""])}


def test_lcs_tie_goes_to_the_shorter_revision():
    assert G.lcs("ab", "ba") == [(1, 0)]


def test_comparison_round_trips():
    rng = random.Random(2)
    words = "alpha beta gamma delta".split()
    for _ in range(60):
        a, b = ([" ".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(5))] for _ in range(2))
        atoms = G.compare_texts(a, b)
        side = lambda keep, k: ["".join(x[3] for x in atoms if x[0] in keep and x[k] == p) for p in range(len(b if k == 2 else a))]
        assert side(("Equal", "Inserted"), 2) == b
        assert side(("Equal", "Deleted"), 1) == a
    assert {x[0] for x in G.compare_texts(["same text"], ["same text"])} == {"Equal"}


def test_greedy_pairs_take_each_once():
    assert G.greedy_pairs(["a b", "a b"], ["a b", "a c"], 0.3) == [(0, 0, 1.0), (1, 1, 1 / 3)]
    assert G.greedy_pairs([""], ["", "x"], 0.5) == [(0, 0, 1.0)]


def test_paragraph_operations():
    ops = G.paragraph_operations(["one two", "gone away", "three four"], ["one two", "new words", "three four five"])
    assert ops == [("unchanged", 0, 0), ("inserted", -1, 1), ("deleted", 1, -1), ("modified", 2, 2)]


def test_staged_match(spark):
    rows = [
        ("exact", "a cat sat", "cat", "unique"), ("exact", "aaa", "aa", "multiple"), ("clean", "a <b>c</b>at", "cat", "unique"),
        ("quote_normalized", "say “hi”", 'say "hi"', "unique"), ("flexible_whitespace", "a  b", "a b", "unique"),
        ("quote_optional", 'the "term" is', "the term is", "unique"), (None, "x", "y", "not_found"), (None, "x", "", "not_found"),
    ]
    df = spark.createDataFrame(rows, "mode string, text string, needle string, status string")
    got = df.select("mode", "text", "needle", "status", S.unique_match(F.col("text"), F.col("needle")).alias("m"), S.unique_span(F.col("text"), F.col("needle")).alias("s")).collect()
    for r in got:
        assert (r.m.status, r.m.mode) == (r.status, r.mode), r
        if r.status == "unique":
            assert r.text[r.s.start : r.s.stop].strip("<b>") != ""
    assert [(r.s.start, r.s.stop) for r in got if r.mode == "quote_optional"] == [(0, 13)]


def test_normalisers_are_idempotent(spark):
    df = spark.createDataFrame([("  A  B\t\nc ",), ("",), (None,)], "t string")
    once = df.select(X.normalised(F.col("t")).alias("t"))
    assert [r.t for r in once.collect()] == ["a b c", "", ""]
    assert once.select(X.normalised(F.col("t")).alias("u")).collect() == [(r.t,) for r in once.collect()]


def test_similarity_is_symmetric(spark):
    df = spark.createDataFrame([("a b c", "B c d"), ("", ""), ("a", "")], "a string, b string")
    rows = df.select(X.jaccard(F.col("a"), F.col("b")).alias("x"), X.jaccard(F.col("b"), F.col("a")).alias("y")).collect()
    assert [r.x for r in rows] == [0.5, 1.0, 0.0] == [r.y for r in rows]


MAIN = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Title"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="4"/></w:numPr></w:pPr><w:r><w:rPr><w:b/><w:color w:val="auto"/><w:sz w:val="24"/></w:rPr><w:t>Bold</w:t><w:tab/><w:t>x</w:t></w:r></w:p>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>REF a</w:instrText></w:r><w:r><w:t>hidden</w:t></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:ins w:author="me"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:author="me"><w:r><w:delText>old</w:delText></w:r></w:del></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


def test_archives_are_flattened(spark):
    parts = [("d", "word/document.xml", MAIN.encode()), ("d", "word/footnotes.xml", b'<w:footnotes xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:footnote w:id="1"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>')]
    files = A.packed(spark.createDataFrame(parts, "doc_id string, part_uri string, content binary"))
    bad = spark.createDataFrame([("bad", bytearray(b"no zip"))], "doc_id string, content binary")
    rows = A.entries(files.unionByName(bad)).cache()
    assert rows.where("error is not null").count() == 1
    paras = A.paragraphs(rows).orderBy("para_idx").collect()
    assert [p.text for p in paras] == ["Bold\tx", "7newold", "cell"]
    assert (paras[0].style_id, paras[0].num_id, paras[0].level) == ("Title", 4, 1) and paras[2].table_idx == 0
    runs = A.runs(rows).orderBy("para_idx", "run_idx").collect()
    assert runs[0].bold and runs[0].color is None and runs[0].size == 24
    assert [(r.text, r.rev_tag, r.is_field_result) for r in runs if r.para_idx == 1] == [("7", None, True), ("new", "ins", False), ("old", "del", False)]
    assert [n.text for n in A.footnotes(rows).collect()] == ["note"]
    assert A.part(rows, "word/styles.xml").where("error is not null").count() == 2
    assert A.changed_parts(rows, rows).count() == 0


def test_streams(spark, tmp_path):
    from quillwork import streaming

    spark.createDataFrame([(1, "the one\nnone", "en", "s", 8)], streaming.DOCUMENTS).write.parquet(f"{tmp_path}/in")
    found = streaming.matches(streaming.documents(spark, f"{tmp_path}/in"), ["the"], whole_word=True)
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("found").collect()] == [(1, 0, 1, "the")]
