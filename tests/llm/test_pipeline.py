import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_simhash import brute_components, brute_fingerprint  # noqa: E402
from .test_suffix import brute, brute_covers  # noqa: E402
from .test_text_models import brute_leaks, labelled, tables  # noqa: E402, F401


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "sentencepiece"]


def test_each_stage_matches_brute_force(spark, tables):  # noqa: F811
    from quillwork.llm.toxicity import op9_classifier_chain

    toxic = {r.doc_id for r in op9_classifier_chain(spark, tables).where("toxic").collect()}
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect() if r.doc_id not in toxic}
    comp = brute_components([(i, brute_fingerprint(t)) for i, t in left.items()])
    left = {i: t for i, t in left.items() if comp[i] == i or i is None}
    low = -(1 << 63)
    spans = brute([(low if i is None else i, (t or "").encode()) for i, t in left.items()])
    whole = {i for i, t in left.items() if t and spans[low if i is None else i][1] == len(t.encode())}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, tables).collect()}
    covers = brute_covers([(low if i is None else i, (t or "").encode()) for i, t in left.items()])
    cut = {}
    for i, t in left.items():
        if i not in whole:
            cut[i] = bytes(b for b, c in zip((t or "").encode(), covers[low if i is None else i]) if not c).decode(errors="ignore")
    leaking = {i for i, _ in brute_leaks(list(cut.items()), items)}
    assert set(out) == set(cut) - leaking
    assert all(r.round_trip and r.n_bytes == len(cut[i].encode()) and len(r.token_ids) == r.n_tokens for i, r in out.items())


def test_empty_tables(spark, tables, sf_dir, tmp_path):  # noqa: F811
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


#: Names that stages might use, or used, for columns of their own.
CLASHING = ["__p_toxic", "__p_junk", "p_toxic", "__spans", "__id", "__th", "__name", "__text", "_id", "_th", "_spans", "_name", "_p_toxic", "___id", "id", "h", "name", "fp", "root", "spans", "__place", "row", "component_id"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]], ids=lambda f: f.__name__)
def test_stages_pass_clashing_columns_on(spark, tables, stage):  # noqa: F811
    """The same rows stay whatever other columns are called, with their values, also where ids repeat."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs.where("doc_id = 8"))
    more = docs.withColumns({n: F.lit(f"own {n}") for n in CLASHING}).repartition(3)
    out = stage(spark, more, tables)
    assert out.columns == more.columns
    kept = out.collect()
    assert all(r[n] == f"own {n}" for r in kept for n in CLASHING)
    plain = stage(spark, docs, tables).select("doc_id", "text")
    assert sorted(repr((r.doc_id, r.text)) for r in kept) == sorted(repr((r.doc_id, r.text)) for r in plain.collect())
