import random
import zlib

from quillwork.llm.sharding import kd_shards, op1_kd_shards


def test_all_rows_once_gapless_and_even(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('é', cast(id % 97 AS int)) AS text", "if(id % 3 = 0, 'hot', cast(id % 50 AS string)) AS source", "'en' AS lang", "id % 97 AS n_chars")
    out = kd_shards(docs, n_shards=24).toPandas()
    assert sorted(out.id) == list(range(3000))
    by = out.groupby("shard")
    assert sorted(by.groups) == list(range(24))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in by)
    weights = by["size"].sum()
    assert weights.max() - weights.min() <= 3 * (2 * 96 + 8)
    row = out[out.id == 5].iloc[0]
    assert row["size"] == 18 and row.text_crc32 == zlib.crc32("é".encode() * 5)


def test_widest_dimension_is_cut_first(spark):
    docs = spark.createDataFrame([(i, f"{i:04d}", "s", "en", i) for i in range(64)], "doc_id long, text string, source string, lang string, n_chars long")
    out = kd_shards(docs, dims=("n_chars",), n_shards=4).toPandas()
    assert out.groupby("shard").id.agg(lambda x: x.max() - x.min()).tolist() == [15] * 4


def brute_medians(rows, first, k):
    """Shards of (size, id) rows in order, split again and again at the weighted median."""
    if k == 1:
        return {i: first for _, i in rows}
    target, below, cut = sum(s for s, _ in rows) * (k // 2) / k, 0, 0
    while cut < len(rows) and below + rows[cut][0] <= target:
        below += rows[cut][0]
        cut += 1
    if cut < len(rows) and below + rows[cut][0] - target <= target - below:
        cut += 1
    return brute_medians(rows[:cut], first, k // 2) | brute_medians(rows[cut:], first + k // 2, k - k // 2)


def test_splits_are_weighted_medians(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(40) + str(i), "s", "en", i) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    for n in (2, 5, 24):
        got = {r.id: r.shard for r in kd_shards(docs, dims=("n_chars",), n_shards=n).collect()}
        assert got == brute_medians([(len(t) + 8, i) for i, t, *_ in rows], 0, n)


def test_copies_stay_together(spark):
    """Groups of copies with other sources and languages lie in one shard; only a group as heavy as a shard is cut."""
    rng = random.Random(9)
    rows = [(i, f"text {i % 1500} " + "y" * (i % 1500 % 90), f"s{rng.randrange(9)}", rng.choice(["en", "de", None]), rng.choice([None, i % 77])) for i in range(4500)]
    rows += [(10_000 + i, "hot " * 12, f"s{rng.randrange(9)}", "en", i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = kd_shards(docs, n_shards=12).toPandas().merge(docs.select("doc_id", "text").toPandas(), left_on="id", right_on="doc_id")
    cut = out.groupby("text").shard.nunique()
    assert set(cut[cut > 1].index) == {"hot " * 12}
    weights = out.groupby("shard")["size"].sum()
    assert weights.max() <= 1.1 * weights.mean() and weights.min() >= 0.9 * weights.mean()


def test_ties_and_very_long_texts(spark):
    rows = [(i % 3, "same", "s", "en", 4) for i in range(300)] + [(9, "long " * 100_000, "s", "en", None)]
    out = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), n_shards=4).toPandas()
    assert len(out) == 301 and out["size"].max() == 500_008
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_target_bytes(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 92) AS text", "'s' AS source", "'en' AS lang", "92L AS n_chars")
    out = kd_shards(docs, target_bytes=10_000).groupBy("shard").sum("size").toPandas()
    assert out["sum(size)"].tolist() == [10_000] * 10


def test_edges(docs, repeated, empty, sf_dir, spark):
    assert kd_shards(empty, n_shards=24).count() == 0
    one = {r.id: r for r in kd_shards(docs, n_shards=3).collect()}
    assert one[1].size == 8 and one[1].text_crc32 == 0 and None in one and len(one) == docs.count()
    assert kd_shards(repeated, n_shards=3).count() == 2 * docs.count()
    out = op1_kd_shards(spark, sf_dir(documents=docs))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(out.dtypes)["grown_shard"] == "int" and {r.law for r in out.collect()} == {"bytes"}
