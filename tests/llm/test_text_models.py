import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillwork.llm import decontam, toxicity
from quillwork.llm._quantile import cut_points
from quillwork.llm.decontam import Index, drop_leaks, leaks, leaks_in, make_items, op5_simhash_windows
from quillwork.llm.resampling import gumbel_top, ngram_buckets, op2_importance_resampling, resample
from quillwork.llm.toxicity import drop_toxic, fit_chain, op9_classifier_chain, word_features

from .conftest import prose


def labelled(n):
    texts, toxic, junk = [], [], []
    for i in range(n):
        t = prose(i, 60)
        if i % 4 == 0:
            t = t.replace("wind", "vilefool").replace("glass", "scumbagly") + " vilefool"
        if i % 5 == 0:
            t = "$$$ &&& " * 20 + t
        texts.append(t)
        toxic.append(int(i % 4 == 0))
        junk.append(int(i % 5 == 0))
    return texts, np.array(toxic), np.array(junk)


@pytest.fixture
def tables(spark, docs, sf_dir):
    texts, toxic, junk = labelled(200)
    rows = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(5000 + i, 1 - int(j), int(t)) for i, (j, t) in enumerate(zip(junk, toxic))] + [(5000, None, 1)], "doc_id long, quality int, toxic int").where("doc_id < 5150")
    bench = spark.createDataFrame([(1, prose(99, 60)), (2, prose(77, 30)), (3, "two words"), (4, None), (5, "..."), (6, "absent item of six words here")], "item_id long, text string")
    return sf_dir(documents=docs.unionByName(rows, allowMissingColumns=True), labels=labels, benchmark=bench)


def test_chain_is_fitted_and_holds_out(spark):
    texts, toxic, junk = labelled(400)
    chain = fit_chain(texts[:300], np.column_stack([junk, toxic])[:300], ("junk", "toxic"))
    p = chain.predict(*word_features(pa.array(texts[300:], pa.large_string())), 100)
    assert ((p[:, 1] > 0.5) == (toxic[300:] == 1)).mean() >= 0.98
    assert len(chain.models[1].dense) == 1


def test_toxic_query_and_stage(spark, docs, empty, repeated, tables):
    out = op9_classifier_chain(spark, tables)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[5152].toxic and not rows[5153].toxic and rows[1].p_toxic == rows[2].p_toxic and not rows[1].toxic
    all_docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = drop_toxic(spark, all_docs, tables)
    assert kept.columns == all_docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {i for i, r in rows.items() if not r.toxic}
    chain = toxicity.fit_chain([], np.zeros((0, 2)), ("junk", "toxic"))
    assert toxicity.decided(toxicity.score_chain(docs, chain)).where("toxic").count() == 0
    assert toxicity.score_chain(empty, chain).count() == 0 and toxicity.score_chain(repeated, chain).count() == 2 * docs.count()


def test_chain_sample_takes_3000_of_each_class(spark):
    docs = spark.range(6300).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    row, bucket, flags = toxicity.labelled_sample(docs, docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS junk", "int(doc_id % 2) AS toxic"), ("junk", "toxic"))
    assert len(flags) == 6000 and flags[:, 1].sum() == 3000 and row.max() == 5999 and len(row) == len(bucket)


def test_sample_of_repeated_ids_does_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame([(1, "one text"), (1, "other words here"), (1, None), (2, "two"), (2, "two"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 1), (2, None, 1), (3, 0, 0), (None, 1, 1)], "doc_id long, junk int, toxic int")
    both = [toxicity.labelled_sample(d, labels.repartition(n), ("junk", "toxic")) for d, n in ((docs.repartition(3), 2), (docs.coalesce(1), 1))]
    for a, b in zip(*both):
        assert np.array_equal(a, b)
    assert sorted(map(tuple, both[0][2].tolist())) == [(0.0, 1.0), (1.0, 0.0)]


def plain_logistic(x, dense, y, steps=100, rate=0.05, decay=1e-4):
    """The same model over a full matrix: class ratios as feature values, balanced log loss, Adam."""
    n1, n0 = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    used = np.flatnonzero(x.sum(0) > 1)
    with_, ones = x.sum(0)[used], (x * y[:, None]).sum(0)[used]
    ratio = np.log((ones + 2) / (n1 + 4)) - np.log((with_ - ones + 2 * n0 / n1) / (n0 + 4 * n0 / n1))
    full = np.column_stack([x[:, used] * ratio, dense, np.ones(len(y))])
    theta, m, v = np.zeros(full.shape[1]), 0.0, 0.0
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for t in range(1, steps + 1):
        grad = full.T @ (weight * (1 / (1 + np.exp(-full @ theta)) - y)) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return lambda x, dense: 1 / (1 + np.exp(-np.column_stack([x[:, used] * ratio, dense, np.ones(len(x))]) @ theta))


def test_chain_equals_a_plain_fit():
    """Both models, their out-of-fold inputs and the predictions against full matrices."""
    texts, toxic, junk = labelled(120)
    row, bucket = word_features(pa.array(texts, pa.large_string()), 10)
    x = np.zeros((120, 1 << 10))
    x[row, bucket] = 1
    y = np.column_stack([junk, toxic]).astype(float)
    none, fold, seen = np.zeros((120, 0)), np.arange(120) % 4, np.zeros(120)
    for f in range(4):
        seen[fold == f] = plain_logistic(x[fold != f], none[fold != f], y[fold != f, 0])(x[fold == f], none[fold == f])
    first, second = plain_logistic(x, none, y[:, 0]), plain_logistic(x, seen[:, None], y[:, 1])
    p = first(x, none)
    got = fit_chain(texts, y, ("junk", "toxic"), bits=10).predict(row, bucket, 120)
    assert np.allclose(got[:, 0], p, atol=1e-3) and np.allclose(got[:, 1], second(x, p[:, None]), atol=1e-3)


def test_cut_points_are_exact(spark):
    rows = spark.range(5000).selectExpr("id % 3 AS g", "id * id AS k", "1L AS w")
    cuts = cut_points(rows, F.col("g"), F.col("k"), F.col("w"), {0: (0, 4999**2, 1000.0), 1: (0, 4999**2, 10.0)})
    assert cuts[0][1] == 1000 and cuts[1][1] == 10
    assert rows.where((F.col("g") == 0) & (F.col("k") < cuts[0][0])).count() == 1000


def test_gumbel_top_share(spark):
    rows = spark.range(2000).selectExpr("id", "if(id < 1000, 50D, 0D) AS log_ratio")
    kept = gumbel_top(rows, 0.5)
    assert kept.count() == 1000 and kept.where("id >= 1000").count() == 0
    flat = gumbel_top(rows.withColumn("log_ratio", F.lit(0.0)), 0.25)
    assert flat.count() == 500 and 60 <= flat.where("id < 500").count() <= 190
    assert gumbel_top(rows, 1.0).count() == 2000


def test_resampling_equals_brute_force(spark, docs, tables):
    """Ratios, noise and the selection of the whole query against plain counting."""
    from collections import Counter

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").where("quality is not null").collect()}
    grams = [ngram_buckets(pa.array([t or ""], pa.large_string()))[1].tolist() for _, t in rows]
    raw, target = Counter(), Counter()
    for (i, _), g in zip(rows, grams):
        raw.update(g)
        if labels.get(i) == 1:
            target.update(g)
    size, all_raw, all_target = 1 << 16, sum(raw.values()), sum(target.values())
    log = lambda c, n: math.log((c + 1) / (n + size))
    ratio = {i: sum(log(target[b], all_target) - log(raw[b], all_raw) for b in g) for (i, _), g in zip(rows, grams)}
    ids = spark.createDataFrame([(i,) for i, _ in rows], "id long").selectExpr("id", "xxhash64(id, 17) AS h").collect()
    noise = {r.id: -math.log(-math.log((((r.h & ((1 << 64) - 1)) >> 11) + 0.5) / (1 << 53))) for r in ids}
    share = sum(labels.values()) / len(labels)
    best = sorted(ratio, key=lambda i: -(ratio[i] + noise[i]))[: round(share * len(rows))]
    got = {r.doc_id: r for r in op2_importance_resampling(spark, tables).collect()}
    assert set(got) == set(best)
    assert all(abs(r.log_ratio - ratio[i]) < 1e-6 and abs(r.gumbel_key - ratio[i] - noise[i]) < 1e-6 for i, r in got.items())


def test_ties_at_the_threshold_and_extreme_ratios(spark):
    rows = spark.range(100).selectExpr("id % 20 AS id", "0D AS log_ratio")
    kept = gumbel_top(rows, 0.5)
    assert kept.count() == 50 and kept.groupBy("id").count().where("count <> 5").count() == 0
    rows = spark.range(100).selectExpr("id", "if(id % 2 = 0, 1e12, -1e12) AS log_ratio")
    assert {r.id % 2 for r in gumbel_top(rows, 0.5).collect()} == {0}


def test_resampling_prefers_the_target(spark, docs, empty, repeated, tables):
    out = op2_importance_resampling(spark, tables)
    assert out.columns == ["doc_id", "log_ratio", "gumbel_key"]
    kept = {r.doc_id for r in out.collect()}
    junk, good = {5000 + i for i in range(200) if i % 5 == 0}, {5000 + i for i in range(200) if i % 5}
    assert len(kept & junk) <= 8 and len(kept & good) >= 150
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    assert resample(docs, labels.limit(0)).count() == docs.count()
    assert resample(empty, labels).count() == 0
    assert resample(repeated, labels, share=1.0).count() == 2 * docs.count()


def brute_leaks(texts, items):
    import re
    from collections import Counter

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for i, t in texts:
        w = words(t)
        for item, b in items:
            v = words(b)
            k, n = min(5, len(v)), min(len(v), len(w))
            grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            if not v or n < k:
                continue
            want = grams(v)
            for s in range(len(w) - n + 1):
                both = sum((grams(w[s : s + n]) & want).values())
                if both and both / (n - k + 1 + sum(want.values()) - both) >= 0.8:
                    found.add((i, item))
                    break
    return found


def test_leaks_match_brute_force(spark, docs, texts, tables):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = brute_leaks(texts, items)
    assert (10, 1) in want and (11, 1) in want and (5, 3) in want
    got = {(r.id, r.item_id) for r in leaks(docs, spark.read.parquet(f"{tables}/benchmark.parquet")).collect()}
    assert got == want


def edited(rng, words, vocabulary):
    """A copy of the words with up to two changed, or moved by up to three words."""
    out = list(words)
    for _ in range(rng.choice([0, 1, 1, 2])):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    shift = rng.choice([0, 0, 1, 2, 3])
    return out[shift:] + [rng.choice(vocabulary) for _ in range(shift)]


def test_index_finds_all_within_the_radius_and_little_else():
    rng = np.random.default_rng(3)
    items = make_items(range(400), [prose(i, 30) for i in range(400)])
    index = Index(items)
    own = index.fingerprints
    fps = np.concatenate([rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2), *[own ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64) for _ in range(k)]) for k in (3, 9, 14, 18, 20)]])
    window, item = index.near(30, fps)
    close = np.argwhere(np.bitwise_count(fps[:, None] ^ own[None, :]) <= decontam.RADIUS)
    assert sorted(zip(window.tolist(), item.tolist())) == sorted(map(tuple, close.tolist())) and len(close) > 1000
    looked = sum(int((np.searchsorted(keys, key, "right") - np.searchsorted(keys, key, "left")).sum()) for b, (keys, _) in enumerate(index.blocks) for key in [((fps[:300] >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int32)])
    assert looked < 0.15 * 300 * 400


@pytest.mark.parametrize("gate", [True, False])
def test_recall_at_the_bound(gate):
    """Of edited items whose exact similarity is 0.8 or more, at least nine in ten are found, near the bound too."""
    rng = random.Random(6)
    items = [prose(i, 16 + i) for i in range(40)]
    vocabulary = prose(1234, 400).split()
    index = Index(make_items(range(40), items))
    texts, want = [], set()
    for i, t in enumerate(items):
        for _ in range(9):
            texts.append(prose(rng.randrange(1 << 30), 8) + " " + " ".join(edited(rng, t.split(), vocabulary)) + " " + prose(rng.randrange(1 << 30), 8))
    want = brute_leaks(list(enumerate(texts)), list(enumerate(items)))
    got = {(r, i) for r, i, *_ in leaks_in(pa.array(texts, pa.large_string()), index, gate=gate)}
    assert got <= want and len(want) > 100 and len(got) >= 0.97 * len(want)


def test_edited_passages_are_found():
    item = prose(3, 80)
    words = item.split()
    words[40] = "changed"
    near, far = " ".join(words), " ".join("x" if i % 9 == 0 else w for i, w in enumerate(item.split()))
    index = Index(make_items([7], [item]))
    column = pa.array([prose(8, 50) + " " + near.upper() + ", " + prose(9, 30), far, item[: len(item) // 2]], pa.large_string())
    found = leaks_in(column, index)
    assert [(r, i, first) for r, i, first, _, _ in found] == [(0, 7, 50)] and 0.85 < found[0][4] < 1


def test_benchmark_in_blocks(spark, docs, empty, repeated, tables, monkeypatch):
    whole = {tuple(r) for r in op5_simhash_windows(spark, tables).collect()}
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (2, 1 << 20))
    assert {tuple(r) for r in op5_simhash_windows(spark, tables).collect()} == whole
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    assert leaks(empty, bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert leaks(repeated, bench).count() == 2 * leaks(docs, bench).count()
    kept = drop_leaks(spark, docs, tables)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and 10 not in ids and 11 not in ids and {1, 2, 7, None} <= ids


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_repeated_labels_have_one_meaning(spark, docs, parts):
    """Labels that repeat an id with both qualities give the same rows however they are laid out."""
    labels = spark.createDataFrame([(i, q) for i in range(1, 16) for q in ((0, 1) if i % 3 else (0,))] + [(3, None), (None, 1)], "doc_id long, quality int")
    once = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(1, 16)] + [(None, 1)], "doc_id long, quality int")
    told = [sorted(map(repr, resample(docs, x).collect())) for x in (labels.repartition(parts), labels.orderBy("quality"), once)]
    assert told[0] == told[1] == told[2]
