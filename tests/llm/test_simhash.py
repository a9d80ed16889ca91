import random
import re

import numpy as np
import pytest
import xxhash

from quillwork.llm import simhash
from quillwork.llm._components import components
from quillwork.llm._xxh64 import xxh64_spans
from quillwork.llm.simhash import keep_one_of_each_group, near_duplicates, op7_tiled_simhash, simhash_texts, tile_forest


def brute_fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    label = {i: i for i in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[label[i]] = min(least.get(label[i], id_), id_)
    return {id_: least.get(label[i]) for i, (id_, _) in enumerate(rows)}


def test_xxh64():
    rng = random.Random(1)
    raw = rng.randbytes(3000)
    at = np.array([rng.randrange(2000) for _ in range(2000)])
    n = np.array([rng.randrange(300 if i % 4 == 0 else 40) for i in range(2000)])
    got = xxh64_spans(np.frombuffer(raw, np.uint8), at, n, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a : a + k], seed=42) for a, k in zip(at, n)]


def test_fingerprints(texts):
    raw = [(t or "").encode() for _, t in texts]
    got = simhash_texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert got.tolist() == [brute_fingerprint(t) for _, t in texts]


@pytest.mark.parametrize("tile", [4096, 3])
def test_components_match_brute_force(spark, tile, monkeypatch):
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        fp = rng.getrandbits(64)
        for _ in range(12):
            fps.append(fp)
            fp ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    rows = [(i, fp) for i, fp in enumerate(fps)]
    df = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for fp in set(fps)], "fp long")
    roots = {r.node: r.root for r in components(simhash.link_forest(df, tile=tile)).collect()}
    want = brute_components(rows)
    group = lambda fp: roots.get(fp - (1 << 64) if fp >> 63 else fp, fp - (1 << 64) if fp >> 63 else fp)
    assert {(want[i], group(fp)) for i, fp in rows} == {(w, g) for w, g in dict((want[i], group(fp)) for i, fp in rows).items()}
    assert len({want[i] for i, _ in rows}) == len({group(fp) for _, fp in rows})


def test_tiles_skip_only_what_cannot_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:1500] ^ (np.uint64(1) << rng.integers(0, 63, 1500).astype(np.uint64))
    fp = np.concatenate([base, near])
    a, b = tile_forest(np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64), fp, 3)
    assert len(a) >= 1500 and (np.bitwise_count(a ^ b) <= 3).sum() >= 1500


def test_chain_of_links_is_one_component(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_and_edges(spark, docs, repeated, empty, texts, sf_dir):
    got = {r.doc_id: r for r in op7_tiled_simhash(spark, sf_dir(documents=docs)).collect()}
    want = brute_components([(i, brute_fingerprint(t)) for i, t in texts])
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(int(got[i].fingerprint, 16) == brute_fingerprint(t) and len(got[i].fingerprint) == 16 for i, t in texts)
    assert near_duplicates(empty).count() == 0
    assert near_duplicates(repeated).count() == 2 * len(texts)


def test_one_of_each_group_stays(spark, docs, repeated, texts):
    kept = keep_one_of_each_group(spark, repeated, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 7 in ids and 8 not in ids and 1 in ids and 2 not in ids and 16 not in ids


def test_each_row_is_judged_by_its_own_text(spark):
    """Different texts under one id, and rows without an id, stand or fall one by one."""
    far = ["the quiet harbor wind carried lantern light", "seven grey stones marked the old ferry road", "nobody in town remembered the glass willow"]
    rows = [(1, far[0]), (1, far[1]), (1, far[1]), (2, far[0]), (None, far[2]), (None, far[2]), (None, far[0]), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in keep_one_of_each_group(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, far[0]), (1, far[1]), (None, far[2]), (3, "")], key=str)
