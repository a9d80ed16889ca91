import hashlib
import random

import numpy as np
import pytest

from quillwork.llm import suffix_dedup
from quillwork.llm._anchors import anchors
from quillwork.llm._suffix import permuted_prefixes, suffix_array
from quillwork.llm.suffix_dedup import cut_repeats, op3_suffix_spans, repeated_bytes, shard_repeats

from .conftest import prose


def brute_covers(rows, span=100):
    """1 for every byte of each text that a string covers which starts earlier too."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        cover = out[i] = bytearray(len(t))
        for s in range(len(t) - span + 1):
            if t[s : s + span] in seen:
                cover[s : s + span] = b"\1" * span
            seen.add(t[s : s + span])
    return out


def brute(rows, span=100):
    out, covers = {}, brute_covers(rows, span)
    for i, t in rows:
        cover = covers[i]
        kept = bytes(c for c, r in zip(t, cover) if not r)
        runs = sum(1 for j in range(len(t)) if cover[j] and (j == 0 or not cover[j - 1]))
        out[i] = (len(t), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        n, k = rng.randrange(1, 120), rng.choice([1, 2, 3, 5, 200])
        s = np.array([rng.randrange(1, k + 1) for _ in range(n)] + [0])
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        common = permuted_prefixes(s.astype(np.uint8), sa)
        for a, b in zip(sa[1:], sa):
            same = next((i for i in range(n + 1) if max(a, b) + i > n or s[a + i] != s[b + i]), 0)
            assert common[a] == same


def test_equal_strings_have_equal_anchors():
    rng = random.Random(4)
    shared = rng.randbytes(150).replace(b"\xff", b"a")
    a, b = rng.randbytes(333) + shared + rng.randbytes(77), rng.randbytes(10) + shared
    data = np.frombuffer(a + b, np.uint8)
    row, first, last, at, h = anchors(data, np.array([0, len(a), len(a) + len(b)]))
    own = {}
    for r, f, z, p, x in zip(row.tolist(), first.tolist(), last.tolist(), at.tolist(), h.tolist()):
        for s in range(f, z + 1):
            own[s] = (x, p - s)
    assert sorted(own) == [*range(len(a) - 99), *range(len(a), len(a) + len(b) - 99)]
    assert all(own[333 + k] == own[len(a) + 10 + k] for k in range(51))


def test_shard_repeats_inside_one_list():
    x = bytes(range(32, 182))
    which, start, stop = shard_repeats([x, b"zz" + x + b"yy", x[20:140]], np.array([0, 5, 0]))
    assert list(zip(which.tolist(), start.tolist(), stop.tolist())) == [(1, 7, 157), (2, 0, 120)]


@pytest.mark.parametrize("hot", [1000, 2])
def test_matches_brute_force(spark, docs, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**9)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    line = prose(1234, 12)[:70]
    more = [(1000 + i, prose(i, 5) + line + prose(500 + i, 9)) for i in range(40)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute([(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in texts + more])
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeated_bytes(rows).collect()}
    assert got == want


def test_query_and_edges(spark, docs, empty, repeated, texts, sf_dir):
    out = op3_suffix_spans(spark, sf_dir(documents=docs))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    want = brute([(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in texts])
    assert got == {None if i == -(1 << 63) else i: v for i, v in want.items()}
    assert repeated_bytes(empty).count() == 0
    again = repeated_bytes(repeated).select("id", "n_removed").distinct().collect()
    assert {r.id: r.n_removed for r in again} == {i: v[1] for i, v in want.items()}


def test_stage_keeps_what_is_left(spark, docs, texts):
    out = cut_repeats(spark, docs, "")
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert 8 not in rows and rows[7].text == dict(texts)[7] and rows[1].text is None and rows[2].text == ""
    assert len(rows[11].text) < len(dict(texts)[11]) and rows[11].n_chars == len(rows[11].text)
