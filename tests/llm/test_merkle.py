import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillwork.llm.merkle import manifest, op11_merkle_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels_of(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append((i - first, level[first : first + 16]))
        i //= 16
    return out


def brute(rows):
    """(id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(((r[0] is not None, r[0] or 0, H(*map(field, r))), r) for r in groups[s])
        trees[s] = [r for _, r in own], levels_of([k[2] for k, _ in own])
    top = levels_of([trees[s][1][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, r in enumerate(trees[s][0]):
            path = path_of(trees[s][1], i) + path_of(top, at)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            d = H(*map(field, (*r[:4], lower(r[4])) if changed else r))
            for k, run in path:
                d = H(*run[:k], d, *run[k + 1 :])
            proof = H(*[x for k, run in path for j, x in enumerate(run) if j != k])
            out.append((r[0], trees[s][1][0][i], trees[s][1][-1][0], top[-1][0], proof, d, d == top[-1][0]))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


KIND = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (300, 1), (300, 3), (60, 40)])
def test_shapes(spark, n, sources):
    """One leaf, full and broken runs, several levels, and more groups than one run holds."""
    rows = [(i * 7 % 1009, f"s{i % sources}", "en", i, f"Text {i}") for i in range(n)]
    assert got(manifest(spark.createDataFrame(rows, KIND).repartition(5))) == brute(rows)


def test_edge_cases(spark, docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    rows += [(500 + i, None, None, None, None) for i in range(20)] + [(5, "É", "en", 1, "A"), (10, "z", "en", 0, "")]
    more = spark.createDataFrame(rows, KIND).withColumns({n: F.lit("clash") for n in ("grp", "id", "idx", "n", "digest", "other", "place", "part", "key")}).repartition(3)
    assert got(manifest(more)) == brute(rows)


def test_repeated_rows_and_ids(spark, repeated):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in repeated.collect()] + [(7, "hot", "en", 3, "Other"), (7, "hot", "en", 3, "AbC")]
    assert got(manifest(spark.createDataFrame(rows, KIND).repartition(4))) == brute(rows)


def test_no_rows(empty):
    assert manifest(empty).collect() == []


def test_query(spark, docs, sf_dir):
    df = op11_merkle_manifest(spark, sf_dir(documents=docs))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert got(df) == brute(rows)
