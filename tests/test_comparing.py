"""Comparison queries without SQL, against plain loops over the smallest tables."""

import os
import re
from collections import Counter, defaultdict

import pytest

from quillwork import plans  # noqa: F401
from quillwork.plans import comparing
from quillwork.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain_lcs(a, b):
    """A whole table, walked back; a tie goes to the shorter b."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif t[i - 1][j] > t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def alike(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else float(x == y)


def plain_greedy(left, right, least):
    free, out = list(range(len(right))), []
    for i, t in enumerate(left):
        best = None
        for j in free:
            s = alike(t, right[j])
            if s >= least and s > 0 and (best is None or s > best[1]):
                best = j, s
        if best:
            free.remove(best[0])
            out.append((i, *best))
    return out


def plain_compare(original, revised):
    """(status, original paragraph, revised paragraph, token) in the order of the result."""
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    a, b = [norm(t) for t in original], [norm(t) for t in revised]
    pairs = dict(plain_lcs(a, b))
    left, right = [i for i in range(len(a)) if i not in pairs], [j for j in range(len(b)) if j not in pairs.values()]
    pairs |= {left[i]: right[j] for i, j, _ in plain_greedy([a[i] for i in left], [b[j] for j in right], 0.25)}
    back = {j: i for i, j in pairs.items()}
    cut = lambda t: re.findall(r"\s+|\S+", t)
    out, told = [], 0
    for j in range(len(revised) + 1):
        stop = len(original) if j == len(revised) else back.get(j)
        if stop is not None:
            for i in range(told, stop):
                if i not in pairs:
                    out += [("Deleted", i, -1, t) for t in cut(original[i]) or [""]]
            told = max(told, stop)
        if j == len(revised):
            break
        if stop is None:
            out += [("Inserted", -1, j, t) for t in cut(revised[j]) or [""]]
            continue
        x, y, p, q = cut(original[stop]), cut(revised[j]), 0, 0
        for s, t in [*plain_lcs(x, y), (len(x), len(y))]:
            out += [("Deleted", stop, j, w) for w in x[p:s]] + [("Inserted", stop, j, w) for w in y[q:t]]
            out += [("Equal", stop, j, x[s])] if s < len(x) else []
            p, q = s + 1, t + 1
        if not x and not y:
            out.append(("Equal", stop, j, ""))
    return out


@pytest.fixture(scope="module")
def compared(spark):
    return {r.pair_id: plain_compare(r.original, r.revised) for r in comparing.pairs(spark, SF).collect()}


def test_token_lcs(spark, compared):
    want = {i: n for i, a in compared.items() if (n := sum(s == "Equal" for s, *_ in a))}
    assert {r.pair_id: r.matches for r in QUERIES["token_lcs"](spark, SF).collect()} == want and len(want) > 3


def test_hierarchical_diff_stats(spark, compared):
    got = {r.pair_id: r for r in QUERIES["hierarchical_diff_stats"](spark, SF).collect()}
    assert set(got) == set(compared)
    for i, atoms in compared.items():
        n = Counter(s for s, *_ in atoms)
        assert (got[i].insertions, got[i].deletions) == (n["Inserted"], n["Deleted"])


def plain_blocks(atoms):
    """Deleted and inserted runs over the original's atoms, then over the revision's: [number, status, text, places]."""
    rows = [(k, s, t) for k, (s, _, _, t) in enumerate(atoms) if s != "Inserted"]
    rows = [(0, *r) for r in rows] + [(1, k, s, t) for k, (s, _, _, t) in enumerate(atoms) if s != "Deleted"]
    out, n, last = [], 0, None
    for _, k, s, t in rows:
        if s != last:
            n, last = n + 1, s
            out.append([n, s, "", []])
        out[-1][2] += t
        out[-1][3].append(k)
    return [b for b in out if b[1] != "Equal"]


def plain_moves(atoms):
    big = [b for b in plain_blocks(atoms) if len(b[2].split()) >= 5]
    gone, new = [b for b in big if b[1] == "Deleted"], [b for b in big if b[1] == "Inserted"]
    return [(gone[i], new[j], s) for i, j, s in plain_greedy([b[2].lower() for b in gone], [b[2].lower() for b in new], 0.8)]


@pytest.fixture(scope="module")
def moved(spark):
    return {r.pair_id: plain_compare(r.original, r.revised) for r in comparing._moved(spark, SF).collect()}


def test_moves(spark, moved):
    got = sorted((r.pair_id, r.move_group, r.source_block, r.target_block, round(r.similarity, 9), tuple(r.ids)) for r in QUERIES["moves"](spark, SF).collect())
    want = sorted((i, k, a[0], b[0], round(s, 9), tuple(range(4 * k - 3, 4 * k + 1))) for i, atoms in moved.items() for k, (a, b, s) in enumerate(plain_moves(atoms), 1))
    assert got == want and len(want) > 20


def test_moved_atoms(spark, moved):
    want = {}
    for i, atoms in moved.items():
        status = [s for s, *_ in atoms]
        for a, b, _ in plain_moves(atoms):
            for k in range(a[3][0], a[3][-1] + 1):
                status[k] = "MovedSource" if status[k] == "Deleted" else status[k]
            for k in range(b[3][0], b[3][-1] + 1):
                status[k] = "MovedDestination" if status[k] == "Inserted" else status[k]
        want |= {(i, s): n for s, n in Counter(status).items()}
    assert {(r.pair_id, r.status): r.n for r in QUERIES["moved_atoms"](spark, SF).collect()} == want


def test_revision_extract(spark, compared):
    rank = {"Inserted": 0, "Deleted": 1}
    want = {}
    for i, atoms in compared.items():
        paras = defaultdict(list)
        for s, a, b, t in atoms:
            paras[b if b >= 0 else a + 0.5].append((s, t))
        changed = [(k, v) for k, v in sorted(paras.items()) if any(s != "Equal" for s, _ in v)]
        for k, v in changed[:50]:
            has = {s for s, _ in v}
            kind = "inserted" if has == {"Inserted"} else "deleted" if has == {"Deleted"} else "modified"
            entries = [x for x in sorted(((rank[s], n, s, t) for n, (s, t) in enumerate(v) if s != "Equal"))]
            want[i, k] = (kind, "".join(t for s, t in v if s != "Inserted"), "".join(t for s, t in v if s != "Deleted"), [(s, t) for _, _, s, t in entries])
    got = {(r.pair_id, r.para_key): (r.kind, r.before, r.after, [tuple(e) for e in r.entries]) for r in QUERIES["revision_extract"](spark, SF).collect()}
    assert got == want


def plain_operations(original, revised):
    norm = lambda t: " ".join(t.lower().split())
    a, b = [norm(t) for t in original], [norm(t) for t in revised]
    pairs = dict(plain_lcs(a, b))
    left, right = [i for i in range(len(a)) if i not in pairs], [j for j in range(len(b)) if j not in pairs.values()]
    pairs |= {left[i]: right[j] for i, j, _ in plain_greedy([a[i] for i in left], [b[j] for j in right], 0.5)}
    back, told, out = {j: i for i, j in pairs.items()}, set(), []
    for j in range(len(b)):
        if j not in back:
            out.append(("inserted", -1, j))
            continue
        for i in range(back[j]):
            if i not in pairs and i not in told:
                told.add(i)
                out.append(("deleted", i, -1))
        out.append(("unchanged" if a[back[j]] == b[j] else "modified", back[j], j))
    return out + [("deleted", i, -1) for i in range(len(a)) if i not in pairs and i not in told]


def test_paragraph_operations(spark):
    want = {(r.pair_id, n): o for r in comparing.pairs(spark, SF).collect() for n, o in enumerate(plain_operations(r.original, r.revised))}
    assert {(r.pair_id, r.place): (r.op, r.orig_para, r.rev_para) for r in QUERIES["paragraph_operations"](spark, SF).collect()} == want and len(want) > 20


def test_unified_paragraphs(spark, compared):
    want = set()
    for i, atoms in compared.items():
        for n, key in enumerate(dict.fromkeys((a, b) for _, a, b, _ in atoms)):
            want.add((i, *key, n))
    assert {tuple(r) for r in QUERIES["unified_paragraphs"](spark, SF).collect()} == want


def test_unsafe_pairs_are_rebuilt(spark, monkeypatch):
    """Where no alignment survives the round trip, the old paragraphs go and the new ones come."""
    from quillwork.operators import alignment

    real = alignment.compare_texts
    monkeypatch.setattr(alignment, "compare_texts", lambda a, b, least: real(a, b, least) if least > 1 or "sound" in a[0] else real(a, b, least)[:-1])
    rows = spark.createDataFrame([(1, ["sound one", "b"], ["sound one", "c"]), (2, ["other", "b"], ["other", "c"])], "pair_id long, original array<string>, revised array<string>")
    atoms, report = alignment.compare_documents(rows, (0.25, 0.5))
    assert {tuple(r) for r in report.collect()} == {(1, "aligned", 1), (2, "rebuilt", 3)}
    assert all(r.accepts and r.rejects for r in alignment.round_trip(atoms, rows).collect())


def test_nulls_do_not_stop_a_comparison(spark):
    from quillwork.operators import alignment

    rows = spark.createDataFrame([(1, None, ["a b", None]), (2, ["x", None], None), (3, None, None), (4, [None], [""])], "pair_id long, original array<string>, revised array<string>")
    assert Counter((r.pair_id, r.status) for r in alignment.compare_pairs(rows).collect()) == {(1, "Inserted"): 4, (2, "Deleted"): 2, (4, "Equal"): 1}
    assert all(r.accepts and r.rejects for r in alignment.round_trip(alignment.compare_pairs(rows), rows).collect())


def staged(text):
    """The text as each stage sees it, by plain replacements."""
    from quillwork.operators.search import MATCH_TAGS

    clean = re.sub(MATCH_TAGS, "", text)
    straight = re.sub("[“”«»‹›]", '"', re.sub("[‘’]", "'", clean))
    spaces = re.sub(r"\s+", " ", straight)
    return [text, clean, straight, spaces, re.sub("[\"']", "", spaces)]


def test_unique_match_of_every_pair(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    names = ("exact", "clean", "quote_normalized", "flexible_whitespace", "quote_optional")
    want = {}
    seen = {i: staged(t) for i, t in items.items()}
    for d, t in docs.items():
        for k, needle in seen.items():
            for name, x, n in zip(names, staged(t), needle):
                hits = sum(x.startswith(n, s) for s in range(len(x))) if n and n in x else 0
                if hits:
                    want[d, k] = ("unique" if hits == 1 else "multiple", name)
                    break
    got = {(r.doc_id, r.item_id): (r.status, r.mode) for r in QUERIES["unique_match_status"](spark, SF).collect()}
    assert got == want and len(want) >= 3
    spans = {(r.doc_id, r.item_id): (r.start, r.stop) for r in QUERIES["unique_match_span"](spark, SF).collect()}
    assert set(spans) == set(got)
    for (d, k), (status, mode) in got.items():
        start, stop = spans[d, k]
        assert (start is not None) == (status == "unique")
        if start is not None:
            stage = names.index(mode)
            assert staged(docs[d][start:stop])[stage].strip() == seen[k][stage].strip()


def by_word_sets(texts):
    out = defaultdict(list)
    for i, t in sorted(texts.items()):
        if t.split():
            out[frozenset(t.lower().split())].append(i)
    return out


def test_word_set_queries(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    classes = by_word_sets(items)
    assert {(r.id, r.representative) for r in QUERIES["word_set_classes"](spark, SF).collect()} == {(i, v[0]) for v in classes.values() for i in v}
    assert {(r.a, r.b) for r in QUERIES["class_links"](spark, SF).collect()} == {(v[0], i) for v in classes.values() for i in v[1:] if items[i] != items[v[0]]}
    words = {i: set(t.lower().split()) for i, t in items.items()}
    score = lambda a, b: len(a & b) / len(a | b)
    best = {}
    for i, a in words.items():
        found = [(-score(a, b), j) for j, b in words.items() if j != i and score(a, b) >= 0.12]
        if found:
            best[i] = (min(found)[1], round(-min(found)[0], 6))
    assert {r.id: (r.partner, r.score) for r in QUERIES["best_partners"](spark, SF).collect()} == best
    said = {i: set(t.lower().split()) for i, t in docs.items()}
    want = {(i, d, len(a & b), len(a | b)) for i, a in words.items() for d, b in said.items() if score(a, b) >= 0.12}
    assert {tuple(r) for r in QUERIES["similar_documents"](spark, SF).collect()} == want


def test_a_page_of_revisions_is_told_where_a_pair_is_compared(spark):
    """Atoms were shuffled three times after the comparison; the page is that of all revisions."""
    import random

    from quillwork.operators.alignment import compare_pairs, pair_revisions, revisions
    from quillwork.operators.paging import revision_page

    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(7)))
    rows = [(n, [text() for _ in range(rng.randrange(9))], [text() for _ in range(rng.randrange(9))]) for n in range(60)] + [(60, None, ["a", None]), (61, ["a  b"], None), (62, None, None)]
    pairs = spark.createDataFrame(rows, "pair_id long, original array<string>, revised array<string>")
    out = pair_revisions(pairs, 2, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    want = revision_page(revisions(compare_pairs(pairs)), 2, 3, "pair_id", "para_key").select(*out.columns)
    assert dict(out.dtypes) == dict(want.dtypes)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))


def test_the_texts_of_pairs_are_shuffled_once_for_both_sides(spark):
    from quillwork.plans.comparing import pairs

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = pairs(spark, SF).select("pair_id", "original", "revised")
        rows.collect()
        assert "ReusedExchange" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
