"""Comparisons whose texts and moves are told where the pair is compared."""

import random

import pytest

from quillwork.operators import alignment as G


def _text(rng):
    return " ".join(rng.choice(["ab", "cd", "ef", "gh", "the", "of"]) for _ in range(rng.randrange(12)))


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        old = [_text(rng) for _ in range(rng.randrange(1, 12))]
        new = old[:]
        rng.shuffle(new)
        rows.append((i, old, [t if rng.random() < 0.6 else t + " " + _text(rng) for t in new]))
    return spark.createDataFrame([*rows, (98, [None, "a  b"], None), (99, None, None)], "pair_id long, original array<string>, revised array<string>")


def test_joined_atoms_hold_all_tokens(pairs):
    by_pair = lambda df: {i: sorted(r for r in map(tuple, df.collect()) if r[0] == i) for i in (*range(40), 98, 99)}
    tokens, told = by_pair(G.compare_pairs(pairs)), by_pair(G.compare_pairs(pairs, joined=G.STATUSES))
    for i, rows in told.items():
        for _, n, status, old, new, text, size in rows:
            same = tokens[i][n : n + size]
            assert {x[2:5] for x in same} == {(status, old, new)} and "".join(x[5] for x in same) == text
        assert sum(r[-1] for r in rows) == len(tokens[i])


def test_moves_are_those_of_the_atoms(spark, pairs):
    atoms = G.compare_pairs(pairs)
    found = G.moves(atoms, 0.5, 2)
    assert sorted(map(tuple, G.pair_moves(pairs, 0.5, 2).collect())) == sorted(map(tuple, found.collect())) and found.count() > 3
    count = lambda df, n: {tuple(r) for r in df.groupBy("pair_id", "status", "move_group").agg({n: "sum"}).collect()}
    one = G.with_moves(atoms, found).selectExpr("*", "1 as tokens")
    assert count(one, "tokens") == count(G.compare_with_moves(pairs, 0.5, 2), "tokens")


def test_moves_take_one_shuffle_and_no_file(spark, tmp_path):
    """Atoms once went to a checkpoint and through four shuffles."""
    from quillwork.plans import comparing

    spark.createDataFrame([(1, "a b c\nd e f\ng h i")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    told = comparing.moved_atoms(spark, str(tmp_path))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "ExistingRDD" not in plan and told.count() > 0


def plain_greedy(left, right, least):
    free, out = set(range(len(right))), []
    for i, t in enumerate(left):
        best = max(((G.similarity(t, right[j]), -j) for j in free), default=(0.0, 0))
        if best[0] >= least and best[0] > 0:
            out.append((i, -best[1], best[0]))
            free.discard(-best[1])
    return out


@pytest.mark.parametrize("least", [0.25, 0.35, 0.5, 0.75, 0.8, 1.0])
def test_greedy_pairs_are_those_of_all_pairs(least):
    rng = random.Random(5)
    for _ in range(200):
        left, right = ([_text(rng) for _ in range(rng.randrange(9))] for _ in range(2))
        assert G.greedy_pairs(left, right, least) == plain_greedy(left, right, least)


def test_a_long_paragraph_is_aligned_in_a_moment():
    """A row of the table is one number; 6,000 words on either side once took many seconds."""
    import time

    rng = random.Random(1)
    a, b = ([rng.choice("abcdefgh") for _ in range(6000)] for _ in range(2))
    t = time.process_time()
    assert len(G.lcs(a, b)) > 2000 and time.process_time() - t < 0.6


def test_whole_paragraphs_of_a_comparison_stay_whole():
    """Each was cut into atoms that were put together again one by one."""
    a, b = ["same text", "gone away", "one two", ""], ["same text", "one  three", "new", ""]
    told = G._compared(a, b)
    assert sum(i == 0 or (i == 1) for _, i, *_ in told) == 2 and [t for *_, t in told if t is not None][:1] == ["same text"]
    atoms = G.compare_texts(a, b)
    assert atoms == [(s, i, j, t) for s, i, j, tokens, _ in told for t in tokens]
    rows = G._stretches(told)
    assert [r[0] for r in rows] == [sum(r[5] for r in rows[:k]) for k in range(len(rows))] and sum(r[5] for r in rows) == len(atoms)
    for side, other, text in ((2, "Inserted", a), (3, "Deleted", b)):
        for p, want in enumerate(text):
            assert "".join(r[4] for r in rows if r[side] == p and r[1] != other) == want
