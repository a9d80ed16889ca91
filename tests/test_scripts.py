"""Edit scripts against whole tables, and what cleaning makes of them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillwork.operators import chars as C
from quillwork.operators import overlay as V
from quillwork.operators import scripts as S


def sides(ops):
    return "".join(t for o, t in ops if o <= 0), "".join(t for o, t in ops if o >= 0)


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [0, 30, 16_384])
def test_scripts_are_shortest_and_rebuild_both_sides(monkeypatch, cells):
    monkeypatch.setattr(S, "BOX_CELLS", cells)
    rng = random.Random(cells)
    for _ in range(1200):
        letters = "ab c.\U0001f600\n"[: rng.randrange(1, 8)]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(2))
        ops = S.shortest_script(a, b)
        assert sides(ops) == (a, b)
        assert sum(len(t) for o, t in ops if o == 0) == longest(a, b)
        assert all(t for _, t in ops) and all(x[0] != y[0] for x, y in zip(ops, ops[1:]))
        for step in (S.without_scraps, S.at_boundaries, S.with_overlaps, S.readable):
            assert sides(step(ops)) == (a, b)


def test_long_texts_with_few_changes_are_quick():
    rng = random.Random(4)
    a = [rng.choice("abcdefgh ") for _ in range(20_000)]
    b = list(a)
    for i in rng.sample(range(len(a)), 10):
        b[i] = "Z"
    a, b = "".join(a), "".join(b)
    took = []
    for _ in range(3):
        start = time.perf_counter()
        ops = C.character_diff(a, b)
        took.append(time.perf_counter() - start)
    assert sides(ops) == (a, b) and sum(len(t) for o, t in ops if o == 1) == 10
    assert min(took) < 0.1


def plain_scraps(ops):
    """One part after another, from the front each time."""
    while True:
        changes = S._changes(ops)
        size = lambda c: max(len(c[1]), len(c[2]))
        at = next((i for i in range(1, len(changes) - 1) if changes[i][0] and len(changes[i][0]) <= min(size(changes[i - 1]), size(changes[i]))), None)
        if at is None:
            return ops
        same, gone, new = changes[at]
        x = changes[at - 1]
        changes[at - 1 : at + 1] = [(x[0], x[1] + same + gone, x[2] + same + new)]
        ops = S._flat(changes)


def test_scraps_equal_a_plain_loop():
    rng = random.Random(5)
    for _ in range(1500):
        ops = S.tidy([(rng.choice((-1, 0, 0, 1)), "x" * rng.randrange(1, 5)) for _ in range(rng.randrange(14))])
        assert S.without_scraps(ops) == plain_scraps(ops)


@pytest.mark.parametrize(
    ("ops", "told"),
    [
        ([(-1, "a"), (1, "b"), (0, "cd"), (-1, "e")], [(-1, "a"), (1, "b"), (0, "cd"), (-1, "e")]),
        ([(-1, "a"), (0, "b"), (-1, "c")], [(-1, "abc"), (1, "b")]),
        ([(-1, "ab"), (0, "cd"), (-1, "e"), (0, "f"), (1, "g")], [(-1, "abcdef"), (1, "cdfg")]),
        ([(0, "The c"), (1, "ow and the c"), (0, "at.")], [(0, "The "), (1, "cow and the "), (0, "cat.")]),
        ([(0, "The xxx. The "), (1, "zzz. The "), (0, "yyy.")], [(0, "The xxx."), (1, " The zzz."), (0, " The yyy.")]),
        ([(-1, "abcxxx"), (1, "xxxdef")], [(-1, "abc"), (0, "xxx"), (1, "def")]),
        ([(-1, "xxxabc"), (1, "defxxx")], [(1, "def"), (0, "xxx"), (-1, "abc")]),
        ([(-1, "abcxx"), (1, "xxdef")], [(-1, "abcxx"), (1, "xxdef")]),
        ([], []),
    ],
)
def test_readable(ops, told):
    assert S.readable(ops) == told


def test_overlap_is_the_longest():
    rng = random.Random(6)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        assert S.overlap(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])


def test_run_changes_against_single_characters(spark):
    rng = random.Random(7)
    cases, runs = [], {0: [], 1: []}
    for i in range(150):
        texts = ["".join(rng.choice("ab cd") for _ in range(rng.randrange(30))) for _ in range(2)]
        if i % 3 == 0:
            texts[1] = texts[0][:9] + "new " + texts[0][12:]
        looks = []
        for side, text in enumerate(texts):
            cuts = [0, *sorted(rng.choices(range(len(text) + 1), k=rng.randrange(4))), len(text)]
            own = [(i, n, text[x:y], rng.choice("BIU")) for n, (x, y) in enumerate(zip(cuts, cuts[1:]))]
            runs[side] += own
            looks.append([(n, look) for _, n, t, look in own for _ in t])
        cases.append((i, texts, looks))
    frames = [spark.createDataFrame(runs[s], "id int, run int, text string, look string") for s in (0, 1)]
    pairs = spark.createDataFrame([(i, *t) for i, t, _ in cases], "id int, a string, b string").withColumn("ops", C.diff_ops("a", "b"))
    got = {}
    for r in V.run_changes(pairs, *frames, ["id"], "run", ["look"]).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.op, r.text, r.from_run, r.look))
    for i, (a, b), looks in cases:
        expected, p, q = [], 0, 0
        for nth, (op, text) in enumerate(C.character_diff(a, b)):
            for x in text:
                run, look = looks[0][p] if op < 0 else looks[1][q]
                if expected and expected[-1][0] == (nth, run):
                    expected[-1][1][1] += x
                else:
                    expected.append(((nth, run), [op, x, run, look]))
                p, q = p + (op <= 0), q + (op >= 0)
        assert got.get(i, []) == [tuple(e) for _, e in expected]


def test_ops_of_nulls(spark):
    row = spark.range(1).select(C.diff_ops(F.lit(None).cast("string"), F.lit("x")).alias("o")).first()
    assert [tuple(o) for o in row.o] == [(1, "x")]


def test_small_changes_are_told_without_arrays_and_in_many_tasks(spark, monkeypatch, tmp_path):
    """A table of small texts is one file and was one task; arrays of both texts were made for one letter."""
    from quillwork.plans.diffing import char_diffs

    monkeypatch.setattr(S, "_padded", None)
    long = "a b c " * 3000
    assert S.shortest_script(long + "x" + long, long + "yz" + long) == [(0, long), (-1, "x"), (1, "yz"), (0, long)]
    assert S.shortest_script("aa", "aaa") == [(0, "aa"), (1, "a")] and S.shortest_script("", "") == []
    spark.createDataFrame([(i, "green mint", i % 50) for i in range(400)], "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = char_diffs(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= 16 and {r.p_partkey: r.ops for r in out.collect()}[0] == "=gree -n +# = mint"


def test_texts_are_cut_where_they_are(spark):
    """Runs and steps of both sides were rows of five shuffles and of windows; no group is dealt out again."""
    run = "array<struct<from_run:int,n:int,look:string>>"
    rows = spark.createDataFrame([(None, [(0, "ab"), (-1, "cde"), (1, "é😀")], [(0, 3, "B"), (1, 2, "I")], [(4, 1, "U"), (7, 3, "N")]), (2, None, [], []), (3, [(1, "x")], [], [(0, 1, "B")])], f"id int, ops array<struct<op:int,text:string>>, old {run}, new {run}")
    out = V.nested_run_changes(rows, ["id"], ["look"])
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Window", "Exchange", "Join"))
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] or 0, r[1]))
    assert got == [(None, 0, 0, "a", 4, "U"), (None, 1, 0, "b", 7, "N"), (None, 2, -1, "c", 0, "B"), (None, 3, -1, "de", 1, "I"), (None, 4, 1, "é😀", 7, "N"), (3, 0, 1, "x", 0, "B")]
