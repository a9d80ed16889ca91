import hashlib

import duckdb
from pyspark.sql import functions as F

from quillwork.llm.chat import OP8_SQL, endless, escaped, format_trees, op8_reply_trees, read_back, reply_paths, unescaped

NODES = "tree long, node long, parent long, score double, role string, text string"


def test_escape_is_undone(spark):
    texts = ["", "<|", "\\", "\\<|", "<\\|", "<\\\\|", "<|end|>", "</s>[INST] ok [/INST]", "<<||\\\\<|\\", "🎉<|é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).select("t", "e", unescaped(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u and "<|" not in r.e for r in rows)


def test_branches_are_enumerated_and_ranked(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 5.0, "assistant", "a"), (1, 3, 1, 9.0, "assistant", "b"), (1, 4, 2, 1.0, "user", "c"), (1, 5, 4, None, None, None), (2, 1, 77, 0.0, "user", "orphan")]
    nodes = spark.createDataFrame(rows, NODES)
    out = {(r.tree, r.leaf): r for r in format_trees(nodes).withColumn("turns", read_back(F.col("formatted"))).collect()}
    assert set(out) == {(1, 3), (1, 5), (2, 1)}
    assert [(t.role, t.text) for t in out[1, 5].turns] == [("user", "q"), ("assistant", "a"), ("user", "c"), ("", "")]
    assert out[1, 3].rank == 1 and out[1, 5].rank == 2
    best = format_trees(nodes, branches=1).collect()
    assert {(r.tree, r.leaf) for r in best} == {(1, 3), (2, 1)}
    span = out[1, 5].loss_spans
    assert [out[1, 5].formatted[s.start : s.start + s.length] for s in span] == ["a"]


def test_long_chains_and_cycles(spark):
    chain = spark.range(1, 301).selectExpr("1L AS tree", "id AS node", "nullif(id - 1, 0) AS parent", "0D AS score")
    paths = reply_paths(chain)
    assert paths.count() == 300 and paths.agg(F.max("up")).first()[0] == 299
    looped = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 3, 0.0), (1, 3, 2, 0.0), (1, 4, 3, 0.0), (1, 5, 1, 0.0), (2, 1, 1, 0.0), (3, 1, None, 0.0)], "tree long, node long, parent long, score double")
    assert {(r.tree, r.leaf, r.node, r.up) for r in reply_paths(looped).collect()} == {(1, 5, 5, 0), (1, 5, 1, 1), (3, 1, 1, 0)}
    assert {tuple(r) for r in endless(looped).collect()} == {(1, 2), (1, 3), (1, 4), (2, 1)} and endless(chain).count() == 0


def test_query_matches_sql(spark, sf_dir):
    rows = [(c, t, r, x) for c in range(20) for t, (r, x) in enumerate([("system", None), ("user", f"<|end|> {c} \\"), ("assistant", "🎉é" * c), (None, "odd"), ("assistant", "")][: 1 + c % 5])]
    rows += [(60, None, "assistant", "no turn"), (60, 3, "user", "long " * 60_000), (60, 1, "assistant", None), (None, 1, "user", "no id")]
    rows += [(50, 0, "user", "tie"), (50, 0, "user", "also"), (50, 1, "assistant", "x")]
    conv = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, node string")
    path = sf_dir(conversations=conv)
    got = {tuple(r) for r in op8_reply_trees(spark, path).collect()}
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{path}/conversations.parquet/*.parquet'")
    assert got == set(con.execute(OP8_SQL).fetchall())
    assert (-1, 2) in {r[:2] for r in got}
    told = next(r for r in got if r[0] == -1)
    assert told[4] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_empty(spark):
    assert format_trees(spark.createDataFrame([], NODES)).count() == 0
