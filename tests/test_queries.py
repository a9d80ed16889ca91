"""Every query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillwork import plans  # noqa: F401
from quillwork.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == want


#: Queries that SQL cannot express; tests/test_comparing.py holds each against plain loops.
BRUTE_FORCE = {"field_spans", "token_lcs", "hierarchical_diff_stats", "moves", "moved_atoms", "revision_extract", "unique_match_span", "paragraph_operations", "unified_paragraphs", "word_set_classes", "class_links", "best_partners", "similar_documents"}


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(ORACLE_SQL) <= BRUTE_FORCE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"grep_bad_pattern"}))
def test_reads_tables(spark, tmp_path, name):
    """No query makes up its rows: without tables none can be built."""
    with pytest.raises(Exception, match="PATH_NOT_FOUND|Path does not exist|does not exist"):
        QUERIES[name](spark, f"{tmp_path}/none")
