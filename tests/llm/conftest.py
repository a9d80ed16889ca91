import random

import pytest

WORDS = "the of and to in is was for on with as by at from or an be this that which sea wind stone river cloud glass ember willow harbor lantern".split()
CLASH = "id string, size string, shard string, h string, th string, fp string, key string, at string, spans string, media string, target string, p_toxic string, bits string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Edge cases and ordinary texts by id: null, empty, blank, very long, copies, near copies, odd characters."""
    base = [prose(i, 40 + 7 * i) for i in range(20)]
    passage = prose(99, 60)
    rows = [
        (1, None), (2, ""), (3, "  \t\n "), (4, "a"), (5, "two words"), (6, prose(7, 20_000)),
        (7, base[0]), (8, base[0]), (9, base[0] + " tail"), (10, base[1] + " " + passage + " " + base[2]),
        (11, passage + " " + base[3]), (12, "Ünïcödé ▁▁ 日本語 🎉 \\ <|x|> \\<| end " + base[4]), (13, "x" * 5000), (14, "ab" * 400),
        (15, base[5].upper()), (16, base[5]), (None, base[6]), (17, "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"),
    ]
    return rows + [(100 + i, t) for i, t in enumerate(base[7:])]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with columns whose names clash with those that operators use."""
    rows = [(i, t, "en" if (i or 0) % 3 else None, "hot" if (i or 0) % 2 else f"s{(i or 0) % 5}", None if t is None else len(t), *["clash"] * 13) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def repeated(docs):
    """Every row twice."""
    return docs.unionByName(docs)


@pytest.fixture
def sf_dir(tmp_path):
    """Writes tables for a query to read."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
