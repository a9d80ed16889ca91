import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillwork.llm.crosstok import A_FILE, B_FILE, align, byte_letters, byte_level, op12_cross_tokenizer, token_links

ODD = ["<|endoftext|> a <s> b </s>", " lead", "trail ", "a" + " " * 500 + "b", "\n" * 300, "tab\tand\r\nline", "don't we'll I'M", "ﬁ ½ ½ é", "日本語のテキスト 123,456", "🎉🎉 ok", "x" * 3000, "\x00 zero", "a b c" * 90]


def encoded(texts):
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = byte_letters()
    for t in texts:
        if not t:
            yield [], []
            continue
        ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
        tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        want = (" " + t).encode()
        yield (ta, tb) if b"".join(x for _, x in ta) == want == b"".join(x for _, x in tb) else ([], [])


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) by plain loops."""
    told, counts = [], Counter()
    for (id_, _), (ta, tb) in zip(rows, encoded([t for _, t in rows])):
        at, ends_a, ends_b = 0, [], []
        for _, x in ta:
            at += len(x)
            ends_a.append(at)
        at = 0
        for _, x in tb:
            at += len(x)
            ends_b.append(at)
        links = [(ta[i][0], tb[j][0]) for i, e in enumerate(ends_a) for j in np.flatnonzero(np.array(ends_b) == e)]
        counts.update(links)
        cuts, text, last = sorted(set(ends_a) & set(ends_b)), [], 0
        for c in cuts:
            text.append(",".join(str(i) for (i, _), e in zip(ta, ends_a) if last < e <= c) + "|" + ",".join(str(i) for (i, _), e in zip(tb, ends_b) if last < e <= c))
            last = c
        told.append((id_, len(ta), len(tb), len(cuts), links, hashlib.sha256(";".join(text).encode()).hexdigest() if text else ""))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(repr((i, a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha)) for i, a, b, g, links, sha in told)


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def rows(texts):
    short = [(i, t) for i, t in texts if t is None or len(t) < 6000]
    return short + [(1000 + i, t) for i, t in enumerate(ODD)]


@pytest.mark.parametrize("hot_share", [50_000, 50, 1])
def test_matches_plain_loops(spark, rows, hot_share):
    """Counts come back the same whether most pairs are sent to all tasks, some, or none."""
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, row string, pairs string, id string").repartition(4)
    links, counts = token_links(df, hot_share=hot_share)
    assert got(links.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == brute(rows)
    assert counts.groupBy().sum("n").first()[0] == links.groupBy().sum("n_links").first()[0]


def test_query_with_repeated_rows(spark, rows, sf_dir):
    twice = rows[:12] * 2
    df = op12_cross_tokenizer(spark, sf_dir(documents=spark.createDataFrame(twice, "doc_id long, text string").repartition(3)))
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(df) == brute(twice)


def test_no_rows(empty):
    links, counts = token_links(empty)
    assert links.collect() == [] and counts.collect() == []


def test_both_libraries_give_the_same_ids():
    """The quicker library of the byte-level file against the other, over random strings."""
    rng = random.Random(3)
    signs = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "é", "日", "🎉", " ", " ", "-", "...", "ß", "́", "\x85", "\x1c", "<|endoftext|>", "word", " the"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(2000)] + [" " * n for n in (1, 199, 200, 5000)]
    whole = Tokenizer.from_file(A_FILE)
    whole.encode_special_tokens = True
    encode, _ = byte_level(A_FILE)
    assert [list(x) for x in encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_tokens_without_bytes_link_to_all_that_end_there():
    found = align(np.array([2, 0, 3]), np.array([2, 3]), np.array([5]))
    assert sorted(zip(found.link_a.tolist(), found.link_b.tolist())) == [(0, 0), (1, 0), (2, 1)]
