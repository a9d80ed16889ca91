import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from quillwork.llm import pieces
from quillwork.llm._text import column_bytes, span_hash
from quillwork.llm.pieces import MODEL, Encoder, code_points, load_pieces, op10_batched_viterbi, piece_keys, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def brute(text, pieces, unknown):
    """A plain search for the path with the greatest sum of scores."""
    if not text:
        return []
    s = "▁" + text.replace(" ", "▁")
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for k in range(min(16, j), 0, -1):
            found = pieces.get(s[j - k : j]) or ((-1, unknown) if k == 1 else None)
            if found and best[j - k] + found[1] > best[j]:
                best[j], back[j] = best[j - k] + found[1], (k, found[0])
    out, j = [], len(s)
    while j:
        k, i = back[j]
        out += [i] if i >= 0 else [3 + b for b in reversed(s[j - 1].encode())]
        j -= k
    return out[::-1]


def encoded(encoder, part):
    data, offsets = column_bytes(pa.array(part))
    ids, at = encoder.encode(data, offsets)
    back, where = encoder.decode(ids, at)
    raw = back.tobytes()
    assert [raw[a:b].decode() for a, b in zip(where, where[1:])] == part
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def odd_texts(model, n, seed=3):
    """Pieces, letters that repeat, spaces and rare signs put together at random."""
    rng = random.Random(seed)
    body = [model.id_to_piece(i).replace("▁", " ") for i in range(259, model.vocab_size())]
    joined = ["".join(rng.choice(body) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    return joined + ["".join(rng.choice("aaabbe  oxé日\n🎉") for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_ids_are_those_of_the_models_encoder(model, texts, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 500)
    encoder = Encoder(load_pieces())
    some = [(t or "").replace("▁", "_") for _, t in texts] + [" ", "  a  b ", "<s> </s> <0x0A>", "\n\t\0", "x" * 1200 + " y", "ab" * 3000, "the" * 700]
    some += [" " * k + "x" + " " * j for k in range(36) for j in range(3)] + odd_texts(model, 1500)
    for part in (some[:10], some[10:], some):
        assert encoded(encoder, part) == model.encode(part)
    assert encoded(encoder, ["▁x ▁▁"])  # kept by byte pieces, where the library takes it for a space


def test_words_of_one_hash_are_told_apart(model, monkeypatch):
    monkeypatch.setattr(pieces, "span_hash", lambda prefix, a, b: real(prefix, a, np.minimum(a + 3, b)) if len(a) and weak[0] else real(prefix, a, b))
    real, weak = span_hash, [False]
    encoder = Encoder(load_pieces())
    segment = encoder._segment

    def strong(*args):
        weak[0] = False
        out = segment(*args)
        weak[0] = True
        return out

    encoder._segment = strong
    weak[0] = True
    part = ["willow willows wild", "will willing"]
    assert encoded(encoder, part) == model.encode(part)


def test_unigram_models_take_the_greatest_sum(model):
    p = load_pieces()
    rng = random.Random(5)
    words = {w: (i, -rng.random() * len(w)) for i, w in enumerate(["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab", "ca", "cab", "bca"], 300)}
    p.keys, p.ids, p.scores = piece_keys(words)
    p.merges, p.unknown = None, -9.0
    some = ["".join(rng.choice("abcab cé") for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["abcab" * 150]
    data, offsets = column_bytes(pa.array(some))
    ids, at = Encoder(p).encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [brute(t, words, p.unknown) for t in some]


def test_code_points():
    text = "aé▁日🎉"
    cps, at = code_points(np.frombuffer(text.encode(), np.uint8))
    assert cps.tolist() == [ord(c) for c in text] and at.tolist() == [0, 1, 3, 6, 9]


def test_query_and_edges(spark, docs, empty, repeated, texts, sf_dir):
    got = {r.doc_id: r for r in op10_batched_viterbi(spark, sf_dir(documents=docs)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        assert got[i].round_trip and got[i].n_bytes == len(raw) and got[i].decoded_sha256 == hashlib.sha256(raw).hexdigest()
    assert got[1].n_tokens == got[2].n_tokens == 0
    one = tokens(docs).where("id = 7").first()
    assert len(one.token_ids) == one.n_tokens and hashlib.sha256(np.array(one.token_ids, "<i4").tobytes()).hexdigest() == one.ids_sha256
    assert tokens(empty).count() == 0 and tokens(repeated).count() == 2 * len(texts)
