import zlib

import numpy as np
import pytest

from quillwork.llm import langid
from quillwork.llm.langid import STEP, SYMBOLS, WIDTHS, WINDOW, Network, fit, held_out, languages, op13_byte_network, symbols, trained, windows

WORDS = {
    "en": "the of and that with which have this from they would there their what about when",
    "de": "der die und das nicht eine mit ist auch für werden sich über noch nach wurde",
    "fr": "les des une dans que qui pour avec sont était leur même être où après très",
}


def made(n, lang, seed, size=40):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[lang].split(), size)) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1000 * k + i, t, lang) for k, lang in enumerate(WORDS) for i, t in enumerate(made(120, lang, k))]
    rows += [(9000, None, "en"), (9001, "", "en"), (9002, "123 !! 456", "de"), (9003, " ".join(made(400, "fr", 9)), None), (None, "the of and that with", None), (9004, "日本", None)]
    return spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, lang string, known string, id string").repartition(4)


def brute_pooled(net, column):
    out = []
    for t in net.tables:
        w = len(t)
        out.append(np.max([sum(t[k, column[at + k]].astype(np.float64) for k in range(w)) for at in range(WINDOW - w + 1)], axis=0))
    return np.concatenate(out)


def test_responses_match_plain_loops():
    rng = np.random.default_rng(2)
    sym = rng.integers(0, SYMBOLS, (WINDOW, 5)).astype(np.int16)
    net = fit(sym, np.array([0, 1, 0, 1, 0]), ["a", "b"], epochs=1)
    assert np.allclose(net.pooled(sym), [brute_pooled(net, sym[:, i]) for i in range(5)], atol=1e-5)
    assert np.allclose(net.probabilities(sym).sum(axis=1), 1)


def test_slopes_match_differences():
    """A step of the fit goes down the loss: the loss of a fitted network is far below that of a fresh one."""
    rng = np.random.default_rng(4)
    sym = rng.integers(0, SYMBOLS, (WINDOW, 64)).astype(np.int16)
    label = rng.integers(0, 2, 64)
    sym[10:13, label == 1] = np.array([[3], [9], [4]])
    loss = lambda net: -np.log(net.probabilities(sym)[np.arange(64), label]).mean()
    assert loss(fit(sym, label, ["a", "b"], epochs=60)) < 0.1 * loss(fit(sym, label, ["a", "b"], epochs=0))


def test_windows_hold_every_run():
    data = np.frombuffer(b"".join(bytes(np.random.default_rng(i).integers(97, 123, n, np.uint8)) for i, n in enumerate((0, 1, 127, 128, 500, 3000))), np.uint8)
    at = np.cumsum([0, 0, 1, 127, 128, 500, 3000])
    sym, offs = symbols(data, at)
    out, row, own = windows(sym, offs)
    assert np.bincount(row, minlength=6).min() == 1
    for r in range(6):
        text = sym[offs[r] : offs[r + 1]]
        mine = out[:, row == r]
        back = {tuple(mine[k : k + max(WIDTHS), i]) for i in range(mine.shape[1]) for k in range(WINDOW - max(WIDTHS) + 1)}
        assert all(tuple(text[k : k + max(WIDTHS)]) in back for k in range(len(text) - max(WIDTHS) + 1))
        assert own[row == r].sum() == len(text) + (WINDOW - STEP) * (mine.shape[1] - 1)


def test_held_out_accuracy_and_defined_cases(spark, table, sf_dir):
    df = op13_byte_network(spark, sf_dir(documents=table))
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == table.count()
    for i, r in rows.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (9000, 9001, 9002))
    assert rows[9003].lang_pred == "fr" and rows[None].lang_pred == "en"
    held = [r for i, r in rows.items() if i is not None and i < 3000 and r.held_out]
    assert sum(r.lang_pred == list(WORDS)[r.doc_id // 1000] for r in held) >= 0.97 * len(held) > 50


def test_held_out_labels_and_layout_change_nothing(spark, table):
    """Labels of held-out rows, and how the table is laid out, have no say."""
    wrong = table.selectExpr("doc_id", "text", "if(pmod(crc32(cast(doc_id as string)), 4) = 2, 'xx', lang) as lang")
    told = [{r.id: (r.lang_pred, r.score) for r in languages(table, trained(d)).collect()} for d in (table, wrong.repartition(7))]
    assert told[0] == told[1]


def test_batches_change_nothing(spark, table, monkeypatch):
    net = trained(table)
    a = sorted(map(repr, languages(table.coalesce(1), net).collect()))
    assert a == sorted(map(repr, languages(table.repartition(9), net).collect()))


def test_repeated_rows_bound_the_sample(spark, table):
    many = table.unionByName(table).unionByName(table)
    sym, label, names = langid.sampled_windows(many, most=10, each=2)
    assert names == ["de", "en", "fr"] and np.bincount(label).max() <= 20


def test_nothing_learned(spark, table, empty):
    none = table.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert trained(none) is None
    assert {(r.lang_pred, r.score) for r in languages(none, None).collect()} == {("und", 0.0)}
    assert languages(empty, trained(table)).collect() == []
    assert isinstance(trained(table.where("lang = 'en'")), Network)
