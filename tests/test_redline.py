"""Comparisons written into the revision's markup: both sides come back, and what did not change keeps its bytes."""

import random
import re
from xml.etree import ElementTree

import pytest

from quillwork.operators import markup as M
from quillwork.operators.alignment import compare_texts
from quillwork.operators.redline import in_place

HEAD, TAIL = '<?xml version="1.0"?><w:document xmlns:w="u"><w:body>', '<w:sectPr/></w:body></w:document>'
W = "{u}"
SCHEMA = "doc_id long, part_uri string, text string"


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def paragraph(rng, text):
    """One paragraph in runs of any length, with properties, links, tabs and bookmarks here and there."""
    props = rng.choice(["", "<w:pPr/>", "<w:pPr><w:jc w:val='both'/></w:pPr>", "<w:pPr><w:rPr><w:b/></w:rPr></w:pPr>", "<w:pPr><w:rPr/></w:pPr>", "<w:pPr><w:keepNext/><w:sectPr/></w:pPr>"])
    out, at = [], 0
    while at < len(text):
        n = rng.randrange(1, 14)
        look = rng.choice(["", "<w:rPr><w:b/></w:rPr>", '<w:rPr><w:sz w:val="24"/></w:rPr>'])
        half = rng.randrange(n + 1)
        bits = [b for b in (text[at : at + half], text[at + half : at + n]) if b]
        inner = rng.choice(["", "<w:tab/>"]).join(f'<w:t xml:space="preserve">{escaped(b)}</w:t>' for b in bits)
        run = f'<w:r w:rsidR="7">{look}{inner}{rng.choice(["", "", "<w:br/>"])}</w:r>'
        out.append(rng.choice([run, run, f'<w:hyperlink w:id="5">{run}</w:hyperlink>', f'<w:bookmarkStart w:id="{at}" w:name="b"/>{run}']))
        at += n
    return f"<w:p>{props}{''.join(out)}</w:p>"


def part(rng, texts):
    return HEAD + "".join(paragraph(rng, t) for t in texts) + TAIL


def texts_of(xml):
    return ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in ElementTree.fromstring(xml).iter(f"{W}p") if any(t.text for t in p.iter(f"{W}t"))]


def case(rng):
    word = lambda: rng.choice(["one", "two", "three", "four & more", "five", "<six>", "seven"])
    old = [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(5))]
    new = []
    for t in old:
        kind = rng.random()
        if kind < 0.2:
            continue
        new.append(t if kind < 0.4 else " ".join(word() if rng.random() < 0.3 else x for x in t.split()))
        if rng.random() < 0.2:
            new.append(" ".join(word() for _ in range(4)))
    return old, new


def sides(old, new):
    """The paragraphs of either side in the order of the comparison."""
    paras = {}
    for status, i, j, text in compare_texts(old, new):
        both = paras.setdefault((i, j), ["", ""])
        both[0] += text if status != "Inserted" else ""
        both[1] += text if status != "Deleted" else ""
    return [[p[k] for p in paras.values() if p[k]] for k in (0, 1)]


@pytest.fixture(scope="module")
def told(spark):
    rng = random.Random(11)
    cases = [case(rng) for _ in range(150)] + [([], ["new"]), (["old"], []), ([], []), (["same"], ["same"])]
    old, new = ([(n, "p", part(rng, c[k])) for n, c in enumerate(cases)] for k in (0, 1))
    frames = [spark.createDataFrame(x, SCHEMA) for x in (old, new)]
    out = in_place(*frames, "a", "d").persist()
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    return cases, {n: x for n, _, x in new}, read(out), read(M.accept_markup(out)), read(M.reject_markup(out))


def test_accepting_and_rejecting_give_both_sides(told):
    cases, _, out, accepted, rejected = told
    assert set(out) == set(range(len(cases)))
    for n, (old, new) in enumerate(cases):
        before, after = sides(old, new)
        assert after == new
        assert texts_of(accepted[n]) == after, (n, out[n])
        assert texts_of(rejected[n]) == before, (n, out[n])


def test_what_did_not_change_keeps_its_bytes(told):
    cases, new, out, _, _ = told
    same = 0
    for n, (a, b) in enumerate(cases):
        if a == b:
            same += 1
            assert out[n] == new[n]
        # paragraphs that are equal on both sides stand in the result byte for byte
        for p, text in zip(re.findall(r"<w:p>.*?</w:p>", new[n]), b):
            if text in a and b.count(text) == 1 and a.count(text) == 1 and sum(x.split() == text.split() for x in a) == 1:
                assert p in out[n]
        # without the tracked changes, the tabs, breaks, links and bookmarks are the revision's
        for tag in ("<w:tab/>", "<w:br/>", "<w:hyperlink", "<w:bookmarkStart", "<w:sectPr/>"):
            assert out[n].count(tag) == new[n].count(tag)
    assert same >= 2


def test_ids_are_new_and_differ(told):
    for n, text in told[2].items():
        ids = [int(i) for i in re.findall(r'<w:(?:ins|del) w:id="(\d+)"', text)]
        assert len(ids) == len(set(ids)), text
        assert not ids or min(ids) > max([0, *map(int, re.findall(r'w:id="(\d+)"', told[1][n]))])


def test_pairs_are_written_where_they_are_compared(spark):
    """Events, atoms and pieces were rows of some forty joins and windows, and each word that went a run of its own."""
    from quillwork.operators.redline import redlined

    run = lambda t, look="": f"<w:r>{look}<w:t>{t}</w:t></w:r>"
    old = f"{HEAD}<w:p>{run('keep')}</w:p><w:p>{run('one two ')}{run('three &amp; four', '<w:rPr><w:b/></w:rPr>')}</w:p>{TAIL}"
    new = f"{HEAD}<w:p>{run('keep')}</w:p>{TAIL}"
    pairs = spark.createDataFrame([(1, "p", old, new), (2, "p", None, new), (3, "p", old, None)], "doc_id long, part_uri string, original string, revised string")
    out = redlined(pairs, "a", "d")
    assert not re.search("Window|Join|Exchange", out._jdf.queryExecution().executedPlan().toString())
    told = {r.doc_id: r.text for r in out.collect()}
    assert set(told) == {1, 2}
    assert re.findall("<w:delText[^>]*>([^<]*)", told[1]) == ["one two ", "three &amp; four"]
    assert told[1].startswith(f"{HEAD}<w:p>{run('keep')}</w:p>") and told[1].endswith(TAIL)
    assert told[2].count("<w:ins ") == 2 and run("keep") in told[2]
