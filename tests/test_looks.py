"""Looks through a comparison, and their markup."""

import random
import re
from xml.etree import ElementTree

from quillwork.operators.alignment import compare_pairs, compare_texts
from quillwork.operators.looks import compared_parts, look_changes, look_spans, paragraph_texts
from quillwork.operators.markup import comparison_atoms
from quillwork.sources.archives import tracked_xml

LOOKS = ["", "<w:b/>", "<w:i/>", '<w:sz w:val="24"/>', '<w:b/><w:sz w:val="28"/>']


def props(look):
    return {m[0]: m[1] or "true" for m in re.findall(r'<w:(\w+)(?: w:val="([^"]*)")?/>', look)}


def cut(rng, text):
    """(start, look) spans that cover a text."""
    at, out = 0, []
    while at < len(text):
        out.append((at, rng.choice(LOOKS)))
        at += rng.randrange(1, 9)
    return out


def case(rng):
    words = lambda: " ".join(rng.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(rng.randrange(9)))
    old = [words() for _ in range(rng.randrange(1, 4))]
    new = [" ".join(w for w in t.split() if rng.random() < 0.8) if rng.random() < 0.7 else words() for t in old]
    return old, new


def look_of(spans, at):
    return [look for start, look in spans if start <= at][-1]


def brute(old, new, old_spans, new_spans):
    out, at = [], [{}, {}]
    for n, (status, i, j, text) in enumerate(compare_texts(old, new)):
        looks = [None, None]
        for k, (para, spans, other) in enumerate(((i, old_spans, "Inserted"), (j, new_spans, "Deleted"))):
            if status != other:
                start = at[k].get(para, 0)
                at[k][para] = start + len(text)
                looks[k] = look_of(spans[para], start) if text else None
        a, b = props(looks[0] or ""), props(looks[1] or "")
        changed = status == "Equal" and a != b
        out.append((n, "FormatChanged" if changed else status, text, looks[0], looks[1], sum(a.get(x) != b.get(x) for x in {*a, *b}) if changed else None))
    return out


def test_looks_match_plain_loops(spark):
    rng = random.Random(4)
    atoms, old, new, want = [], [], [], {}
    for d in range(120):
        x, y = case(rng)
        spans = [[cut(rng, t) for t in side] for side in (x, y)]
        atoms += [(d, n, *a) for n, a in enumerate(compare_texts(x, y))]
        old += [(d, p, *s) for p, own in enumerate(spans[0]) for s in own]
        new += [(d, p, *s) for p, own in enumerate(spans[1]) for s in own]
        want[d] = brute(x, y, *spans)
    atoms = spark.createDataFrame(atoms, "pair_id long, atom_idx long, status string, orig_para int, rev_para int, text string").repartition(4)
    kind = "pair_id long, para_idx int, start int, look string"
    got = {}
    for r in look_changes(atoms, spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).orderBy("pair_id", "atom_idx").collect():
        blank = r.text == ""
        got.setdefault(r.pair_id, []).append((r.atom_idx, r.status, r.text, None if blank else r.old_look, None if blank else r.new_look, None if r.names is None else len(r.names)))
    assert got == want and sum(r[1] == "FormatChanged" for o in want.values() for r in o) > 100


def part(paras):
    runs = lambda p: "".join(f"<w:r>{'<w:rPr>' + k + '</w:rPr>' if k else ''}<w:t>{t}</w:t></w:r>" for t, k in p)
    return '<w:document xmlns:w="u"><w:body>' + "".join(f"<w:p>{runs(p)}</w:p>" for p in paras) + "</w:body></w:document>"


def test_parts_are_compared_with_their_looks(spark):
    kind = "doc_id long, part_uri string, text string"
    old = spark.createDataFrame([(1, "x", part([[("All of ", ""), ("this", "<w:b/>"), (" stays", "")], [("", "")], [("Old line", "")]]))], kind)
    new = spark.createDataFrame([(1, "x", part([[("All of this", "<w:i/>"), (" stays put", "")], [("Old line", "")]]))], kind)
    got = [(r.status, r.text, r.names and sorted(r.names)) for r in compared_parts(old, new).orderBy("atom_idx").collect() if r.status != "Equal"]
    assert got == [("FormatChanged", t, n) for t, n in (("All", ["italic"]), (" ", ["italic"]), ("of", ["italic"]), (" ", ["italic"]), ("this", ["bold", "italic"]))] + [("Inserted", " ", None), ("Inserted", "put", None)]


def test_markup_of_looks_and_moves_is_paired(spark):
    rows = [(1, 0, 0, "Equal", "a", "<w:b/>", "<w:b/>", None), (1, 0, 1, "FormatChanged", "b", "<w:i/>", "", None), (1, 0, 2, "MovedSource", "c", "", None, 1), (1, 0, 3, "MovedSource", "d", "", None, 1), (1, 1, 4, "MovedSource", "e", "", None, 2),
            (1, 1, 5, "Inserted", "f", None, "<w:b/>", None), (1, 2, 6, "MovedDestination", "c", None, "", 1), (1, 2, 7, "MovedDestination", "d", None, "", 1), (1, 2, 8, "MovedDestination", "e", None, "", 2)]
    atoms = spark.createDataFrame(rows, "doc_id int, para_idx int, atom_idx long, status string, text string, old_look string, new_look string, move_group int")
    root = ElementTree.fromstring(bytes(tracked_xml(atoms, "me", "2026-01-01T00:00:00Z").first().content))
    w = lambda t: f"{{http://schemas.openxmlformats.org/wordprocessingml/2006/main}}{t}"
    starts = [(e.tag, e.get(w("id")), e.get(w("name"))) for e in root.iter() if e.tag.endswith("RangeStart")]
    ends = [(e.tag.replace("End", "Start"), e.get(w("id"))) for e in root.iter() if e.tag.endswith("RangeEnd")]
    assert sorted(s[:2] for s in starts) == sorted(ends) and sorted(n for _, _, n in starts) == ["move1", "move1", "move2", "move2"]
    ids = [e.get(w("id")) for e in root.iter() if e.get(w("id")) and not e.tag.endswith("RangeEnd")]
    assert len(ids) == len(set(ids))
    change = root.find(f".//{w('rPrChange')}")
    assert [c.tag for c in change.iter()][1:] == [w("rPr"), w("i")]
    looks = [[c.tag for c in r.find(w("rPr"))] for r in root.iter(w("r")) if r.find(w("rPr")) is not None]
    assert looks == [[w("b")], [w("rPrChange")], [w("b")]]


def composed(old, new):
    """The comparison of parts by their atoms, spans and looks as tables."""
    sides = [comparison_atoms(p) for p in (old, new)]
    texts = [paragraph_texts(a, n) for a, n in zip(sides, ("original", "revised"))]
    return look_changes(compare_pairs(texts[0].join(texts[1], "pair_id", "full_outer")), *[look_spans(a) for a in sides])


def test_parts_compared_in_one_walk_are_those_of_the_tables(spark):
    """Fields, drawings, records of changes, references and broken markup; no tag is a row of a shuffle."""
    from .test_markup import leafy

    broken = ["<w:p><w:r><w:t>a</w:p></w:r>b<w:t>c", "</w:r></w:p><w:p><w:r><w:rPr><w:b/><w:r><w:rPr><w:i/></w:rPr><w:t>x y</w:t></w:r></w:rPr><w:t>z</w:t></w:r></w:p>", "<w:t>a<w:r><w:t>b</w:t></w:r>c</w:t>", "<w:p><w:r><w:rPr><w:tab/></w:rPr><w:t>t</w:t></w:r><w:r><w:rPr/><w:t>u &nope; &amp;lt;</w:t></w:r><w:r><w:t>v</w:t><w:rPr><w:u w:val='x'/></w:rPr></w:r></w:p>"]
    kind = "doc_id long, part_uri string, text string"
    old = [(i, "x", t) for i, _, t in leafy(300, 21)] + [(1000 + i, "x", t) for i, t in enumerate(broken)] + [(2000, "x", broken[0])]
    new = [(i, "x", t.replace("a, b", "a b") if i % 3 else t) for i, _, t in leafy(300, 22)[:150]] + [(i, "x", t.replace("<w:b/>", "<w:i/>", 2)) for i, _, t in leafy(300, 21)[150:]] + [(1000 + i, "x", t) for i, t in enumerate(broken[::-1])] + [(2001, "x", broken[3])]
    old, new = (spark.createDataFrame(rows, kind).repartition(4) for rows in (old, new))
    got = compared_parts(old, new)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    got, want = (sorted(map(tuple, df.collect()), key=lambda r: r[:2]) for df in (got, composed(old, new)))
    assert got == want and sum(r[2] == "FormatChanged" for r in want) > 50 and {r[0] for r in want} >= {1001, 1003, 2001}
