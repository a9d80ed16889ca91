"""Markup as events: accepting, rejecting and the scopes of namespaces, against a tree that is changed step by step."""

import random
from xml.dom import minidom

from quillwork.operators.markup import accept_markup, atoms_of_parts, collapse_fields, comparison_atoms, events, field_spans, reject_markup, undeclared_uses

NS = 'xmlns:w="urn:w"'
KIND = "doc_id int, part_uri string, text string"
RANGES = {"w:moveFromRangeStart", "w:moveFromRangeEnd", "w:moveToRangeStart", "w:moveToRangeEnd"}
PROPS = ["w:rPrChange", "w:pPrChange", "w:sectPrChange", "w:tblPrChange", "w:trPrChange", "w:tcPrChange"]


def run(rng, tag="t"):
    look = rng.choice(["", "<w:rPr><w:b/></w:rPr>", '<w:rPr><w:b/><w:rPrChange w:id="1"><w:rPr><w:i/></w:rPr></w:rPrChange></w:rPr>', '<w:rPr><w:b/><w:rPrChange w:id="2"/></w:rPr>'])
    return f'<w:r w:rsidDel="0A">{look}<w:{tag}>{rng.choice(["a", "b &amp; c", "d", ""])}</w:{tag}></w:r>'


def content(rng, depth=0):
    out = []
    for _ in range(rng.randrange(4)):
        pick = rng.randrange(9)
        if pick < 2 or depth > 2:
            out.append(run(rng, rng.choice(["t", "delText"])))
        elif pick < 6:
            tag = rng.choice(["ins", "del", "moveFrom", "moveTo"])
            out.append(f'<w:{tag} w:id="{rng.randrange(99)}" w:author="x > y">{content(rng, depth + 1)}</w:{tag}>')
        elif pick == 6:
            out.append(rng.choice(['<w:moveFromRangeStart w:id="3"/>', "<w:moveToRangeEnd/>", "<!-- <w:del> -->"]))
        elif pick == 7:
            out.append(f"<w:hyperlink>{content(rng, depth + 1)}</w:hyperlink>")
        else:
            out.append(f'<w:bookmarkStart w:id="{rng.randrange(9)}"/>')
    return "".join(out)


def paragraph(rng):
    if rng.random() < 0.1:
        return "<w:p/>"
    mark = rng.choice(["", "", "", '<w:ins w:id="7"/>', '<w:del w:id="8"/>'])
    change = rng.choice(["", "", '<w:pPrChange w:id="9"><w:pPr><w:jc w:val="left"/></w:pPr></w:pPrChange>'])
    props = rng.choice(["", f"<w:pPr><w:rPr>{mark}</w:rPr>{change}</w:pPr>"])
    return f"<w:p>{props}{content(rng)}</w:p>"


def body(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 6)):
        pick = rng.randrange(8)
        if pick == 0 and depth < 2:
            out.append(f"<w:tbl><w:tr><w:tc>{body(rng, depth + 1)}</w:tc></w:tr></w:tbl>")
        elif pick == 1:
            out.append(f'<w:bookmarkEnd w:id="{rng.randrange(9)}"/>')
        else:
            out.append(paragraph(rng))
    return "".join(out)


def elements(node, *tags):
    return [e for e in node.getElementsByTagName("*") if e.tagName in tags]


def children(e):
    return [c for c in e.childNodes if c.nodeType == 1]


def only(p, gone, stays):
    some = False
    for c in children(p):
        if c.tagName in stays:
            return False
        some |= c.tagName in gone
        if c.tagName == "w:pPr" or c.tagName in RANGES or c.tagName in gone:
            continue
        if c.tagName == "w:r" or c.getElementsByTagName("w:r"):
            return False
    return some


def doomed(root, gone, stays):
    mark = lambda p: any(m.tagName == gone[0] for a in children(p) if a.tagName == "w:pPr" for b in children(a) if b.tagName == "w:rPr" for m in children(b))
    return [p for p in elements(root, "w:p") if mark(p) or only(p, gone, stays)]


def drop(nodes):
    for n in nodes:
        if n.parentNode:
            n.parentNode.removeChild(n)


def unwrap(root, *tags):
    for e in reversed(elements(root, *tags)):
        while e.firstChild:
            e.parentNode.insertBefore(e.firstChild, e)
        e.parentNode.removeChild(e)


def accepted(text):
    root = minidom.parseString(text).documentElement
    out = doomed(root, ("w:del", "w:moveFrom"), ("w:ins", "w:moveTo"))
    drop(elements(root, "w:del", "w:moveFrom", *RANGES))
    unwrap(root, "w:ins", "w:moveTo")
    drop(elements(root, *PROPS))
    drop(out)
    for e in elements(root, *{x.tagName for x in root.getElementsByTagName("*")}):
        if e.hasAttribute("w:rsidDel"):
            e.removeAttribute("w:rsidDel")
    return root


def rejected(text):
    root = minidom.parseString(text).documentElement
    out = doomed(root, ("w:ins", "w:moveTo"), ("w:del", "w:moveFrom"))
    marks = ("w:bookmarkStart", "w:bookmarkEnd")
    for p in out:
        line = children(p.parentNode)
        at = next(i for i, x in enumerate(line) if x is p)
        kept = lambda x: x.tagName == "w:p" and all(x is not o for o in out)
        target = next((x for x in line[at + 1 :] if kept(x)), None) or next((x for x in reversed(line[:at]) if kept(x)), None)
        if target is None:
            continue
        moving = [c for c in children(p) if c.tagName in marks]
        for side in (reversed(line[:at]), line[at + 1 :]):
            for x in side:
                if x.tagName not in marks:
                    break
                moving.append(x)
        for m in moving:
            m.parentNode.removeChild(m)
            target.insertBefore(m, next((c for c in target.childNodes if getattr(c, "tagName", "") != "w:pPr"), None))
    drop(elements(root, "w:ins", "w:moveTo", *RANGES))
    unwrap(root, "w:del", "w:moveFrom")
    for e in elements(root, "w:delText"):
        e.tagName = e.nodeName = "w:t"
    for name in PROPS:
        for c in reversed(elements(root, name)):
            held, props = c.parentNode, [x for x in children(c) if x.tagName == name.replace("Change", "")]
            if held and held.parentNode:
                if props:
                    held.parentNode.replaceChild(props[0].cloneNode(True), held)
                else:
                    held.parentNode.removeChild(held)
    drop(out)
    return root


def plain(root):
    """One form of a tree: empty elements as such, attributes as they come."""
    return minidom.parseString(root if isinstance(root, str) else root.toxml()).documentElement.toxml()


def made(n, seed):
    rng = random.Random(seed)
    return [(i, "word/document.xml", f"<w:document {NS}><w:body>{body(rng)}</w:body></w:document>") for i in range(n)]


def test_events_put_together_are_the_text(spark):
    rows = made(60, 1) + [(100, "x", "<?xml version='1.0'?>\n<a b='1>2'><!-- <c> --><d/>t<![CDATA[<e>]]></a> tail"), (101, "x", "a < b <"), (102, "x", "")]
    ev = events(spark.createDataFrame(rows, KIND).repartition(3))
    got = {}
    for r in sorted(ev.collect(), key=lambda r: r.pos):
        got.setdefault(r.doc_id, []).append(r)
    assert {i: "".join(r.raw for r in e) for i, e in got.items()} == {i: t for i, _, t in rows if t}
    for i, e in got.items():
        stack = []
        if i < 100:
            for r in e:
                if r.kind == "close":
                    assert e[stack[-1]].close == r.pos and e[stack.pop()].depth == r.depth
                assert r.parent == (stack[-1] if stack else None) and r.depth == len(stack) + 1
                if r.kind == "open":
                    stack.append(r.pos)


def test_accept_matches_a_tree(spark):
    rows = made(250, 2)
    got = {r.doc_id: plain(r.text) for r in accept_markup(spark.createDataFrame(rows, KIND).repartition(4)).collect()}
    assert got == {i: plain(accepted(t)) for i, _, t in rows}


def test_reject_matches_a_tree(spark):
    rows = made(250, 3)
    got = {r.doc_id: plain(r.text) for r in reject_markup(spark.createDataFrame(rows, KIND).repartition(4)).collect()}
    assert got == {i: plain(rejected(t)) for i, _, t in rows}


def test_untouched_parts_stay_as_they_are(spark):
    text = f"<?xml version='1.0'?>\n<w:document {NS}  >\n <w:body><w:p ><w:r><w:t xml:space='preserve'> a&#x41; </w:t ></w:r></w:p></w:body>\n</w:document>\n"
    parts = spark.createDataFrame([(1, "x", text)], KIND)
    assert accept_markup(parts).first().text == reject_markup(parts).first().text == text


def test_prefixes_hold_for_their_element_only(spark):
    text = '<r xmlns:a="1"><a:x/><b:y a:k="1" c:k="2"/><z xmlns:b="2"><b:in xmlns:b="3"><b:deep/></b:in><b:still/></z><b:out xml:lang="en"/><q xmlns:c="1" c:own="x"/></r>'
    got = sorted((r.prefix, r.local) for r in undeclared_uses(spark.createDataFrame([(1, "x", text), (2, "x", '<r xmlns:b="1"><b:y/></r>')], KIND)).collect())
    assert got == [("b", "out"), ("b", "y"), ("c", "k")]


LEAVES = {f"w:{t}" for t in ("t", "br", "cr", "tab", "sym", "softHyphen", "noBreakHyphen", "fldChar", "instrText", "delText", "footnoteReference", "drawing", "pict", "object")} | {"mc:AlternateContent"}
STATUS = {"w:ins": "Inserted", "w:del": "Deleted", "w:moveFrom": "MovedSource", "w:moveTo": "MovedDestination"}


def leaf_atoms(text):
    """(para, tag, text, mark, status, look) of the leaves of a tree, in order."""
    out, paras = [], {}

    def walk(e, above):
        if e.tagName in LEAVES:
            p = next((a for a in above if a.tagName == "w:p"), None)
            run = next((a for a in reversed(above) if a.tagName == "w:r"), None)
            wrapper = next((a for a in reversed(above) if a.tagName in STATUS), None)
            look = ""
            for c in children(run) if run else ():
                if c.tagName == "w:rPr":
                    look = "".join(x.toxml() for x in c.childNodes if getattr(x, "tagName", "") != "w:rPrChange")
            name = e.tagName.split(":")[1]
            own = "".join(t.data for t in e.childNodes if t.nodeType in (3, 4))
            shown = own if name in ("t", "delText") else {"br": "\n", "cr": "\n", "tab": "\t"}.get(name, "")
            out.append((None if p is None else paras.setdefault(id(p), len(paras)), name, shown, e.getAttribute("w:fldCharType") or None if name == "fldChar" else None, STATUS.get(wrapper.tagName if wrapper else "", "Equal"), look))
            return
        for c in children(e):
            walk(c, [*above, e])

    walk(minidom.parseString(text).documentElement, [])
    return out


def leafy(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        paras = []
        for _ in range(rng.randrange(4)):
            runs = []
            for _ in range(rng.randrange(5)):
                look = rng.choice(["", "<w:rPr><w:b/></w:rPr>", '<w:rPr><w:b/><w:rPrChange w:id="1"><w:rPr><w:i/></w:rPr></w:rPrChange></w:rPr>', "<w:rPr></w:rPr>"])
                leaf = "".join(rng.choice(["<w:t>a, b</w:t>", "<w:t>.</w:t>", "<w:t>c &lt; &#233;&#x1F389;</w:t>", "<w:t><![CDATA[x<y]]></w:t>", "<w:tab/>", "<w:br/>", "<w:t/>", '<w:fldChar w:fldCharType="begin"/>', '<w:fldChar w:fldCharType="separate"/>', '<w:fldChar w:fldCharType="end"/>', "<w:instrText>PAGE</w:instrText>", "<w:drawing><w:txbx><w:p><w:r><w:t>in</w:t></w:r></w:p></w:txbx></w:drawing>", "<w:lastRendered/>"]) for _ in range(rng.randrange(1, 3)))
                run_ = f"<w:r>{look}{leaf}</w:r>"
                wrap = rng.choice([None, None, "ins", "del", "moveTo"])
                runs.append(run_ if wrap is None else f'<w:{wrap} w:author="me" w:date="d">{run_}</w:{wrap}>')
            paras.append(f"<w:p>{''.join(runs)}</w:p>")
        out.append((i, "word/document.xml", f"<w:document {NS}><w:body>{''.join(paras)}<w:r><w:t>bare</w:t></w:r></w:body></w:document>"))
    return out


def test_atoms_match_a_tree(spark):
    rows = leafy(150, 5) + made(60, 6)
    got = {}
    for r in atoms_of_parts(spark.createDataFrame([(i if n < 150 else 1000 + i, u, t) for n, (i, u, t) in enumerate(rows)], KIND).repartition(4)).orderBy("doc_id", "atom_idx").collect():
        got.setdefault(r.doc_id, []).append((r.para_idx, r.tag, r.text, r.mark, r.status, r.look))
        assert (r.status == "Equal") == (r.author is None)
    assert got == {i if n < 150 else 1000 + i: a for n, (i, _, t) in enumerate(rows) if (a := leaf_atoms(t))}


def test_fields_match_a_stack(spark):
    rng = random.Random(7)
    rows, want = [], []
    for d in range(200):
        stack, done = [], []
        for k in range(rng.randrange(25)):
            m = rng.choice(["begin", "begin", "separate", "end", "end", None])
            rows.append((d, k, m))
            if m == "begin":
                stack.append([k, None, None, len(stack) + 1, stack[-1][0] if stack else None])
                done.append(stack[-1])
            elif m == "separate" and stack and stack[-1][1] is None:
                stack[-1][1] = k
            elif m == "end" and stack:
                stack.pop()[2] = k
        want += [(d, *f) for f in done]
    got = field_spans(spark.createDataFrame(rows, "doc int, k int, mark string").repartition(4), ["doc"], "k").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def collapsed(atoms):
    """(idx, text, is_field, para) of atoms (para, tag, text, mark, ...) with a stack of one level."""
    out, i = [], 0
    while i < len(atoms):
        idx, (para, tag, text, mark, *_) = atoms[i]
        depth, j, sep = 1, i + 1, None
        if mark == "begin":
            while j < len(atoms) and depth:
                m = atoms[j][1][3]
                depth += (m == "begin") - (m == "end")
                if m == "separate" and depth == 1 and sep is None:
                    sep = j
                j += 1
        if mark != "begin" or depth:  # a field that does not end is none
            out.append((idx, text, False, para))
            i += 1
            continue
        own = atoms[i:j]
        if len({a[1][0] for a in own}) > 1:
            cut = j if sep is None else sep + 1
            out += [(k, a[2], False, a[0]) for k, a in atoms[i:cut]]
            if sep is not None:
                out += collapsed(atoms[cut : j - 1]) + [(atoms[j - 1][0], atoms[j - 1][1][2], False, atoms[j - 1][1][0])]
        else:
            out.append((idx, "".join(a[2] for k, a in (own if sep is None else atoms[sep + 1 : j - 1]) if a[1] == "t"), True, para))
        i = j
    return out


def test_collapsed_fields_match_a_stack(spark):
    rows = leafy(900, 8)
    atoms = atoms_of_parts(spark.createDataFrame(rows, KIND).repartition(4))
    got = {}
    for r in collapse_fields(atoms).orderBy("doc_id", "atom_idx").collect():
        got.setdefault(r.doc_id, []).append((r.atom_idx, r.text, r.is_field, r.para_idx))
    want = {i: collapsed(list(enumerate(leaf_atoms(t)))) for i, _, t in rows}
    assert got == want and sum(f for o in want.values() for _, _, f, _ in o) > 20


def test_comparison_atoms_keep_all_text(spark):
    """Fields of one paragraph give their result once, words and signs stand together, and nothing else is lost."""
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>REF x</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>on page</w:t></w:r><w:r><w:t> nine</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    text = f'<w:document {NS}><w:body><w:p><w:r><w:t>See, Sec</w:t></w:r><w:r><w:t>tion</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t> 4 .</w:t></w:r>{field}</w:p><w:p><w:r><w:t>, end</w:t></w:r></w:p></w:body></w:document>'
    got = [(r.para_idx, r.text, r.look, r.is_field) for r in comparison_atoms(spark.createDataFrame([(1, "x", text)], KIND)).orderBy("place").collect()]
    b = "<w:b/>"
    assert got == [(0, "See,", "", False), (0, " ", "", False), (0, "Section", "", False), (0, " ", b, False), (0, "4", b, False), (0, " .", b, False), (0, "on page nine", "", True), (1, ",", "", False), (1, " ", "", False), (1, "end", "", False)]


def test_field_query_matches_a_stack(spark):
    import os
    import re

    import pytest

    from quillwork.plans.marking import field_spans as of_documents

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        stack = []
        for k, word in enumerate(re.split(r"[ \t\n\x0b\f\r]+", r.text)):
            if len(word) in (2, 7):
                stack.append([k, None, None, len(stack) + 1, stack[-1][0] if stack else None])
                want.append((r.doc_id, stack[-1]))
            elif len(word) == 5 and stack and stack[-1][1] is None:
                stack[-1][1] = k
            elif len(word) in (3, 9) and stack:
                stack.pop()[2] = k
    got = sorted(repr(tuple(r)) for r in of_documents(spark, sf).collect())
    assert got == sorted(repr((d, *f)) for d, f in want) and max(f[3] for _, f in want) > 3


def test_a_run_of_plain_text_is_one_event_where_changes_are_looked_for(spark):
    """Each tag and text of a run was a row of the windows; what is looked for still is one of its own."""
    plain = '<w:r><w:rPr><w:b/><w:sz w:val="2"/></w:rPr><w:t xml:space="preserve">a w:rsidDel="1" &lt;w:delText</w:t></w:r>'
    gone = "<w:r><w:delText>w:delText gone</w:delText></w:r>"
    other = '<w:r><w:rPr><w:b w:rsidDel="3"/></w:rPr><w:t>x</w:t></w:r><w:r><w:rPr><w:ins/></w:rPr><w:t>y</w:t></w:r>'
    parts = spark.createDataFrame([(1, "p", f"<w:body><w:p>{plain}<w:del>{gone}</w:del>{other}</w:p></w:body>")], "doc_id long, part_uri string, text string")
    rows = events(parts, told=True).orderBy("pos").collect()
    assert [r.kind for r in rows if r.tag == "w:r"][:2] == ["empty", "empty"] and len(rows) == 24 and "".join(r.raw for r in rows) == parts.first().text
    assert accept_markup(parts).first().text == f"<w:body><w:p>{plain}<w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r><w:r><w:rPr></w:rPr><w:t>y</w:t></w:r></w:p></w:body>"
    assert reject_markup(parts).first().text == f"<w:body><w:p>{plain}<w:r><w:t>w:delText gone</w:t></w:r>{other.replace('<w:ins/>', '')}</w:p></w:body>"


def test_leaves_are_told_in_one_walk(spark):
    """Events with what is open around were written to disk, and read by five joins; places are those of events."""
    part = '<w:body><w:p><w:ins w:id="1" w:author="a &gt; b" w:date=\'d\'><w:r><w:rPr><w:b/></w:rPr><w:t>one</w:t></w:r><w:r><w:t/><w:tab/></w:r></w:ins></w:p><w:p><w:r><w:t></w:t></w:r></w:p></w:body>'
    parts = spark.createDataFrame([(1, "p", part), (2, "p", None), (3, "p", "")], "doc_id long, part_uri string, text string")
    out = atoms_of_parts(parts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Join", "Generate")) and plan.count("Exchange") == 1 and plan.count("ExistingRDD") == 1
    runs = [r.pos for r in events(parts).where("tag = 'w:r' and kind = 'open'").orderBy("pos").collect()]
    got = [(r.atom_idx, r.para_idx, r.run, r.tag, r.text, r.status, r.author, r.date, r.look) for r in out.orderBy("atom_idx").collect()]
    who = ("Inserted", "a &gt; b", "d")
    assert got == [(0, 0, runs[0], "t", "one", *who, "<w:b/>"), (1, 0, runs[1], "t", "", *who, ""), (2, 0, runs[1], "tab", "\t", *who, ""), (3, 1, runs[2], "t", "", "Equal", None, None, "")]
    assert [(f.name, f.dataType.simpleString()) for f in out.schema if f.name in ("atom_idx", "para_idx", "run")] == [("atom_idx", "int"), ("para_idx", "int"), ("run", "int")]
