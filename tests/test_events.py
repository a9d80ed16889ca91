"""Events of markup, well formed or not, in one walk."""

import random

from quillwork.operators import markup as M

PIECES = ["<a>", "</a>", "<b k='>'>", "</b>", "<c/>", "x & y", "<!-- <a> -->", "<![CDATA[<b>]]>", "</", "<"]


def plain(raws):
    """Depths by a running sum; an end is the next tag of one depth, a parent the last opening tag one depth up, by looking."""
    level, rows = 0, []
    for raw in raws:
        tag = raw.strip("</>").split(" ")[0] if raw[0] == "<" and len(raw) > 2 and raw[1] != "!" else None
        kind = "close" if raw.startswith("</") else "empty" if tag and raw.endswith("/>") else "open" if tag else "other" if raw.startswith("<!--") else "text"
        level += (kind == "open") - (kind == "close")
        rows.append((kind, tag, level + (kind != "open")))
    out = []
    for i, (kind, tag, depth) in enumerate(rows):
        paired = [j for j in range(i + 1, len(rows)) if rows[j][0] in ("open", "close") and rows[j][2] == depth]
        close = i if kind == "empty" else paired[0] if kind == "open" and paired else None
        up = [j for j in range(i) if rows[j][0] == "open" and rows[j][2] == depth - 1]
        out.append((raws[i], kind, tag, depth, close, up[-1] if up else None))
    return out


def test_events_are_those_of_the_definition(spark):
    rng = random.Random(4)
    parts = [[rng.choice(PIECES[:8]) for _ in range(rng.randrange(1, 30))] for _ in range(150)]
    parts = [[x for i, x in enumerate(p) if not (i and x == p[i - 1] == "x & y")] for p in parts]
    frame = spark.createDataFrame([(i, "p", "".join(p)) for i, p in enumerate(parts)] + [(999, "p", None)], "doc_id long, part_uri string, text string")
    got = {}
    for r in M.events(frame).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.raw, r.kind, r.tag, r.depth, r.close, r.parent))
    assert got == {i: plain(p) for i, p in enumerate(parts)}


def test_events_take_one_shuffle_of_whole_parts(spark):
    """Events once went through a shuffle and three sorts."""
    frame = spark.createDataFrame([(1, "p", "<a>b</a>")], "doc_id long, part_uri string, text string")
    plan = M.events(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Sort " not in plan


def test_markup_is_rejected_and_accepted_in_one_shuffle_of_whole_parts(spark):
    """Rejecting once joined events by place, which shuffled each of them again; a shared name of the parts did so too."""
    text = '<w:p><w:bookmarkStart w:id="1"/><w:ins><w:r><w:t>a</w:t></w:r></w:ins></w:p><w:p/>'
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string").selectExpr("doc_id", "'p' AS part_uri", "text")
    for done, want in ((M.reject_markup(frame), '<w:p><w:bookmarkStart w:id="1"/></w:p>'), (M.accept_markup(frame), text.replace("<w:ins>", "").replace("</w:ins>", ""))):
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
        assert done.first().text == want
