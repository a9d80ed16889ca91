"""A comparison written into the markup of the revision, where it stands.

The revised part stays as it is but for patches at known places: wrappers around what
came, copies of what went, cuts of runs where one of them begins or ends inside. Patches
and events of the part are put together in order, so what no change touches keeps its bytes.
Both parts of a pair are walked in the task that compares them; no event or atom is a row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import settled, tasks
from .alignment import BATCH_ROWS, _compared
from .markup import _CLOSE, _EMPTY, _NAMED, _OPEN, _OTHER, _REFERENCE, _RUNS, _TEXT, KEY, _resolved

_CUT_TEXT = '<w:t xml:space="preserve">'
_ID = re.compile(r' w:id="([0-9]{1,9})"')
#: Characters of parts that go back from a task at once.
_BATCH_CHARS = 8_000_000


class _Part:
    """A part walked once: its events, a run of plain text being one, and the units of its runs.

    ``raws`` are the events in order, ``places`` their numbers were each tag and text one.
    A unit is a child of a run that is not its properties: ``unit_at``, ``unit_run`` and
    ``unit_p`` are its event and those of its run and its paragraph, ``unit_text`` its
    text. ``paras`` are the units with text of each paragraph that has some, in order, and
    ``inner`` the texts of an element.
    """

    def __init__(self, text: str) -> None:
        self.raws, self.places, self.closes, self.parents, self.inner = [], [], {}, {}, {}
        self.unit_at, self.unit_run, self.unit_p, self.unit_text = [], [], [], []
        self.props: dict[int, list[tuple[int, int | None]] | str] = {}
        self.tagged: dict[str, list[tuple[int, int]]] = {t: [] for t in ("w:p", "w:pPr", "w:rPr", "w:sectPr", "w:pPrChange")}
        self.body_end: int | None = None
        self.plain: set[int] = set()
        self._walk(text)
        homes: dict[int, list[int]] = {}
        for u, t in enumerate(self.unit_text):
            if t:
                homes.setdefault(self.unit_p[u], []).append(u)
        self.home = sorted(homes)
        self.paras = [homes[p] for p in self.home]
        self.texts = ["".join(self.unit_text[u] for u in own) for own in self.paras]

    def _walk(self, text: str) -> None:
        raws, places, opened, waiting = self.raws, self.places, {}, {}
        depth, at = {"w:p": 0, "w:r": 0}, {"w:p": {}, "w:r": {}}
        level, place, waits = 0, 0, []
        for token in _RUNS.finditer(text):
            raw, i = token[0], len(raws)
            raws.append(raw)
            places.append(place)
            place += 1
            if token[2] is not None:
                p = at["w:p"][depth["w:p"]] if depth["w:p"] > 0 else None
                self.unit_at.append(i)
                self.unit_run.append(i)
                self.unit_p.append(p)
                self.unit_text.append("" if p is None else _REFERENCE.sub(_resolved, token[2]) if "&" in token[2] else token[2])
                self.plain.add(i)
                self.props[i] = "" if token[1] is None else f"<w:rPr>{token[1]}</w:rPr>"
                place += 3 + (token[2] != "") + (0 if token[1] is None else 2 + token[1].count("<"))
                # it opens and closes an element of its level
                if (before := waiting.pop(level + 1, None)) is not None:
                    self.closes[before] = i
                opened[level + 1] = i
                continue
            named = _NAMED.match(raw) if raw[0] == "<" else None
            kind = _CLOSE if raw.startswith("</") else (_EMPTY if raw.endswith("/>") else _OPEN) if named else _OTHER if raw.startswith(("<!--", "<?")) else _TEXT
            level += (kind == _OPEN) - (kind == _CLOSE)
            tag, here = named[1] if named else None, level + (kind != _OPEN)
            parent = opened.get(here - 1)
            if kind == _OPEN or kind == _CLOSE:
                if (before := waiting.pop(here, None)) is not None:
                    self.closes[before] = i
                if kind == _OPEN:
                    opened[here] = waiting[here] = i
                if tag in depth:
                    depth[tag] += 1 if kind == _OPEN else -1
                    if kind == _OPEN:
                        at[tag][depth[tag]] = i
                elif tag == "w:body" and kind == _CLOSE:
                    self.body_end = i
            if kind == _TEXT:
                if parent is not None:
                    self.inner.setdefault(parent, []).append(i)
            elif kind == _OPEN or kind == _EMPTY:
                if tag in self.tagged:
                    self.tagged[tag].append((i, kind))
                    self.parents[i] = parent
                run = at["w:r"][depth["w:r"]] if depth["w:r"] > 0 else None
                if run is not None and parent == run and tag == "w:rPr":
                    if kind == _OPEN:
                        self.props.setdefault(run, []).append(i)
                elif run is not None and parent == run:
                    p = at["w:p"][depth["w:p"]] if depth["w:p"] > 0 else None
                    self.unit_at.append(i)
                    self.unit_run.append(run)
                    self.unit_p.append(p)
                    self.unit_text.append("")
                    if tag == "w:t" and p is not None:
                        waits.append(len(self.unit_at) - 1)
        for u in waits:
            shown = "".join(raws[i] for i in self.inner.get(self.unit_at[u], ()))
            self.unit_text[u] = _REFERENCE.sub(_resolved, shown)

    def look(self, run: int) -> str:
        """The properties of a run as markup."""
        own = self.props.get(run, "")
        if not isinstance(own, str):
            own = self.props[run] = "".join("".join(self.raws[i : self.closes[i] + 1]) for i in own if i in self.closes)
        return own

    def spans(self) -> list[tuple[list[int], list[str]]]:
        """Of each paragraph, where its units with text begin and their looks."""
        out = []
        for own in self.paras:
            starts, upto = [], 0
            for u in own:
                starts.append(upto)
                upto += len(self.unit_text[u])
            out.append((starts, [self.look(self.unit_run[u]) for u in own]))
        return out


def _gone(tokens: list[str], at: int, spans: tuple[list[int], list[str]]) -> str:
    """Deleted text as runs, those neighbours as one whose first characters look the same; ``at`` is where it begins in its paragraph."""
    starts, looks = spans
    out: list[tuple[str, list[str]]] = []
    for t in tokens:
        look = looks[max(bisect_right(starts, at) - 1, 0)]
        if out and out[-1][0] == look:
            out[-1][1].append(t)
        else:
            out.append((look, [t]))
        at += len(t)
    return "".join(f'<w:r>{look}<w:delText xml:space="preserve">{escape("".join(ts))}</w:delText></w:r>' for look, ts in out)


def redlined_part(original: str, revised: str, author: str, date: str) -> str:
    """The revised part with the changes from the original one tracked in it, as ``in_place`` has it."""
    old, new = _Part(original), _Part(revised)
    who = f" w:author={quoteattr(author)} w:date={quoteattr(date)}"
    base = max(map(int, _ID.findall(revised)), default=0) + 1
    mark = lambda kind, number, nth, end="": f'<w:{kind} w:id="{base + 5 * number + nth}"{who}{end}>'  # noqa: E731  (five kinds of marks, each with numbers of its own)

    # what went, as markup: by place in a paragraph that stays, or by paragraph; and where the status of what stays turns
    spans, begun = old.spans(), [0] * len(old.paras)
    turns: dict[int, dict[int, str]] = {}
    went: dict[int, dict[int, tuple[str, int]]] = {}
    lost, waits = [], []
    upto, since, n = {}, set(), 0
    for status, i, j, tokens, _ in _compared(old.texts, new.texts):
        size = sum(map(len, tokens))
        if j >= 0:
            lost += [(j, *w) for w in waits]
            waits = []
        if status == "Deleted":
            runs = _gone(tokens, begun[i], spans[i])
            if j >= 0:
                went.setdefault(j, {})[upto.get(j, 0)] = runs, n
            else:
                waits.append((i, runs, n))
        elif size:
            own = turns.setdefault(j, {})
            if next(reversed(own.values()), None) != status:
                own[upto.get(j, 0)] = status
            upto[j] = upto.get(j, 0) + size
        if i >= 0:
            if j >= 0:
                since.add(j)
            if status != "Inserted":
                begun[i] += size
        n += len(tokens)
    lost += [(None, *w) for w in waits]

    # pieces: stretches of one text, one status, with what went before them
    pieces: dict[int, list[tuple[int, str, bool, tuple[str, int] | None]]] = {}
    tails: dict[int, tuple[str, int]] = {}
    for j, units in enumerate(new.paras):
        own, gone = turns.get(j, {}), went.get(j, {})
        if not gone and list(own.values()) == ["Equal"]:
            continue
        start, state = 0, False
        marks = sorted({*own, *gone})
        at = 0
        for u in units:
            text = new.unit_text[u]
            stop = start + len(text)
            bounds = [start]
            while at < len(marks) and marks[at] < stop:
                if marks[at] > start:
                    bounds.append(marks[at])
                at += 1
            told = []
            for a, b in pairwise([*bounds, stop]):
                state = own[a] == "Inserted" if a in own else state
                told.append((a - start, text[a - start : b - start], state, gone.get(a)))
            pieces[u] = told
            start = stop
        if start in gone:
            tails[new.unit_run[units[-1]]] = gone[start]
    number, more = {}, 1
    for u in sorted(pieces):
        number[u] = u + more
        more += len(pieces[u]) - 1

    raws = new.raws
    patches: dict[int, list[tuple[int, int, str]]] = {}
    put = lambda at, turn, pos, raw: patches.setdefault(at, []).append((turn, pos, raw)) if raw and at is not None else None
    deleted = lambda d: f"{mark('del', d[1], 2)}{d[0]}</w:del>" if d else ""
    touched = {new.unit_run[u] for u in pieces}
    of_run: dict[int, list[int]] = {}
    for u, r in enumerate(new.unit_run):
        if r in touched:
            of_run.setdefault(r, []).append(u)
    for r, units in of_run.items():
        was = None
        plain, run_raw, look = r in new.plain, "<w:r>" if r in new.plain else raws[r], new.look(r)
        for u in units:
            own, e = pieces.get(u, [(0, "", False, None)]), new.unit_at[u]
            cut = []
            for nth, (k, text, came, gone) in enumerate(own):
                opens = mark("ins", number[u] + nth, 1) if came else ""
                again = f"</w:r>{'</w:ins>' if was else ''}{deleted(gone)}{opens}{run_raw}{look}"
                if was is None:
                    put(r, -1, e, deleted(gone) + opens)
                elif k == 0 and (was != came or gone):
                    put(e, -1, e, again)
                cut.append(f"</w:t>{again}{_CUT_TEXT}{escape(text)}" if k else escape(text))
                was = came
            if len(own) > 1 and plain:
                raws[e] = f"{run_raw}{look}{_CUT_TEXT}{''.join(cut)}</w:t></w:r>"
            elif len(own) > 1:
                raws[e] = _CUT_TEXT + "".join(cut)
                for i in new.inner[e]:
                    raws[i] = ""
        put(r if plain else new.closes.get(r), 1, units[-1], ("</w:ins>" if was else "") + deleted(tails.get(r)))

    # paragraphs of one side alone
    last = new.closes.get(new.home[-1]) if new.home else None
    for j, i, runs, n in lost:
        para = f"<w:p><w:pPr><w:rPr>{mark('del', n, 0, '/')}</w:rPr></w:pPr>{mark('del', n, 3)}{runs}</w:del></w:p>"
        at, turn = (new.home[j], -2) if j is not None else (last, 2) if last is not None else (new.body_end, -1)
        put(at, turn, i, para)
    child: dict[str, dict[int, tuple[int, int]]] = {t: {} for t in new.tagged}
    for t, found in new.tagged.items():
        for i, kind in found:
            child[t].setdefault(new.parents[i], (i, kind))
    for j, p in enumerate(new.home):
        if j in since or j not in turns:
            continue
        sign = mark("ins", new.places[p], 4, "/")
        boxed = f"<w:rPr>{sign}</w:rPr>"
        ppr, kind = child["w:pPr"].get(p, (None, None))
        rpr, inside = child["w:rPr"].get(ppr, (None, None)) if ppr is not None else (None, None)
        if ppr is None:
            put(p, 1, 0, f"<w:pPr>{boxed}</w:pPr>")
        elif kind == _EMPTY:
            raws[ppr] = f"<w:pPr>{boxed}</w:pPr>"
        elif rpr is None:
            late = [child[t][ppr][0] for t in ("w:sectPr", "w:pPrChange") if ppr in child[t]]
            put(min(late, default=new.closes.get(ppr)), -1, 0, boxed)
        elif inside == _EMPTY:
            raws[rpr] = boxed
        else:
            put(rpr, 1, 0, sign)

    out, done = [], 0
    for at in sorted(patches):
        own = sorted(patches[at])
        out += raws[done:at]
        out += [raw for turn, _, raw in own if turn < 0]
        out.append(raws[at])
        out += [raw for turn, _, raw in own if turn > 0]
        done = at + 1
    return "".join(out + raws[done:])


def part_texts(parts: DataFrame, name: str) -> DataFrame:
    """(pair_id, name): the paragraphs of each part that have text, in order; pair_id is its doc_id."""
    kind = parts.schema["doc_id"].dataType
    told = T.StructType([T.StructField("pair_id", kind), T.StructField(name, T.ArrayType(T.StringType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(texts, pa.list_(pa.string()))], names=told.names)

            for id_, text in zip(*batch.columns):
                if found := _Part(text.as_py() or "").texts:
                    ids.append(id_.as_py())
                    texts.append(found)
                    held += len(found)
                if held >= BATCH_ROWS:
                    yield made()
                    ids, texts, held = [], [], 0
            if ids:
                yield made()

    return parts.select("doc_id", "text").mapInArrow(read, told)


def redlined(pairs: DataFrame, author: str, date: str) -> DataFrame:
    """(doc_id, part_uri, text) of pairs of parts (doc_id, part_uri, original, revised), as ``in_place`` has them; the caller deals them out."""
    told = T.StructType([*[pairs.schema[c] for c in KEY], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, texts, held = 0, [], 0
            for n, sides in enumerate(zip(*batch.columns[2:]), 1):
                old, new = (s.as_py() or "" for s in sides)
                texts.append(redlined_part(old, new, author, date) if new else None)
                held += len(texts[-1] or "")
                if held >= _BATCH_CHARS or n == batch.num_rows:
                    own = batch.slice(start, n - start)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string())], names=told.names)
                    start, texts, held = n, [], 0

    return pairs.select(*KEY, "original", "revised").mapInArrow(run, told).where("text is not null")


def in_place(original: DataFrame, revised: DataFrame, author: str, date: str) -> DataFrame:
    """(doc_id, part_uri, text): the revised parts with the changes from the original ones tracked in them.

    Both sides have doc_id (a number), part_uri and text, one part a document and no
    tracked changes of their own; a document that only the original has gives no row.
    What counts is the text of ``w:t`` within paragraphs that have some: accepting all
    gives that of the revision, rejecting all that of the original, paragraphs in the
    order of the comparison. Tabs, breaks and drawings stay as the revision has them.

    Runs are cut where a change begins or ends, and pieces have the properties of their
    run; what was deleted has those that it had, and stands before what follows it. A
    paragraph of its own is marked as inserted or deleted as a whole. New ids are greater
    than any of the part. What is read more than once is told once: the result is settled.
    """
    # few bytes of markup can be much work: pairs are dealt out by number, and the join takes that as it is
    n = tasks(revised.sparkSession)
    old = original.select("doc_id", F.col("text").alias("original")).repartition(n, "doc_id")
    new = revised.select(*KEY, F.col("text").alias("revised")).repartition(n, "doc_id")
    return settled(redlined(new.join(old, "doc_id", "left"), author, date))
