"""Markup as a table of events, and operations on it by running sums, intervals and joins of places.

A part of a document is cut into tags and texts in the JVM. Each event knows its depth,
where its element ends and where its parent begins, so what holds for a subtree is an
interval, and what holds for a parent is an equi-join of places. A changed part is the
events that stay, put together in order: every byte that is not touched stays as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..lineage import settled, tasks
from .ordered import merged_runs, punctuation_attached
from .views import LEAVES

KEY = ["doc_id", "part_uri"]

_TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|</?[^\s<>/!?](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""

# Names of the markup that tracks changes.
RANGES = ("w:moveFromRangeStart", "w:moveFromRangeEnd", "w:moveToRangeStart", "w:moveToRangeEnd")
CHANGES = ("w:rPrChange", "w:pPrChange", "w:sectPrChange", "w:tblPrChange", "w:trPrChange", "w:tcPrChange")
DELETED, INSERTED = ("w:del", "w:moveFrom"), ("w:ins", "w:moveTo")
STATUS_OF = {"w:ins": "Inserted", "w:del": "Deleted", "w:moveFrom": "MovedSource", "w:moveTo": "MovedDestination"}
BOOKMARKS = ("w:bookmarkStart", "w:bookmarkEnd")

#: What accepting and rejecting look for, which no run that is one event holds.
_LOOKED_FOR = "|".join(t.removeprefix("w:") for t in (*RANGES, *CHANGES, *DELETED, *INSERTED, *BOOKMARKS, "w:p", "w:r", "w:pPr", "w:rPr"))
_SHUT = "</w:r>"
#: A run of plain text, kept or deleted, whose properties are empty tags, as most runs are, and else a tag or text.
_FOLDED = rf"""(?s)<w:r>(?:<w:rPr>(?:<w:(?!(?:{_LOOKED_FOR})[ />])[A-Za-z]+(?: w:(?!rsidDel=)[A-Za-z]+="[^"'<>]*"){{0,16}}/>){{0,64}}</w:rPr>)?(?:<w:t(?: xml:space="preserve")?>[^<]*</w:t>|<w:delText(?: xml:space="preserve")?>[^<]*</w:delText>){_SHUT}|{_TOKEN.removeprefix("(?s)")}"""


def events(parts: DataFrame, told: bool = False) -> DataFrame:
    """(doc_id, part_uri, pos, raw, kind, tag, depth, close, parent) of parts (doc_id, part_uri, text).

    ``kind`` is open, close, empty, text or other (comments and instructions); ``tag`` the
    qualified name; ``depth`` counts from 1 at the root, an element's tags and its
    siblings' having one depth; ``close`` is the place of the end tag of an opened element
    (its own place for an empty one), ``parent`` that of the tag around. The raw strings
    of a part put together in order are its text.

    With ``told``, also ``about``, what an element holds (on both its tags, as bits), and
    ``body``, the place behind an element's leading paragraph properties, else its own;
    a run of plain text is one event then, an empty ``w:r``, as nothing in it is looked for.
    """
    token = _FOLDED if told else _TOKEN
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    walked = T.StructType([*[T.StructField(c, kinds[c]) for c in (*KEY, "text")], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in _PLACES]])
    rows = parts.select(*KEY, "text").mapInArrow(partial(_walked, token), walked)
    # parts are dealt out whole and once, with their places as small numbers: they are smaller than their events, and what follows
    # finds the events of a part together; by document alone, as a name that all parts share would be folded and the dealing forgotten
    rows = rows.repartition(tasks(parts.sparkSession), "doc_id").withColumn("raws", F.regexp_extract_all("text", F.lit(token), 0))
    rows = rows.select(*KEY, F.posexplode(F.arrays_zip("raws", *_PLACES)).alias("pos", "x"))
    near = lambda c: F.col("pos") + F.col(f"x.{c}")
    told_of = (F.col("x.about"), near("body").alias("body")) if told else ()
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("x.kind") + 1)
    tag = F.when(F.col("x.kind") < 3, F.regexp_extract("x.raws", _TAG, 1))
    return rows.select(*KEY, "pos", F.col("x.raws").alias("raw"), kind.alias("kind"), tag.alias("tag"), "x.depth", near("close").alias("close"), near("parent").alias("parent"), *told_of)


#: What the walk tells of each event; places are counted from its own.
_PLACES = ("kind", "depth", "close", "parent", "about", "body")
_KINDS = ("open", "close", "empty", "text", "other")
_OPEN, _CLOSE, _EMPTY, _TEXT, _OTHER = range(5)
_TAG = r"^</?([^ \t\n\x0b\f\r<>/!?]+)"

#: What is told of an element by the bits of ``about``: children that delete or insert, others of w: that are or hold runs, a record
#: of changes; a deleted or inserted mark of its paragraph; that it is the first record around or, in one, the first of what was; that it ends here.
HOLDS_DELETED, HOLDS_INSERTED, HOLDS_RUN, HOLDS_RECORD, MARK_DELETED, MARK_INSERTED, FIRST_RECORD, HAS_FORMER, IS_FORMER, ENDS = (1 << k for k in range(10))
_CHILD = dict.fromkeys(DELETED, HOLDS_DELETED) | dict.fromkeys(INSERTED, HOLDS_INSERTED) | dict.fromkeys(CHANGES, HOLDS_RECORD)
_MARK = {"w:del": MARK_DELETED, "w:ins": MARK_INSERTED}
_NO_RUN = {"w:pPr", *RANGES, *DELETED, *INSERTED}


def _walked(token: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with the places of their tags and texts, a few parts at a time."""
    tokens, tag_of = re.compile(token, re.ASCII), re.compile(_TAG)
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            found: list[list] = [[] for _ in _PLACES]
            bounds, stop = [0], start
            while stop < batch.num_rows and bounds[-1] < 50_000:
                _places(tokens.finditer(batch.column(2)[stop].as_py() or ""), tag_of, found)
                bounds.append(len(found[0]))
                stop += 1
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(c, pa.int32())) for c in found]
            yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns, *lists], names=[*batch.schema.names, *_PLACES])
            start = stop


def _places(tokens: Iterator[re.Match], tag_of: re.Pattern, found: list[list]) -> None:
    """Adds kind, depth, close, parent, about and body of the tags and texts of a part, in one walk that knows what is open at each depth."""
    kinds, depths, closes, parents, about, body = found
    level, opened, waiting, first, runs, before_runs, tags = 0, {}, {}, len(kinds), 0, {}, []
    for pos, token in enumerate(tokens):
        raw = token[0]
        named = tag_of.match(raw) if raw[0] == "<" else None
        kind = _CLOSE if raw.startswith("</") else (_EMPTY if raw.endswith(("/>", _SHUT)) else _OPEN) if named else _OTHER if raw.startswith(("<!--", "<?")) else _TEXT
        level += (kind == _OPEN) - (kind == _CLOSE)
        depth = level + (kind != _OPEN)
        tag, parent, own = named[1] if named else None, opened.get(depth - 1), 0
        if parent is not None and (kind == _OPEN or kind == _EMPTY):
            up, around = first + parent, tags[parent]
            bit = _CHILD.get(tag, 0)
            if bit == HOLDS_RECORD and not about[up] & HOLDS_RECORD:
                own |= FIRST_RECORD
            if about[up] & FIRST_RECORD and not about[up] & HAS_FORMER and tag == around.replace("Change", ""):
                own |= IS_FORMER
                bit |= HAS_FORMER
            about[up] |= bit | (HOLDS_RUN if tag == "w:r" else 0)
            if tag in _MARK and around == "w:rPr" and parents[up] is not None:
                props = parent + parents[up]
                if tags[props] == "w:pPr" and parents[first + props] is not None:
                    about[first + props + parents[first + props]] |= _MARK[tag]
            if tag == "w:pPr" and kind == _EMPTY and pos == parent + 1:
                body[up] = 1
        runs += tag == "w:r" and kind != _CLOSE
        kinds.append(kind)
        tags.append(tag)
        depths.append(depth)
        closes.append(0 if kind == _EMPTY else None)
        parents.append(None if parent is None else parent - pos)
        body.append(0)
        if kind == _OPEN or kind == _CLOSE:
            before = waiting.pop(depth, None)
            if before is not None:
                start = first + before
                closes[start], own = pos - before, about[start] | ENDS
                if parents[start] is not None:
                    outer = before + parents[start]
                    if runs > before_runs[before] and tags[before].startswith("w:") and tags[before] not in _NO_RUN:
                        about[first + outer] |= HOLDS_RUN
                    if tags[before] == "w:pPr" and before == outer + 1:
                        body[first + outer] = pos - outer
            if kind == _OPEN:
                waiting[depth] = opened[depth] = pos
                before_runs[pos] = runs
        about.append(own)


def joined(rows: DataFrame) -> DataFrame:
    """(doc_id, part_uri, text): events (at, turn, pos, raw) put together in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "turn", "pos", "raw"))), lambda x: x["raw"])
    return rows.groupBy(*KEY).agg(F.array_join(texts, "").alias("text"))


def attribute(raw: Column, name: str) -> Column:
    """The value of an attribute of a tag; null where it has none."""
    found = F.regexp_extract(raw, rf"""\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.when(found != "", F.substring(found, F.lit(2), F.length(found) - 2))


def within(rows: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: how many of the spans (pos, close) each event lies in, its bounds included; a span may count less than nothing (``weight``)."""
    ends = spans.select(*KEY, F.inline(F.array(F.struct(F.col("pos").alias("pos"), F.col("weight").alias("w_on"), F.lit(0).alias("w_off")), F.struct(F.col("close").alias("pos"), F.lit(0).alias("w_on"), F.col("weight").alias("w_off")))))
    ends = ends.groupBy(*KEY, "pos").agg(F.sum("w_on").alias("w_on"), F.sum("w_off").alias("w_off"))
    w = Window.partitionBy(*KEY).orderBy("pos")
    out = rows.join(ends, [*KEY, "pos"], "left")
    on = F.sum(F.coalesce("w_on", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    off = F.coalesce(F.sum(F.coalesce("w_off", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn(name, on - off).drop("w_on", "w_off")


def _has(bit: int) -> Column:
    return F.col("about").bitwiseAND(F.lit(bit)) != 0


def _starts() -> Column:
    return F.col("kind").isin("open", "empty")


def _is_folded() -> Column:
    """Whether an event is a whole run of plain text."""
    return (F.col("kind") == "empty") & F.endswith("raw", F.lit(_SHUT))


def _doomed(gone: Sequence[str]) -> Column:
    """Whether a paragraph (told on both its tags) goes with what is ``gone``.

    Those are paragraphs whose own mark is of the kind that goes (w:del or w:ins), and
    those of which only wrappers that go have runs, if they have such a wrapper and none
    that stays.
    """
    mark, some, others = (MARK_DELETED, HOLDS_DELETED, HOLDS_INSERTED) if gone == DELETED else (MARK_INSERTED, HOLDS_INSERTED, HOLDS_DELETED)
    return F.coalesce(F.col("tag") == "w:p", F.lit(False)) & (_has(mark) | (_has(some) & ~_has(others | HOLDS_RUN)))


def _left(rows: DataFrame, weight: Column, gone: Sequence[str]) -> DataFrame:
    """Adds ``inside``: by how much the elements that an event lies in weigh, its own bounds included, by running sums over each part.

    Elements of the kinds that are gone and marks of moved ranges weigh 1 each, besides
    their ``weight``. What is told of an element stands on both its tags, so no bound is joined.
    """
    weight = weight + F.coalesce(F.col("tag").isin(*gone, *RANGES), F.lit(False)).cast("int")
    w = Window.partitionBy(*KEY).orderBy("pos")
    on = F.sum(F.when(_starts(), weight).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = (F.col("kind") == "empty") | (F.col("kind") == "close") & _has(ENDS)
    off = F.sum(F.when(ends, weight).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inside", on - F.coalesce(off, F.lit(0)))


def _stays(stays: Sequence[str]) -> Column:
    """Whether an event stays: not in what is gone, nor a wrapper of what stays."""
    return (F.col("inside") <= 0) & ~F.coalesce(F.col("tag").isin(*stays), F.lit(False))


def accept_markup(parts: DataFrame) -> DataFrame:
    """(doc_id, part_uri, text) with all tracked changes accepted.

    What is deleted or moved away goes, with the paragraphs of which nothing else was
    and those whose mark is deleted; wrappers of what is inserted or moved here are taken
    off; records of property changes go, and so does the deletion's session attribute.
    """
    changes = F.coalesce(F.col("tag").isin(*CHANGES), F.lit(False))
    left = _left(events(parts, told=True), _doomed(DELETED).cast("int") + changes.cast("int"), DELETED).where(_stays(INSERTED))
    raw = F.when(_starts() & ~_is_folded(), F.regexp_replace("raw", r"""\sw:rsidDel\s*=\s*("[^"]*"|'[^']*')""", "")).otherwise(F.col("raw"))
    return joined(left.select(*KEY, F.col("pos").alias("at"), F.lit(0).alias("turn"), "pos", raw.alias("raw")))


def _moved_bookmarks(rows: DataFrame) -> DataFrame:
    """Adds ``moved`` to events (with ``gone``: that a doomed paragraph begins): owner, how, nth and at of a bookmark that moves, null of all else.

    Bookmarks of doomed paragraphs and beside them go to the beginning of the next
    paragraph beside theirs that stays, behind its properties, else of the one before;
    the last that is moved, by owner, how and nth, stands first.
    """
    is_mark = _starts() & F.col("tag").isin(*BOOKMARKS)
    kept = F.when(_starts() & (F.col("tag") == "w:p") & ~F.col("gone"), F.col("body"))
    # running frames from either end; a frame that shrinks would be read anew for each row
    behind, ahead = (Window.partitionBy(*KEY, "parent").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("pos", F.desc("pos")))
    solid = F.when(_starts() & ~F.col("tag").isin(*BOOKMARKS), F.struct("pos", "gone"))
    rows = rows.withColumns({"to": F.coalesce(F.last(kept, True).over(ahead), F.last(kept, True).over(behind)), "next": F.last(solid, True).over(ahead), "last": F.last(solid, True).over(behind)})
    # a bookmark and the paragraph that it is a child of meet at the place of the paragraph
    rows = rows.withColumn("home", F.when(is_mark, F.col("parent")).when(_starts() & (F.col("tag") == "w:p"), F.col("pos")))
    home = F.first(F.struct("pos", "gone", "to")).over(Window.partitionBy(*KEY, "home").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("of", F.when(is_mark, home))
    to = lambda owner, how, nth, at: F.struct(F.col(owner).alias("owner"), F.lit(how).alias("how"), nth.alias("nth"), F.col(at).alias("at"))
    # its own parent's first, else by the doomed paragraph before it, else by the one after; only bookmarks stand between, so theirs is where it goes
    inside = (F.col("of.pos") == F.col("parent")) & F.col("of.gone")
    moved = F.when(inside, to("parent", 0, F.col("pos"), "of.to")).when(F.col("last.gone"), to("last.pos", 2, F.col("pos"), "to")).when(F.col("next.gone"), to("next.pos", 1, -F.col("pos"), "to"))
    rows = rows.withColumn("moved", F.when(is_mark, moved))
    return rows.withColumn("moved", F.when(F.col("moved.at").isNotNull(), F.col("moved"))).drop("to", "next", "last", "home", "of")


def reject_markup(parts: DataFrame) -> DataFrame:
    """(doc_id, part_uri, text) with all tracked changes rejected.

    What is inserted or moved here goes, with the paragraphs of which nothing else was
    and those whose mark is inserted; bookmarks of such paragraphs move to a neighbour.
    Wrappers of what is deleted or moved away are taken off, and deleted text is text
    again. Properties are what their record of change says, or none.
    """
    rows = events(parts, told=True)
    doomed = _doomed(INSERTED)
    rows = _moved_bookmarks(rows.withColumn("gone", _starts() & doomed))
    # a record stands in the properties it tells of: these go, but for what the record holds
    rows = _left(rows, doomed.cast("int") + _has(HOLDS_RECORD).cast("int") - _has(IS_FORMER).cast("int"), INSERTED)
    rows = rows.where(F.col("moved").isNotNull() | _stays(DELETED)).withColumn("at", F.coalesce("moved.at", "pos"))
    # what comes to a place stands behind what is there; an empty paragraph there is opened, and shut behind the last
    there = Window.partitionBy(*KEY, "at").orderBy(F.col("moved").isNotNull(), F.desc("moved.owner"), F.desc("moved.how"), F.desc("moved.nth"))
    empty = F.col("moved").isNull() & (F.col("kind") == "empty") & (F.col("tag") == "w:p")
    rows = rows.withColumns({"turn": F.row_number().over(there), "more": F.lead("pos").over(there).isNotNull(), "shut": F.first(empty).over(there.rowsBetween(Window.unboundedPreceding, 0))})
    text = F.regexp_replace("raw", r"(</?)w:delText\b", "$1w:t")
    raw = F.when(F.col("moved").isNotNull(), F.when(F.col("shut") & ~F.col("more"), F.concat("raw", F.lit("</w:p>"))).otherwise(F.col("raw")))
    raw = raw.when((F.col("tag") == "w:delText") | _is_folded(), text).when(empty & F.col("more"), F.regexp_replace("raw", r"\s*/>$", ">")).otherwise(F.col("raw"))
    return joined(rows.select(*KEY, "at", "turn", "pos", raw.alias("raw")))


def atoms_of_parts(parts: DataFrame) -> DataFrame:
    """(doc_id, part_uri, atom_idx, para_idx, run, tag, text, mark, status, author, date, look): the leaves of each part in order.

    A leaf within a leaf (text within a drawing) is part of it. The nearest revision
    wrapper decides the status and gives author and date; ``para_idx`` counts the
    outermost paragraphs that have leaves; ``run`` is the place of the nearest run and
    ``look`` its properties as markup, without records of their changes; ``mark`` is begin,
    separate or end for the characters of a field.
    """
    kinds = {c: parts.schema[c] for c in KEY}
    told = T.StructType([*kinds.values(), *[T.StructField(c, T.IntegerType() if c in ("atom_idx", "para_idx", "run") else T.StringType()) for c in _ATOM]])
    # parts are dealt out whole, as they are smaller than their events, and no event is a row
    return parts.select(*KEY, "text").repartition(tasks(parts.sparkSession), "doc_id").mapInArrow(_leaf_atoms, told)


_ATOM = ("atom_idx", "para_idx", "run", "tag", "text", "mark", "status", "author", "date", "look")
#: Atoms of one batch that goes back from a task.
_ATOM_ROWS = 50_000


def _leaf_atoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The atoms of parts, a few parts at a time."""
    for batch in batches:
        home: list[int] = []
        found: list[list] = [[] for _ in _ATOM]

        def made() -> pa.RecordBatch:
            types = [pa.int32() if c in ("atom_idx", "para_idx", "run") else pa.string() for c in _ATOM]
            own = [batch.column(k).take(pa.array(home, pa.int64())) for k in range(len(KEY))]
            return pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(found, types)]], names=[*KEY, *_ATOM])

        for k, text in enumerate(batch.column(len(KEY))):
            paras, names, texts, runs, looks, marks, wrappers = _leaves(text.as_py() or "")
            n = len(paras)
            nth = {p: i for i, p in enumerate(sorted({p for p in paras if p is not None}))}
            who = {w: (STATUS_OF[_NAMED.match(w)[1]], *(_attribute(w, name) for name in ("author", "date"))) for w in set(wrappers) if w is not None}
            who[None] = ("Equal", None, None)
            home += [k] * n
            told = (range(n), map(nth.get, paras), runs, names, texts, map(marks.get, range(n)), *([who[w][i] for w in wrappers] for i in range(3)), looks)
            for own, c in zip(found, told):
                own.extend(c)
            if len(home) >= _ATOM_ROWS:
                yield made()
                home, found = [], [[] for _ in _ATOM]
        if home:
            yield made()


def _attribute(raw: str, name: str) -> str | None:
    """The value of an attribute of w: of a tag, as in ``attribute``."""
    found = re.search(rf"""\sw:{name}\s*=\s*("[^"]*"|'[^']*')""", raw, re.ASCII)
    return found and found[1][1:-1]


def field_spans(marks: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, start, separate, stop, depth, outer): the fields of (mark: begin, separate, end) rows, nested at any depth.

    A mark belongs to the innermost field open at its place: the marks of one depth
    follow each other as begin, separate, end, so neighbours in that order are one
    field. ``outer`` is the start of the field around. Ends and separators outside any
    field count for nothing; a field that does not end has a null stop.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # marks are small and much alike, so partitions joined by their bytes in a shuffle would give a task more rows the larger the input is
    rows = marks.where(F.col("mark").isin("begin", "separate", "end")).select(*group, order, "mark").repartition(4 * tasks(marks.sparkSession), *group)
    step = F.when(F.col("mark") == "begin", 1).when(F.col("mark") == "end", -1).otherwise(0)
    raw = F.sum(step).over(w)
    rows = rows.withColumn("raw", raw).withColumn("low", F.least(F.min("raw").over(w), F.lit(0)))
    below = F.coalesce(F.lag("low").over(Window.partitionBy(*group).orderBy(order)), F.lit(0))
    rows = rows.withColumn("below", below).where("not (mark = 'end' and raw < below)")  # an end of nothing
    rows = rows.withColumn("depth", (F.col("raw") - F.col("low") + F.when(F.col("mark") == "end", 1).otherwise(0)).cast("int")).where("depth > 0")
    level = Window.partitionBy(*group, "depth").orderBy(order)
    rows = rows.withColumn("nth", F.sum((F.col("mark") == "begin").cast("int")).over(level.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda m: F.min(F.when(F.col("mark") == m, F.col(order)))
    one = rows.groupBy(*group, "depth", "nth").agg(at("begin").alias("start"), at("separate").alias("separate"), at("end").alias("stop"))
    both = F.array(F.struct((F.col("depth") - 1).alias("level"), F.lit(None).cast(one.schema["start"].dataType).alias("opened")), F.struct(F.col("depth").alias("level"), F.col("start").alias("opened")))
    two = one.withColumn("two", F.explode(both))
    up = Window.partitionBy(*group, "two.level").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return two.withColumn("outer", F.last("two.opened", True).over(up)).where("two.opened is null").select(*group, "start", "separate", "stop", "depth", "outer")


def collapse_fields(atoms: DataFrame) -> DataFrame:
    """Atoms of parts, where each field within one paragraph is one atom with the text of its result.

    A field over several paragraphs, such as a table of contents, is left open: its
    marks and its code stay as they are, and fields in its result are looked at anew. A
    field within one that is collapsed goes with it; one that does not end is none.
    """
    by = Window.partitionBy(*KEY).orderBy("pos")
    turns = F.coalesce(~F.col("para_idx").eqNullSafe(F.lag("para_idx").over(by)), F.lit(True)).cast("int")
    rows = atoms.withColumnRenamed("atom_idx", "pos").withColumn("turn", turns)
    rows = settled(rows.withColumn("turn", F.sum("turn").over(by.rowsBetween(Window.unboundedPreceding, 0))))
    at = lambda name, to: rows.select(*KEY, F.col("pos").alias(name), F.col("turn").alias(to))
    fields = field_spans(rows, KEY, "pos").where("stop is not null").join(at("start", "a"), [*KEY, "start"]).join(at("stop", "b"), [*KEY, "stop"])
    single = F.col("a") == F.col("b")
    closed = fields.select(*KEY, F.col("start").alias("pos"), F.when(single, F.col("stop")).otherwise(F.coalesce("separate", "stop")).alias("close"), F.lit(1).alias("weight"), F.when(single, F.struct("start", "separate", "stop")).alias("field"))
    rows = within(rows, closed, "inside").join(closed.select(*KEY, "pos", "field"), [*KEY, "pos"], "left")
    # one that nothing but itself closes in is collapsed; these lie apart, so the last begun is the one an atom is in
    last = F.last(F.when(F.col("inside") == 1, F.col("field")), True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("f", last).withColumn("f", F.when(F.col("pos") <= F.col("f.stop"), F.col("f")))
    shown = F.when(F.col("f").isNull() | (F.col("tag").isin("t") & (F.col("pos") > F.coalesce("f.separate", F.lit(-1)))), F.col("text")).otherwise("")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("t")))), lambda x: x["t"]), "")
    first = {c: F.min_by(c, "pos").alias(c) for c in ("para_idx", "tag", "status", "look")}
    return rows.groupBy(*KEY, F.coalesce("f.start", "pos").alias("atom_idx"), F.col("f").isNotNull().alias("is_field")).agg(text.alias("text"), *first.values())


def comparison_atoms(parts: DataFrame) -> DataFrame:
    """Atoms as a comparison takes them: (doc_id, part_uri, place, para_idx, status, look, text, is_field).

    Fields of one paragraph are one atom with the text of their result; then neighbours
    of one paragraph, status and look are put together, cut into words and white space,
    and signs go to the word before them.
    """
    rows = collapse_fields(atoms_of_parts(parts))
    alone = F.col("is_field") | ~F.col("tag").isin("t", "delText")
    rows = merged_runs(rows, [*KEY, "para_idx"], "atom_idx", ["status", "look", "is_field"], alone)
    words = F.when(F.col("is_field"), F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(r"\s+|\S+"), 0))
    rows = rows.where("is_field or text <> ''").select(*KEY, "atom_idx", "para_idx", "status", "look", "is_field", F.posexplode(words).alias("nth", "text"))
    # a field or another status is another revision for the signs behind it
    rows = rows.select(*KEY, "para_idx", F.struct("atom_idx", "nth").alias("place"), "text", F.struct("status", F.when(F.col("is_field"), F.col("atom_idx")).alias("field")).alias("rev_tag"), F.struct("look").alias("rpr_hash"))
    rows = punctuation_attached(rows, [*KEY, "para_idx"], "place")
    return rows.select(*KEY, (F.row_number().over(Window.partitionBy(*KEY).orderBy("place")) - 1).alias("place"), "para_idx", "rev_tag.status", "rpr_hash.look", "text", F.col("rev_tag.field").isNotNull().alias("is_field"))


#: A run of plain text whose properties are empty tags, as most runs are: one match in place of one for each tag.
_RUN = rf"""<w:r>(?:<w:rPr>((?:<w:(?!(?:{"|".join((*LEAVES, "rPr", "rPrChange"))})[ />])[A-Za-z]+(?: w:[A-Za-z]+="[^"<>]*")*/>)*)</w:rPr>)?<w:t(?: xml:space="preserve")?>([^<]*)</w:t></w:r>"""
_RUNS, _TOKENS, _NAMED = re.compile(f"(?s){_RUN}|{_TOKEN.removeprefix('(?s)')}", re.ASCII), re.compile(_TOKEN, re.ASCII), re.compile(_TAG)
_REFERENCE = re.compile(r"(?s)<!\[CDATA\[.*?\]\]>|&[^;&<]{1,10};")
_SIGNS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_MARKED = re.compile(r"""\sw:fldCharType\s*=\s*("[^"]*"|'[^']*')""", re.ASCII)
_COUNTED = {"w:p": "p", "w:r": "run", "w:rPr": "props", "w:rPrChange": "record"} | dict.fromkeys(STATUS_OF, "wrapper") | {"mc:AlternateContent" if t == "AlternateContent" else f"w:{t}": "leaf" for t in LEAVES}
_SHOWN = {"br": "\n", "cr": "\n", "tab": "\t"}


def _resolved(found: re.Match) -> str:
    """What a reference or CDATA stands for."""
    raw = found[0]
    if raw[0] == "<":
        return raw[9:-3]
    digits = re.fullmatch(r"&#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));", raw)
    if digits is None:
        return _SIGNS.get(raw, raw)
    code = int(digits[1], 16) if digits[1] else int(digits[2])
    return "\ufffd" if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)


def _leaves(text: str) -> tuple[list[int | None], list[str], list[str], list[int | None], list[str], dict[int, str], list[str | None]]:
    """The leaves of a part in one walk, which counts what is open of each kind.

    Of each its paragraph, name, text, run (places, as ``events`` number them) and look;
    the marks of fields, by the leaf's number; and the tag of the nearest revision wrapper.
    """
    depth = dict.fromkeys(("p", "run", "props", "record", "leaf", "wrapper"), 0)
    at: dict[str, dict[int, int]] = {name: {} for name in depth}
    opened: dict[int, int] = {}
    inner: dict[int, list[str]] = {}
    looks: dict[int, list[str]] = {}
    of_props: dict[int, int | None] = {}
    level, pos, para, around = 0, -1, None, {}
    # texts that are the place of their leaf, and looks that are none, are told at the end
    paras, names, texts, runs, shown, marks, wrappers = [], [], [], [], [], {}, []

    def walked(raw: str) -> None:
        nonlocal level, para
        named = _NAMED.match(raw) if raw[0] == "<" else None
        kind = _CLOSE if raw.startswith("</") else (_EMPTY if raw.endswith("/>") else _OPEN) if named else _OTHER if raw.startswith(("<!--", "<?")) else _TEXT
        level += (kind == _OPEN) - (kind == _CLOSE)
        parent, tag = opened.get(level - (kind == _OPEN)), named[1] if named else None
        name = _COUNTED.get(tag)
        if kind == _OPEN:
            opened[level] = pos
        if name and kind == _OPEN:
            depth[name] += 1
            at[name][depth[name]] = pos
            if tag == "w:rPr":
                of_props[pos] = parent
            elif name == "wrapper":
                around[depth[name]] = raw
            if tag == "w:p" and depth["p"] == 1:
                para = pos
        elif name and kind == _CLOSE:
            depth[name] -= 1
        if name == "leaf" and (kind == _OPEN and depth["leaf"] == 1 or kind == _EMPTY and depth["leaf"] == 0):
            short = tag.rpartition(":")[2]
            if short == "fldChar" and (mark := _MARKED.search(raw)):
                marks[len(paras)] = mark[1][1:-1]
            paras.append(para if depth["p"] > 0 else None)
            names.append(short)
            texts.append(pos if short in ("t", "delText") else _SHOWN.get(short, ""))
            runs.append(at["run"].get(depth["run"]) if depth["run"] > 0 else None)
            shown.append(None)
            wrappers.append(around[depth["wrapper"]] if depth["wrapper"] > 0 else None)
        elif kind == _TEXT and depth["leaf"] == 1 and parent is not None:
            inner.setdefault(parent, []).append(raw)
        if depth["props"] > 0 and depth["record"] == 0 and tag not in ("w:rPr", "w:rPrChange"):
            owner = of_props.get(at["props"].get(depth["props"]))
            if owner is not None:
                looks.setdefault(owner, []).append(raw)

    for token in _RUNS.finditer(text):
        pos += 1
        if token[2] is None:
            walked(token[0])
        elif depth["leaf"] or depth["props"] > 0 or depth["record"]:
            for part in _TOKENS.finditer(token[0]):
                walked(part[0])
                pos += 1
            pos -= 1
        else:
            paras.append(para if depth["p"] > 0 else None)
            names.append("t")
            texts.append(_REFERENCE.sub(_resolved, token[2]) if "&" in token[2] else token[2])
            runs.append(pos)
            shown.append(token[1] or "")
            wrappers.append(around[depth["wrapper"]] if depth["wrapper"] > 0 else None)
            pos += 3 + (token[2] != "") + (0 if token[1] is None else 2 + token[1].count("<"))
    texts = [_REFERENCE.sub(_resolved, "".join(inner.get(t, ()))) if isinstance(t, int) else t for t in texts]
    return paras, names, texts, runs, ["".join(looks.get(r, ())) if k is None else k for r, k in zip(runs, shown)], marks, wrappers


def looked_paragraphs(text: str) -> list[list[tuple[str, str]]]:
    """The paragraphs of a part, each as its texts and their looks (the atoms of ``comparison_atoms``), in one walk.

    Leaves, runs, properties and fields are those of ``atoms_of_parts`` and ``collapse_fields``.
    """
    paras, names, texts, _, looks, marks, _ = _leaves(text)
    whole: dict[int | None, list[tuple[str, str]]] = {}
    for k, shown, is_field in _folded(paras, names, texts, marks) if marks else zip(range(len(texts)), texts, repeat(False)):
        if shown or is_field:
            whole.setdefault(paras[k], []).append((shown, looks[k]))
    return [whole[p] for p in sorted(whole, key=lambda p: -1 if p is None else p)]


def _folded(paras: list, names: list[str], texts: list[str], marks: dict[int, str]) -> Iterator[tuple[int, str, bool]]:
    """(number, text, is_field) of the leaves of a part, each field within one paragraph as one, as in ``collapse_fields``."""
    turn, stack, fields = [0] * len(paras), [], {}
    for k in range(1, len(paras)):
        turn[k] = turn[k - 1] + (paras[k] != paras[k - 1])
    for k, mark in marks.items():
        if mark == "begin":
            stack.append([k, None])
        elif mark == "separate" and stack and stack[-1][1] is None:
            stack[-1][1] = k
        elif mark == "end" and stack:
            start, separate = stack.pop()
            fields[start] = (separate, k, turn[start] == turn[k])
    steps = [0] * (len(paras) + 1)
    for start, (separate, stop, single) in fields.items():
        steps[start] += 1
        steps[(stop if single or separate is None else separate) + 1] -= 1
    inside, k = 0, 0
    while k < len(paras):
        inside += steps[k]
        separate, stop, single = fields.get(k, (None, k, False))
        if single and inside == 1:
            yield k, "".join(texts[i] for i in range(k if separate is None else separate + 1, stop + 1) if names[i] == "t"), True
            inside += sum(steps[k + 1 : stop + 1])
            k = stop
        else:
            yield k, texts[k], False
        k += 1


def undeclared_uses(parts: DataFrame) -> DataFrame:
    """(doc_id, part_uri, pos, prefix, local): tags and attributes whose prefix no declaration around them covers.

    A declaration holds for its element and all within. Uses and declarations of one
    prefix meet in order of place: the open ones at a use are counted by a running sum,
    so that shadowing and ends of scopes need no join of ranges.
    """
    rows = events(parts).where(F.col("kind").isin("open", "empty"))
    pairs = F.regexp_extract_all("raw", F.lit(r"""\s([^\s=<>/"']+)\s*=\s*(?:"[^"]*"|'[^']*')"""), 1)
    rows = rows.select(*KEY, "pos", "close", "tag", F.filter(pairs, lambda n: F.contains(n, F.lit(":"))).alias("names"))
    declared = rows.select(*KEY, "pos", "close", F.explode(F.filter("names", lambda n: F.startswith(n, F.lit("xmlns:")))).alias("n")).select(*KEY, F.expr("substring(n, 7)").alias("prefix"), "pos", F.coalesce("close", F.lit(2147483647)).alias("close")).distinct()
    used = rows.select(*KEY, "pos", F.explode(F.concat(F.filter(F.array("tag"), lambda n: F.contains(n, F.lit(":"))), F.filter("names", lambda n: ~F.startswith(n, F.lit("xmlns:"))))).alias("n"))
    used = used.select(*KEY, F.substring_index("n", ":", 1).alias("prefix"), "pos", F.substring_index("n", ":", -1).alias("local")).where("prefix not in ('xml', 'xmlns')")
    steps = F.inline(F.array(F.struct(F.col("pos").alias("pos"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.col("close").alias("pos"), F.lit(2).alias("kind"), F.lit(-1).alias("step"))))
    marks = declared.select(*KEY, "prefix", steps).withColumn("local", F.lit(None).cast("string"))
    uses = used.select(*KEY, "prefix", "pos", F.lit(1).alias("kind"), F.lit(0).alias("step"), "local")
    w = Window.partitionBy(*KEY, "prefix").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(uses).withColumn("open", F.sum("step").over(w)).where("kind = 1 and open = 0").select(*KEY, "pos", "prefix", "local")
