"""The document view and what it is made of; predicates over revisions; tagged text; gates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X

# Elements that hold revisions, and those that are leaves of a comparison.
WRAPPERS = ("ins", "del", "moveFrom", "moveTo")
PROPERTY_CHANGES = ("rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange")
LEAVES = (
    "t", "br", "cr", "tab", "sym", "softHyphen", "noBreakHyphen", "fldChar", "instrText", "delText", "dayShort", "dayLong", "monthShort", "monthLong", "yearShort", "yearLong", "annotationRef", "footnoteRef",
    "endnoteRef", "footnoteReference", "endnoteReference", "separator", "continuationSeparator", "pgNum", "drawing", "pict", "object", "AlternateContent",
)


def document_view(paragraphs: DataFrame, style_of: Column | None = None, rules: tuple = X.LABEL_RULES) -> DataFrame:
    """One wide row a paragraph: id, label, header, text without both, style, table context.

    Empty paragraphs are left out unless they stand in a table. ``paragraphs``: doc_id,
    para_idx, text, and table_idx, row_idx, cell_idx (null outside tables). ``rules`` tell
    labels; of plain text, X.WHOLE_NUMBER_RULES take no address for one.
    """
    from .groups import identities

    rows = identities(paragraphs)
    inside = F.col("table_idx").isNotNull()
    rows = rows.where((F.regexp_replace("text", X.WS + "+", "") != "") | inside)
    bare = X.without_label(F.col("text"), rules)
    head = X.header(bare)
    rows = rows.withColumn("list_label", X.label(F.col("text"), rules)).withColumn("label_type", X.label_type(F.col("text"), rules)).withColumn("__bare", bare).withColumn("__head", head)
    header = F.col("__head.text")
    level = F.when(F.col("list_label").isNull(), -1).when(F.col("label_type").isin("SECTION", "ARTICLE", "NUMBERED_HEADING"), 0).otherwise(1)
    out = rows.withColumn("header", header).withColumn("header_style", F.col("__head.style")).withColumn("list_level", level)
    out = out.withColumn("clean_text", F.when(F.col("header_style") == "title_bare", F.col("__bare")).otherwise(X.without_header(F.col("__bare"), F.col("header"))))
    context = F.when(inside, F.struct("table_idx", "row_idx", "cell_idx"))
    return out.select("doc_id", "para_idx", "para_id", "list_label", "label_type", "list_level", "header", "header_style", "clean_text", (style_of if style_of is not None else F.lit("body")).alias("style"), context.alias("table_context"))


def annotated_runs(runs: DataFrame, rels: DataFrame) -> DataFrame:
    """Fragments of one run as one, with its characters and the target of its link, if any."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frag_idx", "text"))), lambda x: x["text"]), "")
    one = runs.groupBy("doc_id", "para_idx", "run_idx").agg(text.alias("text"), F.any_value("rid").alias("rid"))
    return one.withColumn("chars", F.length("text")).join(rels, ["doc_id", "rid"], "left")


def has_revisions(tags: Column) -> Column:
    """Whether any of an array of tags wraps or records a revision."""
    return F.arrays_overlap(tags, F.array(*map(F.lit, WRAPPERS + PROPERTY_CHANGES)))


def _entirely(tags: Column, mark: Column | None, sign: str, inside: tuple[str, ...], outside: tuple[str, ...]) -> Column:
    """Whether the mark of the paragraph itself says so, or there is content inside and none outside; other tags do not count."""
    own = F.arrays_overlap(tags, F.array(*map(F.lit, inside))) & ~F.arrays_overlap(tags, F.array(*map(F.lit, outside)))
    return own if mark is None else F.coalesce(F.array_contains(mark, sign), F.lit(False)) | own


def entirely_inserted(tags: Column, mark: Column | None = None) -> Column:
    """``tags``: what stands in the paragraph; ``mark``: what stands in the run properties of its paragraph mark."""
    return _entirely(tags, mark, "ins", ("ins", "moveTo"), ("r", "del", "moveFrom"))


def entirely_deleted(tags: Column, mark: Column | None = None) -> Column:
    return _entirely(tags, mark, "del", ("del", "moveFrom"), ("r", "ins", "moveTo"))


def is_leaf(tag: Column) -> Column:
    return tag.isin(*LEAVES)


def is_empty_paragraph(tags: Column) -> Column:
    return F.forall(tags, lambda t: t == "pPr")


def leaf_text(tag: Column, text: Column) -> Column:
    return F.when(tag.isin("t", "delText"), text).when(tag.isin("br", "cr"), "\n").when(tag == "tab", "\t").otherwise("")


def element_hash(tag: Column, attributes: Column, text: Column) -> Column:
    """A hash of a tag, its attributes by name (white-space handling aside) and its text."""
    kept = F.map_filter(attributes, lambda k, v: k != "xml:space")
    pairs = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.sha1(F.concat_ws("|", tag, F.array_join(pairs, ","), text))


def paragraph_groups(atoms: DataFrame, most: int = 50) -> DataFrame:
    """Atoms of each paragraph as a group with its text and hashes; one of over ``most`` atoms is split at line breaks."""
    w = Window.partitionBy("doc_id", "para_idx")
    rows = atoms.withColumn("__n", F.count("*").over(w))
    lag = F.coalesce(F.lag("text").over(w.orderBy("atom_idx")) == "\n", F.lit(False)).cast("int")
    rows = rows.withColumn("__after", lag)
    part = F.when(F.col("__n") > most, F.sum("__after").over(w.orderBy("atom_idx").rowsBetween(Window.unboundedPreceding, 0))).otherwise(0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("atom_idx", "text"))), lambda x: x["text"]), "")
    out = rows.withColumn("part", part).groupBy("doc_id", "para_idx", "part").agg(text.alias("text"), F.count("*").alias("atoms"))
    return out.withColumn("hash", F.sha1("text")).withColumn("normalised_hash", X.paragraph_hash(F.col("text")))


# Tagged text.


_FLAGS = ("bold", "italic", "underline", "highlight")


def tagged(runs: DataFrame, group: list[str], order: str) -> DataFrame:
    """Runs as one text a group with inline tags; neighbours that look alike share theirs.

    Besides text, runs may have bold, italic, underline, highlight, color, size, font and
    href; ``is_header`` runs get no tags. base_bold, base_italic and base_underline are
    what is usual in the group: where one is given, only runs that differ from it, by
    having what it lacks, are tagged. Tags open as a, font, b, i, u, highlight and close
    the other way round.
    """
    from .ordered import islands

    have = set(runs.columns)
    plain = F.coalesce(F.col("is_header"), F.lit(False)) if "is_header" in have else F.lit(False)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    text = lambda c: F.when(~plain, F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    shown = {c: ~plain & flag(c) & (~F.coalesce(F.col(f"base_{c}"), F.lit(False)) if f"base_{c}" in have else F.lit(True)) for c in _FLAGS}
    attributes = F.concat_ws(" ", *[F.concat(F.lit(f'{name}="'), text(c), F.lit('"')) for name, c in (("color", "color"), ("size", "size"), ("face", "font"))])
    wraps = [(F.concat(F.lit('<a href="'), X.escaped_attribute(text("href")), F.lit('">')), "</a>"), (F.when(attributes != "", F.concat(F.lit("<font "), attributes, F.lit(">"))), "</font>")]
    wraps += [(F.when(shown[c], F.lit(f"<{tag}>")), f"</{tag}>") for c, tag in zip(_FLAGS, ("b", "i", "u", "highlight"))]
    opened = F.concat_ws("", *[o for o, _ in wraps])
    closed = F.concat_ws("", *[F.when(o.isNotNull(), F.lit(c)) for o, c in reversed(wraps)])
    rows = islands(runs.where("text <> ''").withColumns({"__open": opened, "__close": closed}), group, order, ["__open"])
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("t")))), lambda x: x["t"]), "")
    one = rows.groupBy(*group, "island", "__open", "__close").agg(F.min(order).alias(order), joined("text").alias("text"))
    return one.withColumn("__piece", F.concat("__open", "text", "__close")).groupBy(*group).agg(joined("__piece").alias("tagged"))


#: Tags of replacement texts, by the kind that they switch on.
_KINDS = {"b": "bold", "i": "italic", "u": "underline", "highlight": "highlight", "highlighting": "highlight", "header": "header", "RunInHeader": "header", "font": "font"}
_TOKEN = re.compile(r"""<(/?)(b|i|u|highlighting|highlight|header|RunInHeader|font)((?: (?:[^>"']|"[^"]*"|'[^']*')*)?)>|([^<]+|<)""")
_ATTRIBUTE = re.compile(r"""(\w+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_LOOK = ("bold", "italic", "underline", "highlight", "header")
_FONT = ("color", "half_points", "font")
SEGMENTS = T.StructType(
    [T.StructField("segments", T.ArrayType(T.StructType([T.StructField(n, T.BooleanType()) for n in _LOOK] + [T.StructField("color", T.StringType()), T.StructField("half_points", T.IntegerType()), T.StructField("font", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("error", T.StringType())]
)


def _font(attributes: str, above: tuple) -> tuple:
    """(color, half-points, font) inside a font tag: what it names, else what holds around it."""
    named = {k: a or b for k, a, b in _ATTRIBUTE.findall(attributes)}
    try:
        size = round(2 * float(named["size"])) if "size" in named else above[1]
    except ValueError:
        size = above[1]
    return named.get("color", above[0]), size, named.get("face", above[2])


def segments_of(text: str) -> tuple[list[tuple], str | None]:
    """Segments (the flags of _LOOK, those of _FONT, text) of tagged text; an unbalanced kind of tag is an error.

    Signs that open no known tag are text. Segments that look alike are one.
    """
    depth, fonts, out = dict.fromkeys((*_LOOK, "font"), 0), [(None, None, None)], []
    for close, tag, attributes, plain in _TOKEN.findall(text):
        if tag:
            kind = _KINDS[tag]
            depth[kind] += -1 if close else 1
            if depth[kind] < 0:
                return [], f"unbalanced {kind} tags"
            if kind == "font":
                fonts = fonts[:-1] if close else [*fonts, _font(attributes, fonts[-1])]
            continue
        now = (*(depth[k] > 0 for k in _LOOK), *fonts[-1])
        if out and out[-1][:-1] == now:
            out[-1] = (*now, out[-1][-1] + plain)
        else:
            out.append((*now, plain))
    open_ = next((k for k, v in depth.items() if v), None)
    return ([], f"unbalanced {open_} tags") if open_ else (out, None)


@F.pandas_udf(SEGMENTS)
def parse_tagged(text: pd.Series) -> pd.DataFrame:
    """Tagged text as styled segments, or the error that keeps it from being parsed."""
    found = [segments_of(t or "") for t in text]
    names = (*_LOOK, *_FONT, "text")
    return pd.DataFrame({"segments": [[dict(zip(names, s)) for s in x[0]] for x in found], "error": [x[1] for x in found]})


# Set differences and gates.


def set_delta(before: Column, after: Column) -> Column:
    """struct(missing, unexpected, same) of two arrays, sorted."""
    missing, unexpected = F.array_sort(F.array_except(before, after)), F.array_sort(F.array_except(after, before))
    return F.struct(missing.alias("missing"), unexpected.alias("unexpected"), (F.array_sort(before) == F.array_sort(after)).alias("same"))


def text_gate(pairs: DataFrame) -> DataFrame:
    """(pair_id, passed, reason): texts (accepted, revised, rejected, original) must agree once made alike, and so
    must their counts of non-empty paragraphs."""
    lines = lambda c: F.size(F.filter(F.split(F.col(c), "\n"), lambda t: F.trim(t) != ""))
    same = lambda a, b: X.round_trip_text(F.col(a)) == X.round_trip_text(F.col(b))
    why = F.when(~same("accepted", "revised"), "accepted text differs").when(~same("rejected", "original"), "rejected text differs").when(lines("accepted") != lines("revised"), "paragraph counts differ")
    return pairs.select("pair_id", why.isNull().alias("passed"), why.alias("reason"))


def formatting_gate(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, para_idx, style) whose formatting is not that of the other side."""
    other = right.select("doc_id", "para_idx", F.col("style").alias("other_style"))
    return left.join(other, ["doc_id", "para_idx"], "full_outer").where(~F.col("style").eqNullSafe(F.col("other_style")))


def undeclared_prefixes(text: Column) -> Column:
    """Prefixes that a markup text uses and does not declare, sorted."""
    used = F.array_distinct(F.regexp_extract_all(text, F.lit(r"<([A-Za-z][A-Za-z0-9]*):"), 1))
    declared = F.regexp_extract_all(text, F.lit(r"xmlns:([A-Za-z][A-Za-z0-9]*)="), 1)
    return F.array_sort(F.array_except(used, declared))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two runs of a query gave the same rows: counts and an order-free hash of each."""
    total = lambda df, n: df.agg(F.count("*").alias(f"n_{n}"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias(f"h_{n}"))
    both = total(a, "a").withColumn("k", F.lit(1)).join(total(b, "b").withColumn("k", F.lit(1)), "k")
    return both.select(F.col("n_a").alias("rows"), ((F.col("n_a") == F.col("n_b")) & (F.col("h_a") == F.col("h_b"))).alias("same"))


def latest(sessions: DataFrame, group: list[str]) -> DataFrame:
    """The session of each group that was used last; the greater id wins a tie."""
    return sessions.groupBy(*group).agg(F.max_by("session_id", F.struct("last_used", "session_id")).alias("session_id"))


def longest_run(runs: DataFrame, group: list[str], order: str) -> DataFrame:
    """The order of the longest run of each group; the first wins a tie."""
    return runs.groupBy(*group).agg(F.max_by(order, F.struct(F.length("text"), -F.col(order))).alias(order))


def utc_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd-HHmmss'Z'")
