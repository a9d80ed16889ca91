"""Search: regular expressions over paragraphs, and unique matches in stages."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X


def pattern_of(patterns: Sequence[str], whole_word: bool = False, case_sensitive: bool = False) -> str:
    """All patterns as one; raises re.error for one that cannot be compiled."""
    joined = "|".join(patterns)
    re.compile(joined)
    return ("" if case_sensitive else "(?i)") + (rf"\b({joined})\b" if whole_word else f"({joined})")


def grep(paragraphs: DataFrame, patterns: Sequence[str], whole_word: bool = False, case_sensitive: bool = False, context: int = 50, max_results: int | None = 100, rules: tuple = X.LABEL_RULES) -> tuple[DataFrame, DataFrame]:
    """(matches, totals) of a search over (doc_id, para_idx, text).

    One row a paragraph: how often it matches, its first match with the text around it,
    its label and header. The best ``max_results`` rows of each document are kept, while
    totals count everything. A pattern that is no pattern gives no matches and tells
    its error in the totals. ``rules`` tell labels, as in ``views.document_view``.
    """
    try:
        pattern = pattern_of(patterns, whole_word, case_sensitive)
    except re.error as error:
        none = paragraphs.limit(0).select("doc_id", "para_idx", F.lit(0).alias("match_count"), F.lit("").alias("match_text"), F.lit("").alias("context"), F.lit("").alias("list_label"), F.lit("").alias("header"))
        totals = paragraphs.sparkSession.createDataFrame([(0, 0, f"Invalid regex pattern: {error}")], "total_matches long, paragraphs_with_matches long, error string")
        return none, totals
    p = F.lit(pattern)
    hits = paragraphs.where(F.regexp_like("text", p)).select("doc_id", "para_idx", "text", F.regexp_count("text", p).alias("match_count"), F.regexp_extract("text", pattern, 0).alias("match_text"), F.regexp_instr("text", p).alias("at"))
    before = F.substring("text", F.greatest(F.col("at") - context, F.lit(1)), F.least(F.lit(context), F.col("at") - 1))
    after = F.substring("text", F.col("at") + F.length("match_text"), F.lit(context))
    rows = hits.select("doc_id", "para_idx", "match_count", "match_text", F.concat(F.lit("..."), before, F.lit(">>>"), "match_text", F.lit("<<<"), after, F.lit("...")).alias("context"), F.coalesce(X.label(F.col("text"), rules), F.lit("")).alias("list_label"), F.coalesce(X.header(F.col("text"))["text"], F.lit("")).alias("header"))
    totals = rows.agg(F.coalesce(F.sum("match_count"), F.lit(0)).alias("total_matches"), F.count("*").alias("paragraphs_with_matches"), F.lit(None).cast("string").alias("error"))
    if max_results is not None:
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx"))
        rows = rows.withColumn("__n", rank).where(F.col("__n") <= max_results).drop("__n")
    return rows, totals


def grep_each(paragraphs: DataFrame, patterns: Sequence[str], whole_word: bool = False, case_sensitive: bool = False) -> DataFrame:
    """A row for every match: doc_id, para_idx, match_idx, match_text."""
    found = F.regexp_extract_all("text", F.lit(pattern_of(patterns, whole_word, case_sensitive)), 0)
    return paragraphs.select("doc_id", "para_idx", F.posexplode(found).alias("match_idx", "match_text"))


# The tags that matching looks through, and the names of its stages in order.
MATCH_TAGS = r'</?[biu]>|<a\s+href="[^"]*">|</a>|</?highlight(?:ing)?>'
STAGES = ("exact", "clean", "quote_normalized", "flexible_whitespace", "quote_optional")


def stage_texts(text: Column) -> list[Column]:
    """A text as each stage sees it: as it is, without tags, with straight quotes, with single spaces, without quotes."""
    clean = F.regexp_replace(text, MATCH_TAGS, "")
    quotes = X.straight_quotes(clean)
    spaces = F.regexp_replace(quotes, X.WS + "+", " ")
    return [text, clean, quotes, spaces, X.without_quotes(spaces)]


def overlap_count(text: Column, needle: Column) -> Column:
    """How often ``needle`` starts in ``text``; hits may overlap; 0 for an empty needle."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.when(needle == "", 0).otherwise(F.regexp_count(text, quoted))


def match_positions(text: Column, needle: Column) -> Column:
    """All starts of ``needle``, from 0; hits may overlap."""
    last = F.length(text) - F.length(needle)
    places = F.when((needle != "") & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(text, i + 1, F.length(needle)) == needle)


def unique_match(text: Column, needle: Column) -> Column:
    """struct(status, mode, n): the first stage with a hit decides; more than one hit is ``multiple``."""
    out = None
    for mode, t, n in zip(STAGES, stage_texts(text), stage_texts(needle)):
        found = (n != "") & F.contains(t, n)
        hits = overlap_count(t, n)
        made = F.struct(F.when(hits == 1, "unique").otherwise("multiple").alias("status"), F.lit(mode).alias("mode"), hits.cast("int").alias("n"))
        out = F.when(found, made) if out is None else out.when(found, made)
    none = F.struct(F.lit("not_found").alias("status"), F.lit(None).cast("string").alias("mode"), F.lit(0).alias("n"))
    return out.otherwise(none)


#: Whole words within an item by which documents are looked up.
ANCHOR_WORDS = 4
#: First letters by which an item of one or two words is looked up.
ANCHOR_LETTERS = 3


def match_candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, head) of every pair of ``docs`` (doc_id, text) and ``items`` (item_id, needle) that a stage may match.

    A hit holds all words of the item but the first and the last as whole words, so four
    of these join; both texts are cut into words as they are and as the last stage sees
    them, which all stages but the first lead to. Of an item of three to five words in
    either form, the inner words are one key; one of fewer words is found by its first
    letters, in documents cut into runs of as many, only where there is such an item.
    Pairs that share the item's first four words are returned too, and ``head`` tells them.
    """
    forms = lambda c: F.array(F.col(c), stage_texts(F.col(c))[-1])
    said = lambda c: F.transform(forms(c), X.words)
    key = lambda w, i: F.xxhash64(F.slice(w, i, ANCHOR_WORDS))
    known = items.where("needle <> ''").select("item_id", forms("needle").alias("forms"), said("needle").alias("ws"))
    known = known.withColumn("least", F.array_min(F.transform("ws", F.size)))
    inner = known.where(F.col("least") >= ANCHOR_WORDS + 2).select("item_id", F.lit(False).alias("head"), F.explode(F.transform("ws", lambda w: key(w, 2))).alias("anchor"))
    heads = known.where(F.size(F.col("ws")[0]) >= ANCHOR_WORDS).select("item_id", F.lit(True).alias("head"), key(F.col("ws")[0], 1).alias("anchor"))
    anchors = inner.unionByName(heads).distinct()
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - ANCHOR_WORDS + 1), lambda i: key(w, i))
    cut = docs.select("doc_id", F.explode(F.array_distinct(said("text"))).alias("w")).where(F.size("w") >= ANCHOR_WORDS)
    long = cut.select("doc_id", F.explode(grams(F.col("w"))).alias("anchor")).join(anchors, "anchor").select("doc_id", "item_id", "head")
    pairs = long
    short = known.where((F.col("least") < ANCHOR_WORDS + 2) & (F.col("least") > 2))
    if not short.isEmpty():
        inside = lambda w: F.xxhash64(F.slice(w, 2, F.size(w) - 2), F.size(w) - 2)
        named = short.select("item_id", F.explode(F.transform(F.filter("ws", lambda w: F.size(w) < ANCHOR_WORDS + 2), inside)).alias("anchor")).distinct()
        named = named.unionByName(short.select("item_id", F.explode(F.transform(F.filter("ws", lambda w: F.size(w) >= ANCHOR_WORDS + 2), lambda w: key(w, 2))).alias("anchor")))
        runs = lambda w, k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k), F.lit(k)))
        every = [F.when(F.size("w") >= k, runs(F.col("w"), k)).otherwise(F.array().cast("array<bigint>")) for k in range(1, ANCHOR_WORDS)]
        words = docs.select("doc_id", F.explode(F.array_distinct(said("text"))).alias("w"))
        small = words.select("doc_id", F.explode(F.array_distinct(F.concat(*every))).alias("anchor")).unionByName(cut.select("doc_id", F.explode(grams(F.col("w"))).alias("anchor")))
        pairs = pairs.unionByName(small.join(named, "anchor").select("doc_id", "item_id", F.lit(False).alias("head")))
    tiny = known.where("least <= 2")
    if not tiny.isEmpty():
        letters = F.explode(F.array_distinct(F.transform(F.filter("forms", lambda t: t != ""), lambda t: F.left(t, F.lit(ANCHOR_LETTERS)))))
        named = tiny.select("item_id", letters.alias("start"), "forms")
        own = docs.select("doc_id", F.explode(F.array_distinct(forms("text"))).alias("t")).where("t <> ''")
        starts = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, ANCHOR_LETTERS))
        cuts = F.array_distinct(F.flatten(F.transform(starts(F.col("t")), lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda n: F.left(s, n)))))
        pairs = pairs.unionByName(own.select("doc_id", F.explode(cuts).alias("start")).distinct().join(named.select("item_id", "start"), "start").select("doc_id", "item_id", F.lit(False).alias("head")))
    return pairs.groupBy("doc_id", "item_id").agg(F.bool_or("head").alias("head"))


_TAGS = re.compile(MATCH_TAGS)


def _mapped(text: str, stage: int) -> tuple[str, list[int], list[int]]:
    """A text as a stage sees it, and where each of its characters comes from."""
    chars = [(c, i, i + 1) for i, c in enumerate(text)]
    if stage >= 1:
        gone = {i for m in _TAGS.finditer(text) for i in range(*m.span())}
        chars = [x for x in chars if x[1] not in gone]
    if stage >= 2:
        chars = [('"' if c in X.DOUBLE_QUOTES else "'" if c in X.SINGLE_QUOTES else c, a, b) for c, a, b in chars]
    if stage >= 3:
        joined: list[tuple[str, int, int]] = []
        for c, a, b in chars:
            if not c.isspace():
                joined.append((c, a, b))
            elif joined and joined[-1][0] == " ":
                joined[-1] = (" ", joined[-1][1], b)
            else:
                joined.append((" ", a, b))
        chars = joined
    if stage >= 4:
        chars = [x for x in chars if x[0] not in "\"'"]
    return "".join(x[0] for x in chars), [x[1] for x in chars], [x[2] for x in chars]


_STRAIGHT = str.maketrans({**dict.fromkeys(X.DOUBLE_QUOTES, '"'), **dict.fromkeys(X.SINGLE_QUOTES, "'")})
_NO_QUOTES = str.maketrans("", "", "\"'")


def _staged(text: str) -> list[str]:
    """The text as each stage sees it; what ``_mapped`` gives, without the places."""
    clean = _TAGS.sub("", text)
    straight = clean.translate(_STRAIGHT)
    spaces = re.sub(r"\s+", " ", straight)
    return [text, clean, straight, spaces, spaces.translate(_NO_QUOTES)]


def match_span(text: str | None, needle: str | None) -> tuple[int, int] | None:
    """Where a unique match stands in the source text, from 0, end exclusive; else null.

    Only the stage that finds the needle maps its place back, character by character.
    """
    if not text or not needle:
        return None
    for stage, (t, n) in enumerate(zip(_staged(text), _staged(needle))):
        at = t.find(n) if n else -1
        if at >= 0:
            if t.find(n, at + 1) >= 0:
                return None
            if not stage:
                return at, at + len(n)
            _, starts, ends = _mapped(text, stage)
            return starts[at], ends[at + len(n) - 1]
    return None


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
def unique_span(text: pd.Series, needle: pd.Series) -> pd.DataFrame:
    """The span of a unique match in the source text, mapped back through the stages."""
    found = [match_span(t, n) or (None, None) for t, n in zip(text, needle)]
    return pd.DataFrame({"start": pd.array([x[0] for x in found], "Int32"), "stop": pd.array([x[1] for x in found], "Int32")})


