"""Text functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as one class.
WS = r"[\s\p{Z}\x{FEFF}]"

# Quotation marks that count as the straight ones.
DOUBLE_QUOTES = '"“”«»‹›'
SINGLE_QUOTES = "'‘’"

# The longest short heading, and the longest heading phrase of a longer text.
SHORT_HEADER = 50
LONG_HEADER = 60

# Label rules in the order in which they are tried.
LABEL_RULES = (
    ("SECTION", r"^(?i:Section)\s+[\d.]+(?:\((?i:[a-z])\))?"),
    ("ARTICLE", r"^(?i:Article)\s+(?i:[\dIVXLCDM.])+"),
    ("NUMBERED_HEADING", r"^\d+(?:\.\d+)*[.)]\s*"),
    ("NUMBER", r"^\(\d+\)\s*"),
    ("ROMAN", r"^\((?i:[ivxlcdm]){2,}\)\s*"),
    ("LETTER", r"^\((?i:[a-z])+\)\s*"),
)

#: The same rules where a number that goes on behind its last stop, such as an address of four numbers, is no heading.
WHOLE_NUMBER_RULES = tuple((k, r.replace("[.)]", r"[.)](?!\d)") if k == "NUMBERED_HEADING" else r) for k, r in LABEL_RULES)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def normalised(text: Column) -> Column:
    """Lower case, squeezed; null is empty. The key by which paragraphs count as equal."""
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def paragraph_hash(text: Column) -> Column:
    return F.sha1(normalised(text))


def short_id(seed: Column, prefix: str = "_bk_") -> Column:
    """A stable 12-digit id of a seed."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(seed), 1, 12))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def word_and_space_tokens(text: Column) -> Column:
    """Words and the white space between them, both kept, in order."""
    return F.regexp_extract_all(text, F.lit(rf"({WS}+|[^\s\p{{Z}}\x{{FEFF}}]+)"), 1)


def jaccard(left: Column, right: Column, ignore_case: bool = True) -> Column:
    """Shared over all distinct words; two empty texts are alike, one empty text is like none."""
    a, b = (F.array_distinct(words(F.lower(x) if ignore_case else x)) for x in (left, right))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def group_similarity(left: Column, right: Column) -> Column:
    """Word similarity of paragraphs: two blank ones are alike, a blank and a filled one are not."""
    a, b = normalised(left), normalised(right)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(jaccard(a, b))


def token_estimate(length: Column) -> Column:
    return F.ceil(length / F.lit(4))


def preview(text: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(suffix))).otherwise(text)


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters both start with; a binary search, so it is logarithmic in comparisons."""
    low = F.least(F.length(a), F.length(b))
    step = F.struct(F.lit(0).alias("lo"), low.alias("hi"))
    bits = F.sequence(F.lit(1), F.lit(32))

    def halve(s: Column, _: Column) -> Column:
        mid = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
        same = F.left(a, mid) == F.left(b, mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(F.greatest(mid - 1, s["lo"])).alias("hi"))

    return F.aggregate(bits, step, halve, lambda s: s["lo"])


def common_suffix(a: Column, b: Column, prefix: Column) -> Column:
    """How many characters both end with, beyond the common prefix."""
    tail = lambda x: F.reverse(F.substring(x, prefix + 1, F.length(x)))
    return common_prefix(tail(a), tail(b))


# Labels and headers.


def label_type(text: Column, rules: tuple = LABEL_RULES) -> Column:
    return reduce(lambda c, r: c.when(F.regexp_like(text, F.lit(r[1])), r[0]), rules[1:], F.when(F.regexp_like(text, F.lit(rules[0][1])), rules[0][0]))


def label_match(text: Column, rules: tuple = LABEL_RULES) -> Column:
    """What the first rule that holds matches, with the white space after it; empty without a label."""
    first, *more = rules
    hit = F.when(F.regexp_like(text, F.lit(first[1])), F.regexp_extract(text, first[1], 0))
    for _, pattern in more:
        hit = hit.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 0))
    return F.coalesce(hit, F.lit(""))


def label(text: Column, rules: tuple = LABEL_RULES) -> Column:
    return F.nullif(F.regexp_replace(label_match(text, rules), rf"{WS}+$", ""), F.lit(""))


def without_label(text: Column, rules: tuple = LABEL_RULES) -> Column:
    n = F.length(label_match(text, rules))
    return F.when(n > 0, F.regexp_replace(F.substring(text, n + 1, F.length(text)), rf"^{WS}+", "")).otherwise(text)


# Fixed value: the phrase at the start of a long text that may be its heading.
HEADER = r"^([A-Z][^.!?:]*(?:\s+[A-Z][^.!?:]*)*)([.:]?)(?:\s|$)"


# The styles of a heading, title_with_period, title_with_colon and title_bare.


def header(text: Column) -> Column:
    """struct(text, style) of a heading at the start of a text; null without one.

    A short text is a heading when it ends with a period or a colon or has at most five
    words. Of a longer text it is the phrase before the first stop, of at most 60
    characters, if something follows it.
    """
    bare = F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")
    last = F.right(bare, F.lit(1))
    cut = F.left(bare, F.length(bare) - 1)
    made = lambda t, s: F.struct(t.alias("text"), s.alias("style"))
    short = F.when(last == ".", made(cut, F.lit("title_with_period"))).when(last == ":", made(cut, F.lit("title_with_colon"))).when(word_count(bare) <= 5, made(bare, F.lit("title_bare")))
    all_, phrase, stop = (F.regexp_extract(bare, HEADER, i) for i in range(3))
    phrase = F.regexp_replace(phrase, rf"{WS}+$", "")
    style = F.when(stop == ".", "title_with_period").when(stop == ":", "title_with_colon").otherwise("title_bare")
    long_ = F.when((all_ != "") & (F.length(bare) > F.length(all_)) & (F.length(phrase) <= LONG_HEADER), made(phrase, style))
    starts = F.regexp_like(text, F.lit("^[A-Z]")) & (F.length(text) >= 2)
    return F.when(starts & (F.length(bare) <= SHORT_HEADER), short).when(starts, long_)


def without_header(text: Column, head: Column) -> Column:
    """The text after its header and one mark of punctuation."""
    key = F.lower(F.trim(head))
    out = None
    for mark in (":", ".", "-", ";", ""):
        full = F.concat(key, F.lit(mark))
        rest = F.regexp_replace(F.substring(text, F.length(full) + 1, F.length(text)), rf"^{WS}+", "")
        hit = F.startswith(F.lower(text), full)
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    return F.when(F.coalesce(head, F.lit("")) == "", text).otherwise(out.otherwise(text))


# Inline tags. The tags of each kind.

TAG_PATTERNS = {
    "formatting": r"</?[biu]>",
    "hyperlink": r'<a\s+href="[^"]*">|</a>',
    "highlight": r"</?highlight(?:ing)?>",
    "font": r"<font\b[^>]*>|</font>",
    "inline": r'</?(?:b|i|u|highlight|highlighting|a|font|header|RunInHeader|definition)(?:\s[^>]*)?>|<a\s+href="[^"]*">',
}


def without_tags(text: Column, kind: str = "inline") -> Column:
    return F.regexp_replace(text, TAG_PATTERNS[kind], "")


def has_tags(text: Column, kind: str) -> Column:
    """Whether tags of a kind occur; a fresh search for every row."""
    return F.regexp_like(text, F.lit(TAG_PATTERNS[kind]))


def merged_tags(text: Column) -> Column:
    """Adjacent equal tags joined until none is left: ``</b><b>`` and the like, and fonts with the same attributes.

    Tags that touch vanish from the inside out, so as many rounds do as the longest run
    of closing tags has.
    """
    pair, font = r"</(b|i|u|highlight)><\1>", r"(<font [^>]*>)([^<]*)</font>\1"
    runs = F.regexp_extract_all(text, F.lit(r"((?:</(?:b|i|u|highlight|font)>)+)<"), 1)
    rounds = F.coalesce(F.array_max(F.transform(runs, lambda r: F.regexp_count(r, F.lit("</")))), F.lit(0))
    step = lambda t, _: F.regexp_replace(F.regexp_replace(t, pair, ""), font, "$1$2")
    return F.when(rounds == 0, text).otherwise(F.aggregate(F.sequence(F.lit(0), rounds), text, step))


def escaped_xml(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), text)


def escaped_attribute(text: Column) -> Column:
    return F.replace(escaped_xml(text), F.lit('"'), F.lit("&quot;"))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, DOUBLE_QUOTES[1:] + SINGLE_QUOTES[1:], '"' * (len(DOUBLE_QUOTES) - 1) + "'" * (len(SINGLE_QUOTES) - 1))


def without_quotes(text: Column) -> Column:
    return F.translate(text, DOUBLE_QUOTES + SINGLE_QUOTES, "")


def in_quote_style(style_of: Column, text: Column) -> Column:
    """Straight quotes of ``text`` as the curly ones that ``style_of`` uses, by what stands before them."""
    has = lambda q: F.contains(style_of, F.lit(q))
    for plain, left, right in (('"', "“", "”"), ("'", "‘", "’")):
        opening = F.when(has(left), left).when(has(right), right).otherwise(plain)
        closing = F.when(has(right), right).when(has(left), left).otherwise(plain)
        marked = F.regexp_replace(text, rf"(^|[\s(\[{{]){plain}", "$1\x01")
        text = F.replace(F.replace(marked, F.lit(plain), closing), F.lit("\x01"), opening)
    return text


# Predicates.


def is_punctuation(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^[\p{P}\p{S}]+$"))


def is_blank(text: Column) -> Column:
    return F.regexp_like(text, F.lit(rf"^{WS}*$"))


def leaks_placeholder(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\{[A-Za-z_][A-Za-z0-9_]*\}"))


def has_field_placeholder(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\[[^\]]*\]|«[^»]*»"))


# Whole-text comparison.


def round_trip_text(text: Column) -> Column:
    """Line ends, tabs, blanks around line ends and blank lines made alike."""
    for pattern, to in (("\r\n?", "\n"), ("\t", " "), (" +", " "), (" *\n *", "\n"), ("\n{2,}", "\n")):
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def compared(a: Column, b: Column, around: int = 50) -> Column:
    """struct(identical, normalised_identical, first_difference, context_a, context_b); offsets from 0."""
    x, y = round_trip_text(a), round_trip_text(b)
    at = common_prefix(x, y)
    near = lambda t: F.substring(t, F.greatest(at - around, F.lit(0)) + 1, F.lit(2 * around))
    differs = x != y
    return F.struct((a == b).alias("identical"), (~differs).alias("normalised_identical"), F.when(differs, at).alias("first_difference"), F.when(differs, near(x)).alias("context_a"), F.when(differs, near(y)).alias("context_b"))
