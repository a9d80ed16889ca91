"""Formatting values: units, toggles, fingerprints, property sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run properties and their plain names.
PROPERTY_NAMES = {
    "w:b": "bold", "w:bCs": "boldComplex", "w:i": "italic", "w:iCs": "italicComplex", "w:u": "underline",
    "w:strike": "strikethrough", "w:dstrike": "doubleStrikethrough", "w:sz": "fontSize", "w:szCs": "fontSizeComplex",
    "w:rFonts": "font", "w:color": "color", "w:highlight": "highlight", "w:shd": "shading", "w:vertAlign": "verticalAlign",
    "w:caps": "allCaps", "w:smallCaps": "smallCaps", "w:vanish": "hidden", "w:emboss": "emboss", "w:imprint": "imprint",
    "w:outline": "outline", "w:shadow": "shadow", "w:spacing": "spacing", "w:w": "width", "w:kern": "kerning", "w:position": "position",
}


def points(twips: Column) -> Column:
    return (twips / 20).cast("decimal(10,1)")


def first_line_indent(first_line: Column, hanging: Column) -> Column:
    """In points; a hanging indent counts as negative."""
    return F.coalesce(points(-hanging), points(first_line), F.lit(0).cast("decimal(10,1)"))


def alignment(value: Column) -> Column:
    return F.when(value == "both", "JUSTIFY").when(value.isin("center", "right", "left"), F.upper(value)).otherwise("LEFT")


def toggle(present: Column, value: Column) -> Column:
    """Absent: null; 0, false, off or none: false; else true."""
    return F.when(~present, None).otherwise(~F.coalesce(F.lower(value).isin("0", "false", "off", "none"), F.lit(False)))


def unless(value: Column, unset: str) -> Column:
    """The value, or null where it is the word that stands for none (highlight: none, colour: auto)."""
    return F.nullif(value, F.lit(unset))


def style_token(style: Column, level: Column, align: Column, left: Column, first: Column) -> Column:
    """The compact name of a formatting fingerprint, such as ``Normal:L-1:LEFT:I0:H0``."""
    whole = lambda c: F.floor(c + F.lit(0.5)).cast("string")
    return F.concat_ws(":", F.coalesce(style, F.lit("body")), F.concat(F.lit("L"), level), align, F.concat(F.lit("I"), whole(left)), F.concat(F.lit("H"), whole(first)))


def property_diff(old: Column, new: Column) -> Column:
    """struct(added, removed, changed): sorted names of what differs between two property maps."""
    a, b = F.map_keys(old), F.map_keys(new)
    changed = F.filter(F.array_intersect(a, b), lambda k: ~F.element_at(old, k).eqNullSafe(F.element_at(new, k)))
    return F.struct(F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"), F.array_sort(changed).alias("changed"))


def changed_properties(old: Column, new: Column) -> Column:
    """Sorted plain names of all properties that differ; names without a plain form stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in PROPERTY_NAMES.items() for x in pair])
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    differs = F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))
    return F.array_sort(F.transform(differs, lambda k: F.coalesce(F.try_element_at(names, k), k)))


def base_style(level: Column, label_type: Column, left: Column, style: Column) -> Column:
    """The plain name of a group of paragraphs, by list level, label and style name."""
    name = F.regexp_replace(F.lower(F.coalesce(style, F.lit(""))), r"\s+", "_")
    top = F.when(label_type == "ARTICLE", "article").when(label_type == "SECTION", "section").when(label_type == "ROMAN", "roman_section").otherwise("top_level")
    second = F.when(label_type == "LETTER", "subsection").when(label_type == "NUMBER", "subsection_number").when(label_type == "ROMAN", "subsection_roman").otherwise("level_1")
    deep = F.concat(F.lit("level_"), level.cast("string"), F.when(label_type == "ROMAN", "_roman").when(label_type == "LETTER", "_letter").otherwise(""))
    free = F.when(left > 0, "indent_block").when(F.contains(name, F.lit("heading")) | F.contains(name, F.lit("title")), "heading").when(F.contains(name, F.lit("quote")) | F.contains(name, F.lit("block")), "block_quote").otherwise("body")
    return F.when(level == 0, top).when(level == 1, second).when(level > 1, deep).otherwise(free)
