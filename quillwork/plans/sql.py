"""Pieces of SQL that several queries share."""

PARAGRAPHS = """(SELECT doc_id, lang, source, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS para_idx, unnest(parts) AS text
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents))"""


def normalised(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
