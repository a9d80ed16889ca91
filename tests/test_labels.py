"""Labels at the start of plain text."""

import pytest
from pyspark.sql import functions as F

from quillwork.operators import search, views

TEXTS = ["70.32.29.134 Tioning the", "1.2. The heading", "3) the", "7.The", "12.5 the", "(906) the"]


@pytest.fixture()
def rows(spark):
    none = F.lit(None).cast("int")
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(TEXTS)], "doc_id long, para_idx int, text string").withColumns({c: none for c in ("table_idx", "row_idx", "cell_idx")})


def test_an_address_is_no_heading_of_plain_text(rows):
    from quillwork.functions import text as X

    told = {r.para_idx: (r.list_label, r.list_level) for r in views.document_view(rows, rules=X.WHOLE_NUMBER_RULES).collect()}
    assert told == {0: (None, -1), 1: ("1.2.", 0), 2: ("3)", 0), 3: ("7.", 0), 4: (None, -1), 5: ("(906)", 1)}
    by_rule = {r.para_idx: r.list_label for r in views.document_view(rows).collect()}
    assert by_rule[0] == "70.32.29."


def test_an_address_is_no_label_of_a_hit(rows):
    from quillwork.functions import text as X

    found, _ = search.grep(rows, ["the"], whole_word=True, rules=X.WHOLE_NUMBER_RULES)
    assert {r.para_idx: r.list_label for r in found.collect()} == {0: "", 1: "1.2.", 2: "3)", 4: "", 3: "7.", 5: "(906)"}
