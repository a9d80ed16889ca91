"""Counter formats and level templates of numbered lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()


def roman(n: Column) -> Column:
    """Upper-case roman numerals; empty for 0 and below."""
    signs = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(sign).alias("sign")) for v, sign in ROMAN])
    start = F.struct(F.greatest(n.cast("long"), F.lit(0)).alias("left"), F.lit("").alias("out"))
    step = lambda a, x: F.struct((a["left"] % x["value"]).cast("long").alias("left"), F.concat(a["out"], F.repeat(x["sign"], F.floor(a["left"] / x["value"]).cast("int"))).alias("out"))
    return F.aggregate(signs, start, step, lambda a: a["out"])


def letters(n: Column) -> Column:
    """a .. z, aa, ab ...; empty for 0 and below. Seven letters hold any 32-bit number."""
    start = F.struct(F.greatest(n.cast("long"), F.lit(0)).alias("left"), F.lit("").alias("out"))

    def step(a: Column, _: Column) -> Column:
        sign = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), ((a["left"] + 25) % 26 + 1).cast("int"), F.lit(1))
        return F.when(a["left"] > 0, F.struct(F.floor((a["left"] - 1) / 26).cast("long").alias("left"), F.concat(sign, a["out"]).alias("out"))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda a: a["out"])


def ordinal(n: Column) -> Column:
    v = n % 100
    end = F.when(v.between(11, 13), "th").when(v % 10 == 1, "st").when(v % 10 == 2, "nd").when(v % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def _listed(values: list[str], n: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, values)), F.nullif(F.greatest(n, F.lit(0)).cast("int"), F.lit(0)))


def cardinal_text(n: Column) -> Column:
    """one .. ninety-nine; digits for other numbers."""
    ten = _listed(TENS, F.floor(n / 10) - 1)
    tail = F.when(n % 10 > 0, F.concat(F.lit("-"), _listed(ONES, n % 10))).otherwise("")
    return F.when(n.between(1, 19), _listed(ONES, n)).when(n.between(20, 99), F.concat(ten, tail)).otherwise(n.cast("string"))


def ordinal_text(n: Column) -> Column:
    """first .. twelfth; digits and an ending for other numbers."""
    return F.when(n.between(1, 12), _listed(ORDINALS, n)).otherwise(ordinal(n))


def formatted(n: Column, form: Column) -> Column:
    """A counter in the format named; an unknown format gives digits."""
    return (
        F.when(form == "lowerLetter", letters(n)).when(form == "upperLetter", F.upper(letters(n)))
        .when(form == "lowerRoman", F.lower(roman(n))).when(form == "upperRoman", roman(n))
        .when(form == "ordinal", ordinal(n)).when(form == "cardinalText", cardinal_text(n)).when(form == "ordinalText", ordinal_text(n))
        .when(form == "bullet", "•").when(form == "none", "").otherwise(n.cast("string"))
    )


def expanded(template: Column, counters: Column, formats: Column, legal: Column | None = None) -> Column:
    """A level template such as ``%1.%2`` with the counters of its levels.

    ``counters`` and ``formats`` are arrays by level from 0. Where any level is legal
    (``legal`` holds one flag a level), all of them are written as digits.
    """
    plain = F.lit(False) if legal is None else F.exists(legal, lambda x: x)

    def put(text: Column, k: Column) -> Column:
        form = F.when(plain, "decimal").otherwise(F.coalesce(F.get(formats, k - 1), F.lit("decimal")))
        return F.replace(text, F.concat(F.lit("%"), k.cast("string")), F.coalesce(formatted(F.get(counters, k - 1), form), F.lit("")))

    return F.aggregate(F.sequence(F.lit(9), F.lit(1)), template, put)
