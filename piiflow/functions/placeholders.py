"""Placeholders: their styles, numbers and letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("upperLetters", "lowerLetters", "dollarNumber", "kindNumber", "bracketKind", "mustache")
#: Styles whose placeholders carry the kind, and count for each kind by itself.
KIND_STYLES = ("kindNumber", "bracketKind", "mustache")


def letters(index: Column, width: int = 3) -> Column:
    """1 is AAA, 2 AAB ... ZZZ, BAAA: base 26, padded on the left with A."""
    n = F.greatest(F.floor(index), F.lit(1)).cast("long") - 1
    digits = []
    for k in range(10):  # 26 ** 10 exceeds any count of values, and doubles are exact below it
        power = 26**k
        digit = ((n - n % power) / power).cast("long") % 26
        digits.append(F.char((digit + 65).cast("int")))
    whole = F.concat(*reversed(digits))
    short = F.regexp_replace(whole, "^A+", "")
    return F.when(F.length(short) < width, F.right(whole, F.lit(width))).otherwise(short)


def kind_slug(kind: Column) -> Column:
    """Letters and digits of a kind; X without any."""
    return F.coalesce(F.nullif(F.regexp_replace(kind, r"[^\p{L}\p{N}]+", ""), F.lit("")), F.lit("X"))


def format_placeholder(style: Column | str, index: Column, kind: Column) -> Column:
    """The placeholder of a style, number and kind; numbers are whole and 1 at least."""
    n = F.greatest(F.floor(index), F.lit(1)).cast("long")
    slug, digits = kind_slug(kind), n.cast("string")
    forms = {
        "upperLetters": lambda: letters(n),
        "lowerLetters": lambda: F.lower(letters(n)),
        "dollarNumber": lambda: F.concat(F.lit("$"), digits),
        "kindNumber": lambda: F.concat(F.upper(slug), digits),
        "bracketKind": lambda: F.concat(F.lit("["), F.upper(slug), F.lit(" "), digits, F.lit("]")),
        "mustache": lambda: F.concat(F.lit("{{"), F.lower(slug), digits, F.lit("}}")),
    }
    if isinstance(style, str):
        return forms.get(style, forms["kindNumber"])()
    chosen = forms["kindNumber"]()
    for name, form in forms.items():
        chosen = F.when(style == name, form()).otherwise(chosen) if name != "kindNumber" else chosen
    return chosen


def placeholder_examples(style: Column | str, kind: Column, count: int = 3) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: format_placeholder(style, i, kind)), ", ")
