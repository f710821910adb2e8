"""Check digits and the normal forms of identifiers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn_valid(digits: Column) -> Column:
    """At least two ASCII digits whose mod-10 check holds."""
    # luhn_check alone accepts a single 0.
    return F.coalesce(F.rlike(digits, F.lit(r"^[0-9]{2,}\z")) & F.call_function("luhn_check", digits), F.lit(False))


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _number(text: Column, at: int, n: int) -> Column:
    return F.substr(text, F.lit(at), F.lit(n)).try_cast("int")


def normalize_pin(raw: Column) -> Column:
    """The ten digits of a plausible personal number, else null.

    Ten or twelve digits; a real month, a day of 1 to 31 or that plus 60; a century of 18 to 20; Luhn.
    """
    digits = _digits(raw)
    ten = F.right(digits, F.lit(10))
    month, day, century = _number(ten, 3, 2), _number(ten, 5, 2), _number(digits, 1, 2)
    day = F.when(day > 60, day - 60).otherwise(day)
    n = F.length(digits)
    good = n.isin(10, 12) & month.between(1, 12) & day.between(1, 31) & ((n == 10) | century.between(18, 20)) & luhn_valid(ten)
    return F.when(good, ten)


def is_org_number(raw: Column) -> Column:
    """Ten digits, or twelve from 16 on; the third and fourth at least 20; Luhn."""
    digits = _digits(raw)
    ten = F.when((F.length(digits) == 12) & digits.startswith("16"), F.substr(digits, F.lit(3))).otherwise(digits)
    return F.coalesce((F.length(ten) == 10) & (_number(ten, 3, 2) >= 20) & luhn_valid(ten), F.lit(False))


def normalize_phone(raw: Column) -> Column:
    """The national form of a plausible number, else null. Dates with hyphens or blanks are none."""
    digits = _digits(raw)
    digits = (
        F.when(digits.startswith("0046"), F.concat(F.lit("0"), F.substr(digits, F.lit(5))))
        .when(F.trim(raw).startswith("+46"), F.concat(F.lit("0"), F.substr(digits, F.lit(3))))
        .otherwise(digits)
    )
    digits = F.when(digits.startswith("00"), F.substr(digits, F.lit(2))).otherwise(digits)
    date = F.rlike(F.trim(raw), F.lit(r"^[0-9]{2}[-\s][0-9]{2}[-\s](19|20)[0-9]{2}\z"))
    return F.when(F.rlike(digits, F.lit(r"^0[1-9][0-9]{6,9}\z")) & ~date, digits)
