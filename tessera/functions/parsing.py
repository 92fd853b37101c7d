"""Parsing of dirty text into typed values, as Column expressions that stay inside generated code.

Numbers are read in the invariant culture: surrounding white space, a leading or trailing sign, commas as thousands
separators and a decimal point; no exponent, currency sign or parentheses. What does not parse is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"

#: The forms of a decimal and of a whole number.
DECIMAL_FORM = r"^\s*([+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)|([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)[+-])\s*$"
INT_FORM = r"^\s*[+-]?[0-9]+\s*$"


def is_blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return text.isNull() | text.rlike(r"^\s*$")


def parse_decimal(text: Column) -> Column:
    """A decimal(38,18), or null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\s,]", ""), r"^(.*)([+-])$", "$2$1")
    return F.when(text.rlike(DECIMAL_FORM), bare.try_cast(DECIMAL))


def parse_int(text: Column) -> Column:
    """An int, or null (also if out of range)."""
    return F.when(text.rlike(INT_FORM), F.regexp_replace(text, r"\s", "").try_cast("int"))


def parse_percentage(text: Column) -> Column:
    """The hundredth of what stands before a percent sign, as a decimal, or null."""
    return (parse_decimal(F.replace(text, F.lit("%"), F.lit(""))) / F.lit(100)).try_cast(DECIMAL)


def parse_money(text: Column) -> Column:
    """An amount without dollar signs and commas; 0 if it is blank or does not parse."""
    return F.coalesce(parse_decimal(F.translate(text, "$,", "")), F.lit(0).cast(DECIMAL))


def is_true(text: Column) -> Column:
    """Whether a flag is exactly ``t``; null is false."""
    return F.coalesce(text == "t", F.lit(False))
