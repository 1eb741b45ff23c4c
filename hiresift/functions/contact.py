"""Name, e-mail address and phone number of a résumé text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import NOT_FOUND, UNKNOWN_NAME
from hiresift.functions.text import WS_CLASS, strip

# Fixed patterns; digits and blanks are spelled out so they mean any Unicode
# digit or blank in every regular-expression engine.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_D = r"\p{Nd}"
_SEP = rf"[-.{WS_CLASS}]?"
PHONE = rf"(\+?{_D}{{1,3}}{_SEP})?\(?{_D}{{2,4}}\)?{_SEP}{_D}{{3,4}}{_SEP}{_D}{{3,7}}"
FIRST_LINE = rf"[^{WS_CLASS}][^\n]*"


def _first(text: Column, pattern: str, otherwise: str) -> Column:
    hit = strip(F.regexp_extract(text, pattern, 0))
    return F.coalesce(F.nullif(hit, F.lit("")), F.lit(otherwise))


def name(text: Column) -> Column:
    """First line with anything on it."""
    return _first(text, FIRST_LINE, UNKNOWN_NAME)


def email(text: Column) -> Column:
    """First address.  The search begins only where a run of address characters does,
    which finds the same address but keeps long unbroken runs linear; the cheap test
    first spares texts without any address."""
    found = _first(text, rf"(?<![a-zA-Z0-9._%+-]){EMAIL}", NOT_FOUND)
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.lit(NOT_FOUND))


def phone(text: Column) -> Column:
    return _first(text, PHONE, NOT_FOUND)
