"""Small text helpers.  All of them are built-in expressions and stay in the JVM.

Expressions with nested lambdas are written as Spark SQL text and parsed in one
step (``F.expr``); they take the *name* of the column they work on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import PLAIN_CHARACTERS, STOP_WORDS

# Every character that counts as blank, line breaks included.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ],
    )
)
# The same set as the inside of a regular-expression class (Java and RE2 alike).
WS_CLASS = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_CLASS = r"\p{L}\p{N}_"
EMPTY_STRINGS_SQL = "cast(array() as array<string>)"


def quoted(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + "".join(
        f"\\u{ord(ch):04x}" if ch in "\\'" or ord(ch) < 32 or 126 < ord(ch) < 0x10000 else ch
        for ch in value
    ) + "'"


def quoted_list(values: list[str]) -> str:
    return ", ".join(map(quoted, values))


def let_sql(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``.

    A column reference inside a lambda is evaluated again for every element once
    the optimizer merges projections; a lambda variable never is.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def strip_sql(value: str) -> str:
    return f"btrim({value}, {quoted(WHITESPACE)})"


def strip(c: Column) -> Column:
    """Remove blank characters of any kind from both ends (``trim`` knows spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def empty_strings() -> Column:
    return F.expr(EMPTY_STRINGS_SQL)


def string_array(values: list[str]) -> Column:
    """A constant array of strings."""
    return F.expr(f"array({quoted_list(values)})")


def bullet_text(items: Column) -> Column:
    """``- a`` / ``- b`` lines, one per item."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def joined_or(items: Column, empty: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit(empty))


def plain_characters(c: Column) -> Column:
    """Typographic dashes, quotes and ellipses as plain ASCII."""
    single = {k: v for k, v in PLAIN_CHARACTERS.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for mark, plain in PLAIN_CHARACTERS.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def term_counts(text: str, stop_words: list[str] = STOP_WORDS) -> Column:
    """Term histogram of column ``text``: ``struct<terms, tfs, squares>``.

    ``terms`` are the distinct terms in order, ``tfs`` their counts and ``squares`` the
    sum of squared counts.  A term is a run of two or more word characters, lower-cased.
    The histogram is built inside the row (sort, then run lengths), so a document
    never has to be exploded and shuffled to learn its own term frequencies.
    """
    usable = [w for w in stop_words if re.fullmatch(r"\w{2,}", w)]
    words = f"regexp_extract_all(lower({text}), {quoted(f'[{WORD_CLASS}]{{2,}}')}, 0)"
    if usable:
        words = f"filter({words}, w -> w not in ({quoted_list(usable)}))"
    starts = (
        "filter(transform(s, (w, i) -> case when i = 0 or w <> get(s, i - 1) then i end),"
        " p -> p is not null)"
    )
    lengths = "transform(starts, (p, k) -> coalesce(get(starts, k + 1), size(s)) - p)"
    histogram = (
        "struct(array_distinct(s) as terms, tfs as tfs,"
        " aggregate(tfs, 0L, (acc, n) -> acc + cast(n as bigint) * n) as squares)"
    )
    return F.expr(
        let_sql(f"sort_array({words})", "s", let_sql(starts, "starts", let_sql(lengths, "tfs", histogram)))
    )


def term_rows(counts: str) -> Column:
    """Generator of ``(term, tf)`` rows from a histogram column."""
    return F.inline(F.arrays_zip(f"{counts}.terms", f"{counts}.tfs")).alias("term", "tf")
