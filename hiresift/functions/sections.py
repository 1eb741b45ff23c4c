"""Résumé sections: header lines, merged headers, bullet and continuation items.

A text is cut before its header lines and the parts are put together inside the row,
so parsing a corpus is a map over the scan: no explode, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import BULLETS, SECTION_ALIASES
from hiresift.functions.text import (
    EMPTY_STRINGS_SQL,
    WS_CLASS,
    let_sql,
    quoted,
    quoted_list,
    strip_sql,
)

SECTIONS = list(SECTION_ALIASES)
ALL_ALIASES = [a for aliases in SECTION_ALIASES.values() for a in aliases]


def _longest_first(aliases: list[str]) -> list[str]:
    return sorted(aliases, key=len, reverse=True)


def _escaped(alias: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", alias)


ALIAS_PATTERN = "|".join(map(_escaped, _longest_first(ALL_ALIASES)))
# For use under (?i): the Kelvin sign is the one character outside ASCII whose
# lower-case form is an ASCII letter.
_ANY_CASE = ALIAS_PATTERN.replace("k", r"(?:k|\x{212A})")
_H = WS_CLASS.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}-\x{0D}")  # blanks but the line feed
# Two or more headers and nothing else; atomic, so a longer header once taken
# is never given back for a shorter one.
MERGED_HEADERS = rf"^(?>(?>{ALIAS_PATTERN})[{WS_CLASS}]*+){{2,}}+\z"
# The same anywhere in a text whose every line follows a line feed.
_SOME_MERGED = rf"(?i)\n[{_H}]*+(?>(?>{_ANY_CASE})[{_H}]*+){{2,}}+(?=\n|\z)"
_BEFORE_HEADER = rf"(?i)\n(?=(?:{_ANY_CASE})(?=\n|\z))"


def _unmerged_sql(text: str) -> str:
    """Text in which every line made of several headers is replaced by those headers."""
    split_line = let_sql(
        f"lower({strip_sql('line')})",
        "low",
        f"case when low rlike {quoted(MERGED_HEADERS)}"
        f" then regexp_extract_all(low, {quoted(f'(?:{ALIAS_PATTERN})')}, 0)"
        " else array(line) end",
    )
    return f"array_join(flatten(transform(split({text}, '\\n'), line -> {split_line})), '\\n')"


def split_merged_headers(text: str) -> Column:
    """Column ``text`` with merged header lines split; other lines keep their exact form."""
    return F.expr(f"case when '\\n' || {text} rlike {quoted(_SOME_MERGED)} then {_unmerged_sql(text)} else {text} end")


def _parts_sql(text: str, split_headers: bool) -> str:
    """The text cut before every header line, lines stripped and blank ones left out.

    The first part is what stands before any header; every line in it, and every line
    after the header in the others, follows a line feed.
    """
    lines = f"array_remove(transform(split(coalesce({text}, ''), '\\n'), line -> {strip_sql('line')}), '')"
    whole = f"'\\n' || array_join({lines}, '\\n')"

    def cut(value: str) -> str:
        return f"split(regexp_replace({value}, {quoted(_BEFORE_HEADER)}, '\\n\\n'), '\\n\\n')"

    if not split_headers:
        return cut(whole)
    unmerged = f"case when t rlike {quoted(_SOME_MERGED)} then {_unmerged_sql('t')} else t end"
    return let_sql(whole, "t", cut(unmerged))


def _opened_sql() -> str:
    """For each part the section its header opens, '' for the part before any header."""
    cases = " ".join(
        f"when lower(substring_index(part, '\\n', 1)) in ({quoted_list(aliases)}) then {quoted(section)}"
        for section, aliases in SECTION_ALIASES.items()
    )
    return f"transform(parts, (part, i) -> case when i = 0 then '' {cases} end)"


def _section_sql(section: str) -> str:
    """Items between the first header of ``section`` and the next header of another one.

    Headers of the same section in between are passed over.  A line that does not
    begin with a bullet continues the line before it, unless it is the first.
    """
    name = quoted(section)
    stop = (
        f"coalesce(get(filter(transform(opened, (o, i) -> case when i >= start and o <> {name} then i end),"
        " i -> i is not null), 0), size(parts))"
    )
    body = (
        f"array_join(transform(slice(parts, start, {stop} - start + 1),"
        " part -> substring(part, length(substring_index(part, '\\n', 1)) + 1)), '')"
    )
    # Items start after two line feeds; a single one that is left joins two lines.
    bullets = "|".join(map(_escaped, BULLETS))
    marked = f"regexp_replace({body}, {quoted(rf'\n(?:{bullets})')}, '\\n\\n')"
    joined = f"regexp_replace({marked}, {quoted(r'\n(?<=[^\n]\n)(?!\n)')}, ' ')"
    items = f"array_remove(split({joined}, '\\n+'), '')"
    return let_sql(
        f"cast(array_position(opened, {name}) as int)",
        "start",
        f"case when start = 0 then {EMPTY_STRINGS_SQL} else {items} end",
    )


def extract_sections(text: str, sections: list[str] = SECTIONS, split_headers: bool = True) -> Column:
    """Struct with one ``array<string>`` of items per section of column ``text``."""
    fields = ", ".join(f"{_section_sql(s)} as {s}" for s in sections)
    return F.expr(
        let_sql(_parts_sql(text, split_headers), "parts", let_sql(_opened_sql(), "opened", f"struct({fields})"))
    )
