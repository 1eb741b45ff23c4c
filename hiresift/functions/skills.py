"""Finding lexicon skills in résumés (whole words) and job descriptions (substrings)."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import SKILL_CATEGORIES
from hiresift.functions.text import WORD_CLASS, empty_strings, let_sql, quoted_list, string_array

ALL_SKILLS = [s for skills in SKILL_CATEGORIES.values() for s in skills]
CATEGORY_OF = {s: c for c, skills in SKILL_CATEGORIES.items() for s in skills}

_BEFORE = rf"(?<![{WORD_CLASS}])"
_AFTER_WORD = rf"(?![{WORD_CLASS}])"
_AFTER_SYMBOL = rf"(?=[{WORD_CLASS}])"


def _quote(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def _ends_in_word(skill: str) -> bool:
    return skill[-1].isalnum() or skill[-1] == "_"


def _edge(skill: str, strict: bool) -> str:
    """What must follow a skill for its end to be a word boundary.

    A skill that ends in a symbol (``c++``) has a boundary only where a word
    character follows; ``strict=False`` accepts it at the end of a word instead.
    """
    return _AFTER_WORD if _ends_in_word(skill) or not strict else _AFTER_SYMBOL


def skill_pattern(skill: str, strict: bool = True) -> str:
    return _BEFORE + _quote(skill) + _edge(skill, strict)


def one_pass_pattern(skills: list[str], strict: bool = True) -> str:
    """All skills as one alternation, branched on the first letter."""
    branches = []
    for initial, group in groupby(sorted(skills), key=lambda s: s[0]):
        tails = "|".join(_quote(s[1:]) + _edge(s, strict) for s in group)
        branches.append(f"{_quote(initial)}(?:{tails})")
    return f"{_BEFORE}(?:{'|'.join(branches)})"


def can_overlap(skills: list[str]) -> bool:
    """Whether two skills could both match in overlapping stretches of a text.

    If not, scanning once for any of them finds every one that occurs.
    """
    pieces = {s: re.split(r"(?<=\W)|(?=\W)", s) for s in skills}
    for a in skills:
        for b in skills:
            if a == b:
                continue
            pa, pb = pieces[a], pieces[b]
            inside = any(pa[i : i + len(pb)] == pb for i in range(len(pa) - len(pb) + 1))
            overlaps = any(pa[-n:] == pb[:n] for n in range(1, min(len(pa), len(pb))))
            if inside or overlaps:
                return True
    return False


def extract_skills(
    text: Column, skills: list[str] = ALL_SKILLS, strict: bool = True
) -> Column:
    """Skills that occur in the text as whole words, in lexicon order."""
    low = F.lower(text)
    if can_overlap(skills):
        hits = [
            F.when(F.contains(low, F.lit(s)) & low.rlike(skill_pattern(s, strict)), F.lit(s))
            for s in skills
        ]
        return F.coalesce(F.array_compact(F.array(*hits)), empty_strings())
    found = F.regexp_extract_all(low, F.lit(one_pass_pattern(skills, strict)), F.lit(0))
    return F.coalesce(F.array_intersect(string_array(skills), found), empty_strings())


def required_skills(job_description: str, skills: list[str] = ALL_SKILLS) -> Column:
    """Skills whose name appears anywhere in column ``job_description``, even inside a word."""
    return F.expr(
        let_sql(
            f"lower(coalesce({job_description}, ''))",
            "jd",
            f"filter(array({quoted_list(skills)}), s -> contains(jd, s))",
        )
    )


def matched_skills(own: Column, required: Column) -> Column:
    return F.sort_array(F.array_intersect(own, required))


def missing_skills(own: Column, required: Column) -> Column:
    return F.sort_array(F.array_except(required, own))


def category_of(skill: Column) -> Column:
    """Lexicon category of a skill, NULL outside the lexicon."""
    out = None
    for category, members in SKILL_CATEGORIES.items():
        hit = skill.isin(members)
        out = F.when(hit, F.lit(category)) if out is None else out.when(hit, F.lit(category))
    return out
