import random

import pytest

from hiresift.functions.fixed_values import SECTION_ALIASES
from hiresift.functions.sections import ALL_ALIASES, SECTIONS, extract_sections, split_merged_headers
from tests.test_text import result, texts

SECTION_OF = {a: s for s, aliases in SECTION_ALIASES.items() for a in aliases}


def headers_in(line):
    """Headers a line consists of, taking the longest each time; None if not only headers."""
    found, rest = [], line.strip().lower()
    while rest:
        fitting = [a for a in ALL_ALIASES if rest.startswith(a)]
        if not fitting:
            return None
        found.append(max(fitting, key=len))
        rest = rest[len(found[-1]):].strip()
    return found


def brute_force(text):
    lines = []
    for raw in text.split("\n"):
        found = headers_in(raw)
        lines += found if found and len(found) > 1 else [raw.strip()]
    kind = [SECTION_OF.get(line.lower()) for line in lines]
    out = {}
    for section in SECTIONS:
        out[section] = []
        if section not in kind:
            continue
        first = kind.index(section)
        others = [i for i, k in enumerate(kind) if i > first and k not in (None, section)]
        for i in range(first + 1, min(others, default=len(lines))):
            if kind[i] or not lines[i]:
                continue
            if lines[i][:2] in ("- ", "• "):
                out[section].append(lines[i][2:])
            elif out[section]:
                out[section][-1] += " " + lines[i]
            else:
                out[section].append(lines[i])
    return out


def sections(spark, values):
    return [r.asDict() for r in result(texts(spark, values).withColumn("x", extract_sections("t")))]


@pytest.mark.parametrize(
    "text, section, items",
    [
        ("Projects\n- a\nKey Projects\n- b", "projects", ["a", "b"]),
        ("Projects\n- a\nEducation\nx\nProjects\n- b", "projects", ["a"]),
        ("Projects\n- a\nSkills", "projects", ["a Skills"]),
        ("EDUCATION CERTIFICATIONS\nBSc\n- AWS", "certifications", ["BSc", "AWS"]),
        ("EDUCATION CERTIFICATIONS\nBSc", "education", []),
        ("Key Projects\n\n•  x \n\ty\r\n- ", "projects", [" x y -"]),
        ("", "projects", []),
        ("education & training\nBSc", "education", ["BSc"]),
    ],
)
def test_rules(spark, text, section, items):
    assert sections(spark, [text])[0][section] == items
    assert brute_force(text)[section] == items


def test_random_documents(spark):
    rng = random.Random(5)
    pieces = ["- one", "• two", "  three ", "", "Skills", "-four", "- - five", "\tsix\r", "•", "licenses to drive"]

    def line():
        if rng.random() < 0.35:
            sep = rng.choice([" ", "", "  ", " "])
            header = sep.join(rng.choices(ALL_ALIASES, k=rng.choice([1, 1, 1, 2, 3])))
            return rng.choice([header, header.upper(), header.title(), f" {header}\r", header + "s"])
        return rng.choice(pieces)

    values = ["\n".join(line() for _ in range(rng.randrange(0, 20))) for _ in range(1500)]
    assert sections(spark, values) == [brute_force(v) for v in values]


def test_split_keeps_other_lines(spark):
    text = "  Ann \nEDUCATIONCertifications\nEducation\n licenses & certificationslicenses \nx"
    want = "  Ann \neducation\ncertifications\nEducation\nlicenses & certifications\nlicenses\nx"
    assert result(texts(spark, [text]).withColumn("x", split_merged_headers("t"))) == [want]
