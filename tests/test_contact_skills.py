import random
import re

from pyspark.sql import functions as F

from hiresift.functions import contact
from hiresift.functions.skills import (
    ALL_SKILLS,
    can_overlap,
    category_of,
    extract_skills,
    matched_skills,
    missing_skills,
    required_skills,
)
from tests.test_text import result, texts


def whole_word(skill, text, symbol_end=True):
    """Word boundaries of Python's own regular expressions."""
    return re.search(rf"\b{re.escape(skill)}\b", text.lower()) is not None


def test_lexicon():
    assert len(ALL_SKILLS) == len(set(ALL_SKILLS)) == 79
    assert not can_overlap(ALL_SKILLS)
    assert can_overlap(["machine learning", "learning"])
    assert can_overlap(["deep learning", "learning rate"])


def test_skills_against_word_boundaries(spark):
    rng = random.Random(3)
    glue = [" ", ",", "-", "é", "_", "x", "\n", "/", ".", "7", "·", ""]
    parts = ALL_SKILLS + ["Java", "SQL", "script", "learning", "c", "api", "Machine Learning"]
    values = [
        "".join(rng.choice(parts) + rng.choice(glue) for _ in range(rng.randrange(1, 25))) for _ in range(800)
    ]
    got = result(texts(spark, values).withColumn("x", extract_skills(F.col("t"))))
    assert got == [[s for s in ALL_SKILLS if whole_word(s, v)] for v in values]


def test_overlapping_lexicon_takes_each_skill_on_its_own(spark):
    lexicon = ["machine learning", "learning", "learning rate"]
    df = texts(spark, ["Machine learning rate", "elearning", "learning"])
    got = result(df.withColumn("x", extract_skills(F.col("t"), lexicon)))
    assert got == [lexicon, [], ["learning"]]


def test_symbol_skills(spark):
    df = texts(spark, ["c++ well", "c++x", "c#7", "javascript only"])
    strict = df.withColumn("x", extract_skills(F.col("t")))
    assert result(strict) == [[], ["c++"], ["c#"], ["javascript"]]
    lenient = df.withColumn("x", extract_skills(F.col("t"), strict=False))
    assert result(lenient)[0] == ["c++"]


def test_required_by_substring_and_set_operations(spark):
    df = texts(spark, ["JavaScript only", None, ""])
    assert result(df.withColumn("x", required_skills("t"))) == [["java", "javascript"], [], []]
    own, required = F.array(F.lit("sql"), F.lit("git")), F.array(F.lit("java"), F.lit("git"), F.lit("aws"))
    row = df.limit(1).select(matched_skills(own, required), missing_skills(own, required)).first()
    assert list(row) == [["git"], ["aws", "java"]]


def test_categories(spark):
    df = texts(spark, ["go", "vue.js", "rag", "aws", "sql", "figma", "cobol"])
    want = ["Programming", "Web", "AI/ML", "Cloud", "Databases", "Tools", None]
    assert result(df.withColumn("x", category_of(F.col("t")))) == want


def test_contact(spark):
    values = [
        "\n \t Ann Lee \r\nann.lee+cv@mail.example.org x@y.zz\n+1 (555) 010-1234",
        "",
        " \n\t",
        "No details",
        "4111 1111 1111 1111",
        "192.168.1001.22",
    ]
    df = texts(spark, values)
    email = re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
    phone = re.compile(r"(\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,7}")

    def want(pattern):
        return [m.group().strip() if (m := pattern.search(v)) else "Not found" for v in values]

    assert result(df.withColumn("x", contact.name(F.col("t")))) == [
        "Ann Lee", "Unknown", "Unknown", "No details", "4111 1111 1111 1111", "192.168.1001.22",
    ]
    assert result(df.withColumn("x", contact.email(F.col("t")))) == want(email)
    assert result(df.withColumn("x", contact.phone(F.col("t")))) == want(phone)


def test_phone_on_random_digit_texts(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice("0123456789٣+()-.  ab") for _ in range(25)) for _ in range(500)]
    phone = re.compile(r"(\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,7}")
    want = [m.group().strip() if (m := phone.search(v)) else "Not found" for v in values]
    assert result(texts(spark, values).withColumn("x", contact.phone(F.col("t")))) == want


def test_email_on_random_texts(spark):
    rng = random.Random(11)
    values = ["".join(rng.choice("ab1.@@-_% \n.co") for _ in range(30)) for _ in range(800)]
    email = re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
    want = [m.group() if (m := email.search(v)) else "Not found" for v in values]
    assert any(w != "Not found" for w in want)
    assert result(texts(spark, values).withColumn("x", contact.email(F.col("t")))) == want
