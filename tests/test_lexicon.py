"""Lexicon terms in texts: both ways against brute force, and against the fixed lexicon's expressions."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from hiresift.functions.skills import ALL_SKILLS, extract_skills, required_skills, skill_pattern
from hiresift.operators import lexicon

WAYS = [{}, {"broadcast_limit": 0}, {"broadcast_limit": 0, "rows_per_salt": 3}]
TERMS = ["java", "javascript", "c++", "c#", ".net", "ci/cd", "machine learning", "learning", "a", "a b", "a b c", "b c", "été", "x--y", "--", "_u", "1", " ", "aa", "aaaa", "Rust"]


def brute(texts, terms, how, strict=True):
    out = set()
    for key, text in texts:
        for term in {t.lower() for t in terms if t}:
            if text is None:
                continue
            low = text.lower()
            hit = term in low
            if hit and how == "words":
                pattern = skill_pattern(term, strict).replace(r"\ ", " ")
                hit = regex.search(pattern, low) is not None
            if hit:
                out.add((key, term))
    return sorted(out)


def odd_texts(n=300):
    r = random.Random(4)
    bits = [*TERMS, " ", " ", ".", ",", "\n", "x", "_", "é", "\t", "-", "/", "(", "c", "java8", "learning ", "+"]
    texts = [(i, "".join(r.choice(bits) for _ in range(r.randrange(14)))) for i in range(n)]
    return [*texts, (1000, None), (1001, ""), (1002, "a"), (1003, "C++ and c#7, c++x JAVA Rust")]


@pytest.mark.parametrize("options", WAYS)
@pytest.mark.parametrize("how,strict", [("words", True), ("words", False), ("anywhere", True)])
def test_terms_equal_brute_force(spark, how, strict, options):
    texts = odd_texts()
    df = spark.createDataFrame(texts, "id long, body string").repartition(3)
    terms = spark.createDataFrame([(t,) for t in [*TERMS, "java", "", None]], "term string")
    found = lexicon.find_terms(df, terms, "id", "body", how, strict, **options)
    assert sorted(map(tuple, found.collect())) == brute(texts, TERMS, how, strict)


@pytest.mark.parametrize("options", WAYS[:2])
def test_nothing_to_find(spark, options):
    df = spark.createDataFrame([(1, "a b")], "id long, body string")
    none = spark.createDataFrame([], "term string")
    for how in ("words", "anywhere"):
        assert lexicon.find_terms(df, none, "id", "body", how, **options).collect() == []
        assert lexicon.find_terms(df.limit(0), spark.createDataFrame([("a",)], "term string"), "id", "body", how, **options).collect() == []


@pytest.mark.parametrize("options", WAYS[:2])
def test_a_hundred_thousand_terms(spark, options):
    r = random.Random(8)
    syllables = ["ka", "lo", "mi", "nu", "re", "so", "ti", "va"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(2, 5)))
    terms = set()
    while len(terms) < 100_000:
        terms.add(" ".join(word() for _ in range(r.randrange(1, 4))))
    texts = [(i, " ".join(word() for _ in range(120))) for i in range(60)]
    df = spark.createDataFrame(texts, "id long, body string").repartition(4)
    table = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    want = set()
    for key, text in texts:
        w = text.split()
        want |= {(key, t) for n in (1, 2, 3) for i in range(len(w) - n + 1) if (t := " ".join(w[i : i + n])) in terms}
    assert set(map(tuple, lexicon.find_terms(df, table, "id", "body", **options).collect())) == want
    inside = {(k, t[i:j]) for k, t in texts[:5] for i in range(len(t)) for j in range(i + 4, min(i + 40, len(t)) + 1) if t[i:j] in terms}
    assert set(map(tuple, lexicon.find_terms(df.where("id < 5"), table, "id", "body", "anywhere", **options).collect())) == inside


@pytest.mark.parametrize("bits", [lexicon.MOST_BITS, 64])
def test_only_runs_that_may_be_terms_are_joined(spark, monkeypatch, bits):
    """The filter keeps most runs out of the shuffle, and a full one costs rows but no term."""
    r = random.Random(3)
    texts = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(200))) for i in range(50)]
    terms = [f"w{i} w{i + 1}" for i in range(0, 500, 3)]
    joined, real = [], lexicon.salted_join
    monkeypatch.setattr(lexicon, "MOST_BITS", bits)
    monkeypatch.setattr(lexicon, "salted_join", lambda fact, *rest, **options: joined.append(fact.count()) or real(fact, *rest, **options))
    df, table = spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted(map(tuple, lexicon.find_terms(df, table, "id", "body", broadcast_limit=0).collect()))
    assert got == brute(texts, terms, "words")
    assert len(got) <= joined[0] <= 50 * 199 and (bits == 64 or joined[0] < 2000)


def test_the_fixed_lexicon_as_a_table(spark):
    texts = [(i, t) for i, t in enumerate(["Python, SQL and C++x; ci/cd", "JavaScript", "java js", "", "rest api REST API nlp"])]
    df = spark.createDataFrame(texts, "id long, body string")
    table = spark.createDataFrame(list(enumerate(ALL_SKILLS)), "pos int, term string")
    for how, expected in (("words", extract_skills(F.col("body"))), ("anywhere", required_skills("body"))):
        listed = lexicon.terms_in_order(lexicon.find_terms(df, table, "id", "body", how), table, "id", "pos")
        got = {r["id"]: r["terms"] for r in listed.collect()}
        assert {r["id"]: r["e"] for r in df.select("id", expected.alias("e")).collect()} == {i: got.get(i, []) for i, _ in texts}
