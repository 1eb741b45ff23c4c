import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import WEIGHTS
from hiresift.plans import screening


def lists(spark, values, name="items"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} array<string>")


def result(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_degree_tiers(spark):
    values = [[], ["Diploma"], ["Scrum Master"], ["Ph.D."], ["B.Tech", "PhD"], ["Bachelor of Arts"], ["M.S. Physics"]]
    got = result(lists(spark, values), screening.degree_score(F.col("items")))
    assert got == [0.0, 30.0, 85.0, 100.0, 100.0, 60.0, 85.0]


def test_count_scores(spark):
    values = [["x"] * n for n in range(6)]
    df = lists(spark, values)
    assert result(df, screening.count_score(F.col("items"), 25.0)) == [0.0, 25.0, 50.0, 75.0, 100.0, 100.0]
    assert result(df, screening.count_score(F.col("items"), 33.0)) == [0.0, 33.0, 66.0, 99.0, 100.0, 100.0]


def test_skill_ratio_rounds_like_python(spark):
    rows = [(n * 100 + m, m, n) for n in range(0, 80) for m in range(n + 1)]
    df = spark.createDataFrame(rows, "id int, m int, n int").select(
        "id",
        "m",
        "n",
        F.expr("transform(slice(sequence(1, 80), 1, m), x -> cast(x as string))").alias("own"),
        F.expr("transform(slice(sequence(1, 80), 1, n), x -> cast(x as string))").alias("required"),
    )
    got = {(r["m"], r["n"]): r["s"] for r in df.select("m", "n", screening.skill_ratio(F.col("own"), F.col("required")).alias("s")).collect()}
    assert got == {(m, n): round(m / n * 100, 1) if n else 0.0 for _, m, n in rows}
    assert got[(1, 16)] == 6.2


def test_overall_is_an_exact_decimal_sum(spark):
    rng = random.Random(9)
    rows = [(i, *[rng.randrange(0, 1001) / 10 for _ in WEIGHTS]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in WEIGHTS))
    got = result(df, screening.weighted_overall({c: F.col(c) for c in WEIGHTS}))
    want = [
        float(sum(Decimal(str(v)) * Decimal(w) for v, w in zip(r[1:], WEIGHTS.values())).quantize(Decimal("0.1"), ROUND_HALF_EVEN))
        for r in rows
    ]
    assert got == want


RESUMES = [
    (1, 10, "a.pdf", "Ann\nann@x.org\npython and sql\nExperience\n- Built python services\nCertifications\n- AWS\n- GCP\n- CKA"),
    (2, 10, "b.pdf", "Bob\nEducation\nPhD\nKey Projects\n- a\n- b\n- c\n- d"),
    (3, 10, "c.pdf", " \n "),
    (4, 11, "d.pdf", "Dee\njava"),
    (5, 12, "e.pdf", None),
    (6, 99, "f.pdf", "Eve\npython"),
]
SESSIONS = [(10, "Engineer", "python sql services"), (11, "Blank", "  "), (12, "Null", None)]


def frames(spark):
    return (
        spark.createDataFrame(RESUMES, "candidate_id bigint, session_id bigint, filename string, raw_text string"),
        spark.createDataFrame(SESSIONS, "id bigint, job_title string, job_description string"),
    )


def by_id(df):
    return {r["candidate_id"]: r for r in df.collect()}


def test_screening_by_the_rules(spark):
    scored = by_id(screening.score_resumes(*frames(spark)))
    assert len(scored) == len(RESUMES)
    ann, bob = scored[1], scored[2]
    assert (ann["skills"], ann["certifications"], ann["education"]) == (100.0, 75.0, 0.0)
    assert ann["experience"] > 0
    assert (bob["education"], bob["projects"], bob["skills"]) == (100.0, 100.0, 0.0)
    assert bob["missing_skills"] == ["python", "sql"] and ann["matched_skills"] == ["python", "sql"]
    for i in (3, 5):
        assert (scored[i]["name"], scored[i]["email"], scored[i]["overall"]) == ("Unknown", "Not found", 0.0)
    assert scored[4]["experience"] == 0.0 and scored[4]["skills"] == 0.0
    assert scored[6]["skills"] == 0.0  # no such session: kept, nothing required
    for r in scored.values():
        assert 0 <= r["overall"] <= 100


def test_no_ai_scores_is_the_same_as_empty_ones(spark):
    resumes, sessions = frames(spark)
    none = spark.createDataFrame([], "candidate_id bigint, category string, score double")
    assert by_id(screening.score_resumes(resumes, sessions, none)) == by_id(screening.score_resumes(resumes, sessions))


def test_ai_scores_replace_rules_only_where_there_are_items(spark):
    resumes, sessions = frames(spark)
    rows = [(i, c, 61.25) for i in range(1, 7) for c in ("skills", "experience", "certifications", "projects")]
    ai = spark.createDataFrame(rows, "candidate_id bigint, category string, score double")
    got = by_id(screening.score_resumes(resumes, sessions, ai))
    assert (got[1]["skills"], got[1]["experience"], got[1]["certifications"], got[1]["projects"]) == (61.2, 61.2, 61.2, 0.0)
    assert (got[2]["skills"], got[2]["projects"], got[2]["certifications"]) == (0.0, 61.2, 0.0)
    assert got[3]["overall"] == 0.0
    assert got[4]["skills"] == 61.2  # blank but present description


@pytest.mark.parametrize("rows_per_salt", [1, 10**6])
def test_large_session_tables_give_the_same_scores(spark, rows_per_salt):
    resumes, sessions = frames(spark)
    salted = screening.score_resumes(resumes, sessions, broadcast_limit=0, rows_per_salt=rows_per_salt)
    assert by_id(salted) == by_id(screening.score_resumes(resumes, sessions))


def test_parsing_and_sections_do_not_shuffle(spark):
    plan = screening.parse_resumes(frames(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_ranks_run_from_one(spark):
    resumes, sessions = frames(spark)
    rows = screening.rank_resumes(resumes, sessions).collect()
    ranks = sorted((r["session_id"], r["rank"]) for r in rows)
    assert ranks == [(10, 1), (10, 2), (10, 3), (11, 1), (12, 1), (99, 1)]
    for r in rows:
        assert set(r["matched_skills"]).isdisjoint(r["missing_skills"])


def test_very_long_documents_are_read_whole(spark):
    """Megabytes of text: no deep recursion, no quadratic search, nothing cut off."""
    lines = "".join(f"- item {i} of the list\n" for i in range(60_000))
    text = "x" * 1_000_000 + "\n@\nExperience\n" + lines + "EDUCATION CERTIFICATIONS\n" + lines + "last@example.org rust"
    resumes = spark.createDataFrame([(1, 10, "big.txt", text)], "candidate_id bigint, session_id bigint, filename string, raw_text string")
    parsed = screening.parse_resumes(resumes).first()
    assert (parsed["email"], parsed["skills"]) == ("last@example.org", ["rust"])
    assert len(parsed["experience"]) == 60_000 and len(parsed["certifications"]) == 60_000
    assert parsed["certifications"][-1].endswith("last@example.org rust")
    scored = screening.score_resumes(resumes, frames(spark)[1]).first()
    assert scored["certifications"] == 100.0
