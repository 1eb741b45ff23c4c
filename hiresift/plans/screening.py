"""From résumé text and job descriptions to scored and ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions import contact
from hiresift.functions.fixed_values import (
    AI_CATEGORIES,
    DEGREE_TIERS,
    OTHER_DEGREE_SCORE,
    POINTS_PER_CERTIFICATION,
    POINTS_PER_PROJECT,
    WEIGHTS,
)
from hiresift.functions.sections import SECTIONS, extract_sections
from hiresift.functions.similarity import pairwise_similarity
from hiresift.functions.skills import (
    ALL_SKILLS,
    extract_skills,
    matched_skills,
    missing_skills,
    required_skills,
)
from hiresift.functions.text import empty_strings, is_blank, term_counts
from hiresift.operators import store
from hiresift.operators.joins import lookup_join, rows_per_key
from hiresift.operators.ranking import rank_within_sessions
from hiresift.sources.stored import StoredTables
from hiresift.sources.tables import materialize

SCORED = [
    "candidate_id", "session_id", "name", "email", "overall", "skills", "experience",
    "education", "certifications", "projects", "matched_skills", "missing_skills",
    "education_details", "experience_details", "certifications_details",
    "projects_details", "all_skills",
]


# --- parsing: a map over the scan -------------------------------------------------------
def parse_resumes(resumes: DataFrame, skills: list[str] = ALL_SKILLS) -> DataFrame:
    """Structured records of ``resumes(candidate_id, session_id, filename, raw_text)``.

    A text that is blank gives the empty record: placeholders and empty lists.
    """
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    return (
        resumes.select(
            *[c for c in resumes.columns if c != "raw_text"],
            contact.name(text).alias("name"),
            contact.email(text).alias("email"),
            contact.phone(text).alias("phone"),
            extract_skills(text, skills).alias("skills"),
            extract_sections("raw_text").alias("_sections"),
            F.when(is_blank(text), F.lit("")).otherwise(text).alias("raw_text"),
        )
        .select("*", *[F.col(f"_sections.{s}").alias(s) for s in SECTIONS])
        .drop("_sections")
    )


# --- sub-scores ------------------------------------------------------------------------------
def skill_ratio(own: Column, required: Column) -> Column:
    """Share of the required skills a candidate has, in percent; 0 if none are required."""
    return F.when(F.size(required) == 0, F.lit(0.0)).otherwise(
        F.bround(F.lit(100.0) * F.size(F.array_intersect(own, required)) / F.size(required), 1)
    )


def degree_score(education: Column) -> Column:
    """Best degree tier named anywhere in the education items."""

    text = F.lower(F.array_join(education, " "))
    out = F.when(F.size(education) == 0, F.lit(0.0))
    for points, words in DEGREE_TIERS:
        hit = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(text, F.lit(w))
        out = out.when(hit, F.lit(points))
    return out.otherwise(F.lit(OTHER_DEGREE_SCORE))


def count_score(items: Column, points: float) -> Column:
    return F.least(F.size(items) * F.lit(points), F.lit(100.0))


def weighted_overall(scores: dict[str, Column]) -> Column:
    """Weighted sum in exact decimals, one decimal, halves to even."""
    total = None
    for name, weight in WEIGHTS.items():
        part = scores[name].cast("decimal(5,1)") * F.lit(weight).cast("decimal(3,2)")
        total = part if total is None else total + part
    return F.bround(total, 1).cast("double")


# --- scoring -----------------------------------------------------------------------------------
def session_profiles(sessions: DataFrame, skills: list[str] = ALL_SKILLS) -> DataFrame:
    """What scoring needs of a job description, worked out once per session."""
    jd = F.coalesce(F.col("job_description"), F.lit(""))
    return sessions.select(
        F.col("id").alias("session_id"),
        required_skills("job_description", skills).alias("required_skills"),
        term_counts("job_description").alias("jd_terms"),
        (F.length(jd) > 0).alias("has_jd"),
    )


def ai_score_columns(ai_scores: DataFrame) -> DataFrame:
    """One row per candidate from ``ai_scores(candidate_id, category, score)``."""
    return ai_scores.groupBy("candidate_id").agg(
        *[
            F.max(F.when(F.col("category") == c, F.col("score"))).alias(f"ai_{c}")
            for c in AI_CATEGORIES
        ]
    )


def sub_scores(
    resumes: DataFrame,
    sessions: DataFrame,
    ai_scores: DataFrame | None = None,
    skills: list[str] = ALL_SKILLS,
    **join_options,
) -> DataFrame:
    """Parsed records with ``score_*`` columns for the five categories.

    The job side (required skills, term counts) joins to the résumé rows; terms are
    never exploded, so the only data that can move is one narrow row per résumé.
    """
    parsed = parse_resumes(resumes, skills).withColumn("_terms", term_counts("raw_text"))
    joined = lookup_join(
        parsed.drop("raw_text"),
        session_profiles(sessions, skills),
        "session_id",
        "candidate_id",
        "left",
        sizes=rows_per_key(resumes, ["session_id"]),
        **join_options,
    )
    if ai_scores is None:
        joined = joined.select("*", *[F.expr(f"cast(null as double) as ai_{c}") for c in AI_CATEGORIES])
    else:
        joined = joined.join(ai_score_columns(ai_scores), "candidate_id", "left")

    def ai_if(condition: Column, category: str, otherwise: Column) -> Column:
        ai = F.when(condition, F.bround(F.col(f"ai_{category}"), 1))
        return F.coalesce(ai, otherwise).alias(f"score_{category}")

    def listed(category: str) -> Column:
        return F.size(category) > 0

    required = F.coalesce(F.col("required_skills"), empty_strings())
    similarity = F.coalesce(pairwise_similarity("jd_terms", "_terms"), F.lit(0.0))
    kept = [c for c in joined.columns if not c.startswith("ai_")]
    return joined.select(
        *[c for c in kept if c not in ("_terms", "jd_terms", "has_jd", "required_skills")],
        required.alias("required_skills"),
        ai_if(F.col("has_jd") & listed("skills"), "skills", skill_ratio(F.col("skills"), required)),
        ai_if(listed("experience"), "experience", similarity),
        degree_score(F.col("education")).alias("score_education"),
        ai_if(
            listed("certifications"),
            "certifications",
            count_score(F.col("certifications"), POINTS_PER_CERTIFICATION),
        ),
        ai_if(listed("projects"), "projects", count_score(F.col("projects"), POINTS_PER_PROJECT)),
    )


def score_resumes(
    resumes: DataFrame,
    sessions: DataFrame,
    ai_scores: DataFrame | None = None,
    skills: list[str] = ALL_SKILLS,
    **join_options,
) -> DataFrame:
    """Scored candidates: overall and category scores, skill sets and section items."""
    s = sub_scores(resumes, sessions, ai_scores, skills, **join_options)
    own, required = F.col("skills"), F.col("required_skills")
    return s.select(
        "candidate_id",
        "session_id",
        "name",
        "email",
        weighted_overall({c: F.col(f"score_{c}") for c in WEIGHTS}).alias("overall"),
        *[F.col(f"score_{c}").alias(c) for c in WEIGHTS],
        matched_skills(own, required).alias("matched_skills"),
        missing_skills(own, required).alias("missing_skills"),
        *[F.col(c).alias(f"{c}_details") for c in ("education", "experience", "certifications", "projects")],
        own.alias("all_skills"),
    )


def rank_resumes(
    resumes: DataFrame,
    sessions: DataFrame,
    ai_scores: DataFrame | None = None,
    columns: list[str] = SCORED,
    **options,
) -> DataFrame:
    """Score and rank.  ``columns`` limits what is carried through the ranking."""
    scored = score_resumes(resumes, sessions, ai_scores, **options).select(*columns)
    return rank_within_sessions(materialize(scored))


def process_requests(requests: DataFrame, resumes: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """Validate requests, make sessions of the good ones, score their résumés under the new ids.

    ``requests(id, job_title, jd_text, jd_doc, created_at, browser_id)``; a résumé's
    ``session_id`` is the request it came with.  Gives ``checked`` (requests with
    ``reject_reason``), ``sessions`` (new rows with ``request_id``), ``ranked`` and the
    rows of ``candidates`` to store.  Résumés of rejected requests go nowhere.
    """
    checked = store.validate_requests(requests, resumes)
    batch = checked.where("reject_reason is null").withColumn(
        "job_description", store.chosen_description(F.col("jd_text"), F.col("jd_doc"))
    )
    made = materialize(store.new_sessions(sessions, batch, "id"))
    ids = made.select(F.col("request_id").alias("session_id"), F.col("id").alias("_new"))
    sent = lookup_join(resumes, ids, "session_id", "candidate_id").withColumn("session_id", F.col("_new")).drop("_new")
    ranked = rank_resumes(sent, made.drop("request_id"))
    return {"checked": checked, "sessions": made, "ranked": ranked, "candidates": store.persisted_candidates(ranked)}


def process_and_store(requests: DataFrame, resumes: DataFrame, stored: StoredTables) -> DataFrame:
    """``process_requests`` against the stored tables; its sessions and candidates are appended.  Gives ``checked``."""
    done = process_requests(requests, resumes, stored.read("sessions"))
    stored.append("sessions", done["sessions"])
    stored.append("candidates", done["candidates"])
    return done["checked"]
