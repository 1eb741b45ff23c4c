"""Recruiter-side queries over sessions, candidates, notes and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import REPORT_FILE_PREFIX, REPORT_TITLE, WEIGHTS
from hiresift.functions.skills import category_of
from hiresift.functions.text import bullet_text, joined_or, plain_characters
from hiresift.operators.joins import lookup_join, salted_join
from hiresift.operators.ranking import top_k

CATEGORIES = list(WEIGHTS)
ALL_SCORES = ["overall", *CATEGORIES]


def percent_text(c: Column) -> Column:
    """A score as it reads in running text, e.g. ``85.3%``."""
    return F.concat(c.cast("string"), F.lit("%"))


def date_of(created_at: Column) -> Column:
    return F.substring(created_at, 1, 10)


# --- sessions --------------------------------------------------------------------------
def session_by_id(sessions: DataFrame, session_id: int) -> DataFrame:
    return sessions.where(F.col("id") == session_id)


def sessions_by_ids(sessions: DataFrame, requests: DataFrame, request_key: str) -> DataFrame:
    """Many lookups at once: ``requests`` with a ``wanted_session_id``; NULLs where unknown."""
    renamed = sessions.withColumnRenamed("id", "wanted_session_id")
    return salted_join(requests, renamed, "wanted_session_id", request_key, "left")


def visible_sessions(sessions: DataFrame, browser_id: str) -> DataFrame:
    """An owner's sessions and those without owner, newest first."""
    mine = (F.col("browser_id") == browser_id) | F.col("browser_id").isNull()
    return sessions.where(mine).orderBy(F.desc("created_at"), "id")


def session_options(sessions: DataFrame) -> DataFrame:
    """Pick list ``title — date`` -> id; of equal labels the oldest session is kept."""
    label = F.concat_ws(" — ", "job_title", date_of(F.col("created_at")))
    return (
        sessions.groupBy(label.alias("label"))
        .agg(F.min(F.struct("created_at", "id")).alias("_first"))
        .select("label", F.col("_first.id").alias("id"))
    )


def dashboard(sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per session with counts by status and the top score.

    Candidates are aggregated before the join, so it meets one row per session.
    """
    per_session = candidates.groupBy(F.col("session_id").alias("id")).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.max("overall_score").alias("_top"),
        *[
            F.count_if(F.col("status") == s).alias(s.lower())
            for s in ("Shortlisted", "Interview", "Rejected")
        ],
    )
    counts = ["candidates", "shortlisted", "interview", "rejected"]
    return sessions.join(per_session, "id", "left").select(
        F.col("id").alias("session_id"),
        "job_title",
        date_of(F.col("created_at")).alias("created"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce(percent_text(F.col("_top")), F.lit("0%")).alias("top_score"),
    )


def processed_counts(sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    counts = candidates.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("processed"))
    return sessions.join(counts, "id").select(
        F.col("id").alias("session_id"),
        "processed",
        F.format_string(
            "Processed %d candidate(s) and saved session '%s'!", "processed", "job_title"
        ).alias("message"),
    )


# --- candidates and notes -----------------------------------------------------------------
def session_candidates(candidates: DataFrame, session_id: int | None = None) -> DataFrame:
    """Candidates of one session, best first; or of all, in no order."""
    if session_id is None:
        return candidates
    return candidates.where(F.col("session_id") == session_id).orderBy(F.desc("overall_score"), "id")


def _note_line() -> Column:
    return F.concat(F.substring("created_at", 1, 16), F.lit(" — "), F.col("note_text"))


def candidate_notes(notes: DataFrame, candidate_id: int | None = None) -> DataFrame:
    """Notes of one candidate, newest first; or of all, in no order; with their display line."""
    lines = notes.withColumn("line", _note_line())
    if candidate_id is None:
        return lines
    return lines.where(F.col("candidate_id") == candidate_id).orderBy(F.desc("created_at"), F.desc("id"))


def candidates_with_notes(candidates: DataFrame, notes: DataFrame, **options) -> DataFrame:
    """Every candidate with each of its notes; candidates without notes once, with NULLs.

    Notes drive the join, because one candidate may have most of them.
    """
    people = candidates.select(F.col("id").alias("candidate_id"), "session_id", "name")
    texts = notes.select("candidate_id", F.col("id").alias("note_id"), _note_line().alias("line"))
    noted = salted_join(texts, people, "candidate_id", "note_id", "inner", **options)
    silent = people.join(notes.select("candidate_id").distinct(), "candidate_id", "left_anti")
    return noted.unionByName(silent, allowMissingColumns=True)


# --- lookups by name ---------------------------------------------------------------------
def last_by_name(candidates: DataFrame) -> DataFrame:
    """Per session and name the row a name-keyed dictionary would keep: the last in rank order."""
    return (
        candidates.groupBy("session_id", "name")
        .agg(
            F.min(F.struct("overall_score", (-F.col("id")).alias("neg_id"), "status")).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select("session_id", "name", F.col("_last.status").alias("name_status"), "_n")
    )


def status_by_name(candidates: DataFrame, **options) -> DataFrame:
    """Candidates with the status found under their name instead of their id."""
    return salted_join(
        candidates, last_by_name(candidates), ["session_id", "name"], "id", sizes="_n", **options
    )


def first_by_name(candidates: DataFrame) -> DataFrame:
    """Per session and name the first candidate in rank order."""
    return (
        candidates.groupBy("session_id", "name")
        .agg(F.max(F.struct("overall_score", (-F.col("id")).alias("neg_id"))).alias("_first"))
        .select(
            "session_id",
            "name",
            (-F.col("_first.neg_id")).alias("id"),
            F.col("_first.overall_score").alias("overall_score"),
        )
    )


# --- rankings ---------------------------------------------------------------------------------
def with_status(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Attach each candidate's stored status (one row per id on both sides)."""
    return ranked.join(candidates.select(F.col("id").alias("candidate_id"), "status"), "candidate_id")


def rankings_table(ranked: DataFrame) -> DataFrame:
    """The rankings as displayed; needs ``status``."""
    return ranked.select(
        "session_id",
        "candidate_id",
        "rank",
        F.col("name").alias("candidate"),
        *[F.format_string("%.1f%%", F.col(c)).alias(c) for c in ALL_SCORES],
        "status",
    )


def column_widths(ranked: DataFrame) -> DataFrame:
    """Per session and exported column: longest text or header, plus two."""
    shown = {"Rank": "rank", "Candidate": "name", **{c.capitalize(): c for c in ALL_SCORES}, "Status": "status"}
    longest = ranked.groupBy("session_id").agg(
        *[F.max(F.length(F.col(c).cast("string"))).alias(h) for h, c in shown.items()]
    )
    return longest.unpivot("session_id", list(shown), "column_name", "_longest").select(
        "session_id",
        "column_name",
        (F.greatest(F.col("_longest"), F.length("column_name")) + 2).cast("bigint").alias("width"),
    )


def score_unpivot(ranked: DataFrame) -> DataFrame:
    """Category scores in long form, the data of the grouped bar chart."""
    return ranked.select("session_id", "candidate_id", "name", *CATEGORIES).unpivot(
        ["session_id", "candidate_id", "name"], CATEGORIES, "category", "score"
    )


def profile_cards(ranked: DataFrame) -> DataFrame:
    """Heading, contact, skills and detail lists per candidate; needs ``status``."""
    heading = F.concat(
        F.col("name"), F.lit(" - Score: "), percent_text(F.col("overall")), F.lit(" | Status: "), F.col("status")
    )
    return ranked.select(
        "session_id",
        "candidate_id",
        heading.alias("heading"),
        "email",
        joined_or(F.col("all_skills"), "None listed").alias("skills"),
        *[
            bullet_text(F.col(f"{c}_details")).alias(c)
            for c in ("education", "experience", "certifications", "projects")
        ],
    )


def skills_by_category(parsed: DataFrame) -> DataFrame:
    """Candidates per skill, with the skill's category."""
    return (
        parsed.select(F.explode("skills").alias("skill"))
        .groupBy("skill")
        .agg(F.count(F.lit(1)).alias("candidates"))
        .select(category_of(F.col("skill")).alias("category"), "skill", "candidates")
    )


# --- comparison -------------------------------------------------------------------------------------
def default_pairs(scored: DataFrame) -> DataFrame:
    """Per session the best candidate ``a`` and the second ``b`` (again the best if alone)."""
    fields = [c for c in scored.columns if c != "session_id"]
    best = top_k(scored, 2)
    return best.groupBy("session_id").agg(
        F.min_by(F.struct(*fields), "rank").alias("a"),
        F.max_by(F.struct(*fields), "rank").alias("b"),
    )


def pairs(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pairs picked by the user: ``chosen(session_id, a_id, b_id)``."""
    fields = [c for c in scored.columns if c != "session_id"]

    def side(name: str) -> DataFrame:
        return scored.select(F.col("candidate_id").alias(f"{name}_id"), F.struct(*fields).alias(name))

    return chosen.join(side("a"), "a_id").join(side("b"), "b_id").select("session_id", "a", "b")


def compare_scores(paired: DataFrame) -> DataFrame:
    """Both scores per category with an arrow towards the better one."""
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(c.capitalize()).alias("category"),
                    F.col(f"a.{c}").alias("a_value"),
                    F.col(f"b.{c}").alias("b_value"),
                )
                for c in ALL_SCORES
            ]
        )
    )
    arrow = (
        F.when(F.col("a_value") > F.col("b_value"), F.lit("←"))
        .when(F.col("b_value") > F.col("a_value"), F.lit("→"))
        .otherwise(F.lit("−"))
    )
    return paired.select(
        "session_id", F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"), rows
    ).withColumn("arrow", arrow)


def compare_skills(paired: DataFrame) -> DataFrame:
    """Skills only one of the two has, and those both have."""
    a, b = F.col("a.all_skills"), F.col("b.all_skills")

    def shown(skills: Column) -> Column:
        return joined_or(F.sort_array(skills), "None")

    return paired.select(
        "session_id",
        F.col("a.name").alias("a_name"),
        F.col("b.name").alias("b_name"),
        shown(F.array_except(a, b)).alias("only_a"),
        shown(F.array_intersect(a, b)).alias("both"),
        shown(F.array_except(b, a)).alias("only_b"),
    )


# --- hiring report ---------------------------------------------------------------------------------
def report_lines(ranked: DataFrame, sessions: DataFrame, **options) -> DataFrame:
    """The report of every session as lines: three of heading, four per candidate.

    ``rank`` 0 marks the heading; lines read in (rank, line_no) order.  Needs ``status``.
    The heading comes with the best candidate's row, so the ranking is read once.
    """
    titles = sessions.select(
        F.col("id").alias("session_id"),
        F.concat(F.lit(REPORT_FILE_PREFIX), F.replace("job_title", F.lit(" "), F.lit("_"))).alias("file_name"),
        "job_title",
        date_of(F.col("created_at")).alias("_date"),
    )
    line_type = "array<struct<rank:bigint,line_no:int,line:string>>"

    def lines(rank: Column, *texts: Column) -> Column:
        numbered = [F.struct(rank, F.lit(i), text) for i, text in enumerate(texts, start=1)]
        return F.array(*numbered).cast(line_type)

    labels = ["Skills", "Experience", "Education", "Certs", "Projects"]
    scores = [F.concat(F.lit(f"{label}: "), percent_text(F.col(c))) for label, c in zip(labels, CATEGORIES)]
    name_line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("name"), F.lit(" - "),
        percent_text(F.col("overall")), F.lit(" ("), F.col("status"), F.lit(")"),
    )
    candidate = lines(
        F.col("rank"),
        plain_characters(name_line),
        F.concat_ws("  ", *scores),
        F.concat(F.lit("Matched skills: "), joined_or(F.col("matched_skills"), "None")),
        F.concat(F.lit("Missing skills: "), joined_or(F.col("missing_skills"), "None")),
    )
    heading = lines(
        F.lit(0),
        F.lit(REPORT_TITLE),
        F.concat(F.lit("Job: "), F.col("job_title")),
        F.concat(F.lit("Generated: "), F.col("_date")),
    )
    every = F.when(F.col("rank") == 1, F.concat(heading, candidate)).otherwise(candidate)
    joined = lookup_join(ranked, titles, "session_id", "candidate_id", **options)
    return joined.select("session_id", "file_name", F.inline(every))
