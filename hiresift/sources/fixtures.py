"""Screening tables derived from the given Parquet tables, for checks and benchmarks.

Each view is one select over a given table, in SQL that Spark and DuckDB both
understand, so the two engines start from identical rows.  Session 0 attracts a
third of all candidates and candidate 1 a third of all notes, so every check runs
on skewed data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.functions.skills import ALL_SKILLS
from hiresift.functions.text import strip_sql
from hiresift.sources.tables import spread

_SK = ",".join(ALL_SKILLS)


def _sk(e: str) -> str:
    return f"split_part('{_SK}', ',', cast(({e}) % {len(ALL_SKILLS)} as int) + 1)"


_NL = "chr(10)"
# 15 candidates per session, a third of them moved to session 0; every 25th
# session stays empty.
_SESSION_OF_K = """case when c_custkey % 3 = 0 then 0
  when cast(floor(c_custkey / 15) as bigint) % 25 = 24 then 1
  else cast(floor(c_custkey / 15) as bigint) end"""

_k = "c_custkey"
_RESUME_TEXT = f"""case when {_k} % 97 = 0 then '' when {_k} % 101 = 0 then ' ' || chr(9) || {_NL} || ' ' else
     c_name || {_NL}
  || case when {_k} % 11 = 0 then '' else 'user' || {_k} || '@mail' || ({_k} % 7) || '.example.com' || {_NL} end
  || case when {_k} % 5 = 0 then '' else '+1 (555) 010-' || (1000 + {_k} % 9000) || {_NL} end
  || 'Skills: ' || {_sk(_k + '*7')} || ', ' || {_sk(_k + '*13+5')} || ', ' || {_sk(_k + '*17+11')} || ', ' || {_sk(_k + '*29+3')} || {_NL}
  || case {_k} % 3 when 0 then 'EXPERIENCE' when 1 then '  Work Experience' || chr(13) else 'Employment History' end || {_NL}
  || '- Built ' || {_sk(_k + '*7')} || ' services' || {_NL} || chr(9) || 'for the ' || c_mktsegment || ' team' || {_NL}
  || case when {_k} % 2 = 0 then '- Ran ' || {_sk(_k + '*29+3')} || ' platform' || {_NL} else '' end
  || case when {_k} % 13 = 0 then 'Summary' || {_NL} else '' end
  || case when {_k} % 4 = 0 then 'EDUCATION CERTIFICATIONS' || {_NL}
          else 'Education' || {_NL}
            || case {_k} % 6 when 0 then 'PhD in Physics' when 1 then 'Master of Science' when 2 then 'B.Tech Computing'
                 when 3 then 'Diploma' else 'Bachelor of Arts' end || {_NL}
            || 'Certificates' || {_NL} end
  || case when {_k} % 7 = 0 then '' else '- Certified ' || {_sk(_k + '*13+5')} || {_NL} end
  || case when {_k} % 7 > 3 then '• Licensed ' || {_sk(_k + '*17+11')} || {_NL} else '' end
  || case when {_k} % 8 < 2 then '' else 'Key Projects' || {_NL} || '- ' || {_sk(_k + '*31')} || ' dashboard' || {_NL} end
  || case when {_k} % 8 > 5 then '- ' || {_sk(_k + '*37')} || ' pipeline' || {_NL} else '' end
  || case when {_k} % 9 = 0 then {_NL} || chr(9) || 'Skills' || chr(13) || {_NL} else '' end
  || case when {_k} % 10 = 0 then 'Projects' || {_NL} || '- Late “work” — item' || {_NL} else '' end
 end"""

_n = "s_suppkey"
_JD_TEXT = f"""case when {_n} % 17 = 16 then ' ' else
  'We need ' || {_sk(_n + '*7')} || ' and ' || {_sk(_n + '*13+5')} || ' plus ' || {_sk(_n + '*17+11')} || ', '
  || {_sk(_n + '*29+3')} || ', ' || {_sk(_n + '*31+40')} || ' services for the team.' end"""
_JD_DOC = f"""case when {_n} % 23 = 22 then '' when {_n} % 5 = 4 then
  'Role: built ' || {_sk(_n + '*3')} || ' services and ' || {_sk(_n + '*11')} || ' platform work for the ' || s_name || ' team' end"""
_TITLE = f"case when {_n} % 10 = 9 then 'Data Engineer' else s_name || ' Engineer' end"
_CREATED = f"'2024-01-' || case when {_n} % 20 < 9 then '0' else '' end || ({_n} % 20 + 1) || 'T09:30:00.000000'"
_OWNER = "case when s_nationkey % 5 = 0 then null else 'b' || (s_nationkey % 5) end"

# view -> (given table, select list)
VIEW_SQL = {
    "resumes": (
        "customer",
        [
            f"{_k} as candidate_id",
            f"cast({_SESSION_OF_K} as bigint) as session_id",
            f"'cv_' || {_k} || '.pdf' as filename",
            f"{_RESUME_TEXT} as raw_text",
        ],
    ),
    "requests": (
        "supplier",
        [
            f"{_n} as id",
            f"case when {_n} % 19 = 18 then '  ' else {_TITLE} end as job_title",
            f"{_JD_TEXT} as jd_text",
            f"{_JD_DOC} as jd_doc",
            f"{_CREATED} as created_at",
            f"{_OWNER} as browser_id",
        ],
    ),
    "sessions": (
        "supplier",
        [
            f"{_n} as id",
            f"{_TITLE} as job_title",
            f"case when {_JD_DOC} is not null then {_JD_DOC} else {_JD_TEXT} end as job_description",
            f"{_CREATED} as created_at",
            f"{_OWNER} as browser_id",
        ],
    ),
    "candidates": (
        "customer",
        [
            f"{_k} as id",
            f"cast({_SESSION_OF_K} as bigint) as session_id",
            f"case when {_k} % 6 = 0 then 'Same Name' else c_name end as name",
            f"'user' || {_k} || '@example.com' as email",
            f"cast(({_k} * 37 % 1001) / 10.0 as double) as overall_score",
            f"case {_k} % 4 when 0 then 'New' when 1 then 'Shortlisted' when 2 then 'Interview' else 'Rejected' end as status",
        ],
    ),
    "notes": (
        "orders",
        [
            "o_orderkey as id",
            "case when o_orderkey % 3 = 0 then 1 else o_custkey end as candidate_id",
            "case when o_orderkey % 29 = 0 then ' ' || chr(9) when o_orderkey % 31 = 0 then '  ' || o_orderpriority || chr(10) else o_orderpriority end as note_text",
            "cast(cast(o_orderdate as date) as string) || 'T10:15:00.123456' as created_at",
        ],
    ),
    "status_updates": (
        "orders",
        [
            "o_custkey as id",
            "case when o_orderkey % 37 = 0 then 'Hired' when o_orderstatus = 'F' then 'Rejected' when o_orderstatus = 'O' then 'Interview' else 'Shortlisted' end as new_status",
            "o_orderkey as seq",
        ],
    ),
    "chat": (
        "conversations",
        [
            "conv_id",
            "cast(case when conv_id % 3 = 0 then 0 else conv_id % 10 end as bigint) as session_id",
            "turn",
            "role",
            "text",
        ],
    ),
    "lookups": (
        "orders",
        ["o_orderkey as request_id", "o_custkey as wanted_session_id"],
    ),
}
# Replies of the relevance model per candidate and category; one in six is absent.
_REPLY = """case (c_custkey + i) % 6
  when 1 then '{"score": 85, "reason": "x"}'
  when 2 then '```json' || chr(10) || '{"score": 85, "reason": "x"}' || chr(10) || '```'
  when 3 then '{"score": "140"}'
  when 4 then case c_custkey % 4 when 0 then 'not json' when 2 then '{"score": 85} {}' else ' {"score": 61.25} ' end
  when 5 then case c_custkey % 4 when 0 then '{"reason": "x"}' when 2 then '{''score'': 85}' else '{"score": -3}' end end"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEW_SQL[name]
    rows = table(spark, sf_dir, source)
    if name == "resumes":
        rows = spread(rows.select("c_custkey", "c_name", "c_mktsegment"))
    return rows.selectExpr(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def ai_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(candidate_id, category, raw_reply)``, four categories per candidate."""
    return (
        table(spark, sf_dir, "customer")
        .selectExpr(
            "c_custkey",
            "inline(array(struct(0 as i, 'skills' as category), struct(1 as i, 'experience' as category),"
            " struct(2 as i, 'certifications' as category), struct(3 as i, 'projects' as category)))",
        )
        .selectExpr("c_custkey as candidate_id", "category", f"{_REPLY} as raw_reply")
        .where("raw_reply is not null")
    )


def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Résumés laid out on pages: first line across, the rest in two columns.

    ``(doc_id, plain_text, pages ARRAY<STRUCT<height, words ARRAY<STRUCT<text, x0, x1, top>>>>>)``
    Odd lines stand in the left column, even lines in the right one; 12 rows fill a page.
    """
    rows_per_page, page_height = 12, 240.0

    def words(line, row, left):
        parts = F.split(line, " ")
        start = F.transform(
            parts,
            lambda w, i: left + 5.0 * (F.length(F.array_join(F.slice(parts, 1, i), " ")) + F.when(i > 0, 1).otherwise(0)),
        )
        return F.transform(
            parts,
            lambda w, i: F.struct(
                w.alias("text"),
                F.get(start, i).alias("x0"),
                (F.get(start, i) + 5.0 * F.length(w)).alias("x1"),
                (20.0 * (row % rows_per_page) + F.when(left > 0, 1.5).otherwise(0.0)).alias("top"),
            ),
        )

    resumes = view(spark, sf_dir, "resumes").select(
        F.col("candidate_id").alias("doc_id"),
        F.col("raw_text").alias("plain_text"),
        F.expr(f"filter(transform(split(raw_text, '\\n'), l -> {strip_sql('l')}), l -> l <> '')").alias("ls"),
    )
    placed = resumes.withColumn(
        "placed",
        F.transform(
            "ls",
            lambda line, i: F.struct(
                F.floor((i + 1) / 2).cast("int").alias("row"),
                words(
                    line,
                    F.floor((i + 1) / 2).cast("int"),
                    F.when((i == 0) | (i % 2 == 1), F.lit(0.0)).otherwise(F.lit(600.0)),
                ).alias("words"),
            ),
        ),
    )
    n_pages = F.greatest(F.lit(0), F.floor(F.size("ls") / 2 / rows_per_page).cast("int"))
    return placed.select(
        "doc_id",
        "plain_text",
        F.transform(
            F.sequence(F.lit(0), n_pages),
            lambda p: F.struct(
                F.lit(page_height).alias("height"),
                F.flatten(
                    F.transform(
                        F.filter("placed", lambda x: F.floor(x["row"] / rows_per_page) == p),
                        lambda x: x["words"],
                    )
                ).alias("words"),
            ),
        ).alias("pages"),
    )


def damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extracted_pages`` with documents that layout can't read, or whose plain text is missing too.

    By ``doc_id % 7``: 1 no pages, 2 pages without words, 3 a further page with NULL words,
    4 a further word without a place.
    """
    docs = extracted_pages(spark, sf_dir)
    page = docs.schema["pages"].dataType.elementType
    words = page["words"].dataType
    no_words = F.struct(F.lit(240.0).alias("height"), F.lit(None).cast(words).alias("words"))
    lost = F.array(F.struct(F.lit("?").alias("text"), *[F.lit(None).cast("double").alias(c) for c in ("x0", "x1", "top")]))
    no_place = F.struct(F.lit(240.0).alias("height"), lost.cast(words).alias("words"))
    kind = F.col("doc_id") % 7
    changed = (
        F.when(kind == 1, F.lit(None).cast(docs.schema["pages"].dataType))
        .when(kind == 2, F.transform("pages", lambda p: F.struct(p["height"].alias("height"), F.slice(p["words"], 1, 0).alias("words"))))
        .when(kind == 3, F.concat("pages", F.array(no_words)))
        .when(kind == 4, F.concat("pages", F.array(no_place)))
        .otherwise(F.col("pages"))
    )
    plain = F.when(F.col("doc_id") % 10 != 0, F.col("plain_text"))
    return docs.withColumns({"pages": changed, "plain_text": plain})
