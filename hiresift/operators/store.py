"""Changes to the stored tables.  Parquet rows are never edited in place: every
function returns the table as it is after the change, ready to be written as the
next snapshot or, for appends, as new files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import STATUSES
from hiresift.functions.text import is_blank, strip
from hiresift.operators.joins import lookup_join, salted_join
from hiresift.operators.ranking import number_rows
from hiresift.sources.tables import SCORED_SCHEMA

JSON_FIELDS = SCORED_SCHEMA.fieldNames()


# --- intake ------------------------------------------------------------------------
def chosen_description(text: Column, document: Column) -> Column:
    """An uploaded description replaces the typed one, even when it came out empty."""
    return F.when(document.isNotNull(), document).otherwise(text)


def validate_requests(requests: DataFrame, resumes: DataFrame) -> DataFrame:
    """Add ``n_resumes`` and ``reject_reason`` (NULL when the request can be processed)."""
    counts = resumes.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n_resumes"))
    n = F.coalesce(F.col("n_resumes"), F.lit(0))
    reason = (
        F.when(n == 0, F.lit("no resume"))
        .when(is_blank(F.col("jd_text")) & F.col("jd_doc").isNull(), F.lit("no job description"))
        .when(is_blank(F.col("job_title")), F.lit("no job title"))
    )
    return requests.join(counts, "id", "left").withColumns({"n_resumes": n, "reject_reason": reason})


# --- appends -------------------------------------------------------------------------
def _last_id(table: DataFrame) -> Column:
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    return F.lit(last)


def new_sessions(sessions: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """The batch as sessions, ids following the largest one in ``order_col`` order; ``request_id`` is the old id."""
    numbered = number_rows(batch, order_col, _last_id(sessions))
    return numbered.select(
        F.col("_number").alias("id"), F.col("id").alias("request_id"),
        "job_title", "job_description", "created_at", "browser_id",
    )


def append_sessions(sessions: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """Sessions plus a batch; ``new_sessions`` also tells which request became which session."""
    return sessions.unionByName(new_sessions(sessions, batch, order_col).drop("request_id"))


def new_notes(notes: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """The batch's notes that are not blank, without outer blanks, ids following the largest one."""
    kept = batch.where(~is_blank(F.col("note_text"))).withColumn("note_text", strip(F.col("note_text")))
    numbered = number_rows(kept, order_col, _last_id(notes))
    return numbered.select(F.col("_number").alias("id"), "candidate_id", "note_text", "created_at")


def append_notes(notes: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """Notes plus ``new_notes``."""
    return notes.unionByName(new_notes(notes, batch, order_col))


def persisted_candidates(scored: DataFrame) -> DataFrame:
    """Rows of the candidates table for scored candidates, with the full record as JSON."""
    return scored.select(
        F.col("candidate_id").alias("id"),
        "session_id",
        "name",
        "email",
        F.col("overall").alias("overall_score"),
        F.to_json(F.struct(*JSON_FIELDS)).alias("data_json"),
        F.lit("New").alias("status"),
    )


def loaded_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with the JSON record opened into typed columns."""
    return candidates.withColumn("_data", F.from_json("data_json", SCORED_SCHEMA)).select(
        F.col("id").alias("candidate_id"), "session_id", "status", "_data.*"
    )


def variant_records(candidates: DataFrame) -> DataFrame:
    """Candidates with ``data``, the JSON record as a VARIANT: unknown keys stay; NULL where it is no JSON."""
    return candidates.withColumn("data", F.try_parse_json("data_json")).drop("data_json")


def record_fields(records: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``records`` with a column for each ``name: (path, type)`` of ``data``; NULL where it is absent or of another type."""
    return records.withColumns({name: F.try_variant_get("data", path, kind) for name, (path, kind) in fields.items()})


def record_schema(records: DataFrame) -> str:
    """The schema of all records together, merged in the tasks."""
    return records.agg(F.schema_of_variant_agg("data").alias("s")).first()["s"]


def json_records(records: DataFrame) -> DataFrame:
    """Back to ``data_json``, with every key that the record had."""
    return records.withColumn("data_json", F.to_json("data")).drop("data")


def with_columns_of(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables as one; columns the older one lacks are NULL."""
    return old.unionByName(new, allowMissingColumns=True)


# --- updates and deletes ----------------------------------------------------------------
def latest_status(updates: DataFrame) -> DataFrame:
    """``(id, _new)`` from ``updates(id, new_status, seq)``: the highest ``seq`` per id wins.

    Updates outside the known statuses are ignored.  The latest update is picked by
    an aggregate, so repeated updates of one candidate are merged before the shuffle.
    """
    known = updates.where(F.col("new_status").isin(STATUSES))
    return known.groupBy("id").agg(F.max_by("new_status", "seq").alias("_new"))


def apply_status_updates(candidates: DataFrame, updates: DataFrame) -> DataFrame:
    """Candidates after ``updates`` (see ``latest_status``), with ``changed``."""
    return (
        candidates.join(latest_status(updates), "id", "left")
        .withColumn("changed", F.coalesce(F.col("_new") != F.col("status"), F.lit(False)))
        .withColumn("status", F.coalesce("_new", "status"))
        .drop("_new")
    )


def delete_sessions(
    sessions: DataFrame, candidates: DataFrame, notes: DataFrame, deleted: DataFrame, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of the three tables after deleting the sessions in ``deleted(id)``."""
    ids = deleted.select(F.col("id").alias("session_id")).distinct()
    gone = lookup_join(
        candidates.select("id", "session_id"), ids, "session_id", "id", "left_semi", **options
    ).select(F.col("id").alias("candidate_id"))
    return (
        sessions.join(ids.withColumnRenamed("session_id", "id"), "id", "left_anti"),
        lookup_join(candidates, ids, "session_id", "id", "left_anti", **options),
        salted_join(notes, gone, "candidate_id", "id", "left_anti"),
    )
