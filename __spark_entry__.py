"""Registered queries of the screening engine and the SQL they are checked against."""

from __future__ import annotations

import math
import os
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hiresift.functions import contact  # noqa: E402
from hiresift.functions.sections import SECTIONS, extract_sections, split_merged_headers  # noqa: E402
from hiresift.functions.similarity import pairwise_similarity  # noqa: E402
from hiresift.functions.skills import ALL_SKILLS, extract_skills, required_skills  # noqa: E402
from hiresift.functions.text import plain_characters, term_counts  # noqa: E402
from hiresift.operators import layout, lexicon, ranking, relevance, store  # noqa: E402
from hiresift.operators.corpus import append_frequencies, corpus_similarity, document_frequencies, stored_frequencies  # noqa: E402
from hiresift.operators.joins import lookup_join  # noqa: E402
from hiresift.operators.replies import ReplyStore  # noqa: E402
from hiresift.plans import prompts, reports, screening  # noqa: E402
from hiresift.sources import files, fixtures, stored, tables  # noqa: E402

try:
    from hiresift.llm import queries as llm_queries  # noqa: E402
except ImportError as missing:  # the rest works without that subpackage, but not without what that needs
    if missing.name not in ("hiresift.llm", "hiresift.llm.queries"):
        raise
    llm_queries = None

# The stand-in models below travel with the job to the executors.
if __name__ in sys.modules:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMOKE_DIR = "/root/testdata/sf0.001"


def _joined(column: str, sep: str = " | ") -> Column:
    return F.array_join(F.col(column), sep)


# --- inputs -------------------------------------------------------------------------------
def _resumes(spark, d):
    return fixtures.view(spark, d, "resumes")


def _sessions(spark, d):
    return fixtures.view(spark, d, "sessions")


def _candidates(spark, d):
    return fixtures.view(spark, d, "candidates")


def _parsed(spark, d):
    return screening.parse_resumes(_resumes(spark, d))


def _ai_scores(spark, d):
    return relevance.parsed_replies(fixtures.ai_replies(spark, d)).where("score is not null")


def _sub_scores(spark, d, ai=False):
    return screening.sub_scores(
        _resumes(spark, d), _sessions(spark, d), _ai_scores(spark, d) if ai else None
    )


def _scored(spark, d):
    return screening.score_resumes(_resumes(spark, d), _sessions(spark, d))


def _ranked(spark, d):
    return screening.rank_resumes(_resumes(spark, d), _sessions(spark, d))


def _ranked_with_status(spark, d):
    return reports.with_status(_ranked(spark, d), _candidates(spark, d))


def _with_joined_lists(df: DataFrame) -> DataFrame:
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return df.withColumns({c: _joined(c) for c in lists})


# --- sources, intake, stored tables -----------------------------------------------------------
def scan_resumes(spark, d):
    return _resumes(spark, d)


def ingest_rejects(spark, d):
    return tables.unreadable(_resumes(spark, d)).select("candidate_id", "filename", "reject_reason")


def parsed_empty(spark, d):
    empty = screening.parse_resumes(tables.unreadable(_resumes(spark, d)).drop("reject_reason"))
    return _with_joined_lists(empty)


def final_jd(spark, d):
    chosen = store.chosen_description(F.col("jd_text"), F.col("jd_doc"))
    return fixtures.view(spark, d, "requests").select("id", chosen.alias("job_description"))


def session_validation(spark, d):
    checked = store.validate_requests(fixtures.view(spark, d, "requests"), _resumes(spark, d))
    return checked.select("id", "n_resumes", "reject_reason")


def schema_evolve(spark, d):
    old = _sessions(spark, d).drop("browser_id")
    new = fixtures.view(spark, d, "requests").select(
        "id", "job_title", F.col("jd_text").alias("job_description"), "created_at", "browser_id"
    )
    return store.with_columns_of(old, new)


def append_sessions(spark, d):
    checked = store.validate_requests(fixtures.view(spark, d, "requests"), _resumes(spark, d))
    batch = checked.where("reject_reason is null").withColumn(
        "job_description", store.chosen_description(F.col("jd_text"), F.col("jd_doc"))
    )
    return store.append_sessions(_sessions(spark, d), batch, "id")


def _processed(spark, d):
    return screening.process_requests(fixtures.view(spark, d, "requests"), _resumes(spark, d), _sessions(spark, d))


def process_sessions(spark, d):
    done = _processed(spark, d)
    made = done["sessions"].select(F.col("request_id").alias("id"), F.col("id").alias("session_id"))
    return done["checked"].select("id", "reject_reason").join(made, "id", "left")


def process_candidates(spark, d):
    return _processed(spark, d)["candidates"].drop("data_json")


def append_notes(spark, d):
    existing = fixtures.view(spark, d, "chat").selectExpr(
        "conv_id * 100 + turn as id", "conv_id as candidate_id", "text as note_text",
        "'2023-12-31T08:00:00.000000' as created_at",
    )
    return store.append_notes(existing, fixtures.view(spark, d, "notes"), "id")


def persist_candidates(spark, d):
    return store.persisted_candidates(_scored(spark, d))


def candidate_json_roundtrip(spark, d):
    stored = store.persisted_candidates(_scored(spark, d))
    return _with_joined_lists(store.loaded_candidates(stored))


def apply_status_updates(spark, d):
    return store.apply_status_updates(
        _candidates(spark, d), fixtures.view(spark, d, "status_updates")
    ).select("id", "session_id", "status", "changed")


def _after_delete(spark, d):
    closed = fixtures.table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("s_suppkey as id")
    return store.delete_sessions(
        _sessions(spark, d), _candidates(spark, d), fixtures.view(spark, d, "notes"), closed
    )


def delete_cascade_sessions(spark, d):
    return _after_delete(spark, d)[0]


def delete_cascade_candidates(spark, d):
    return _after_delete(spark, d)[1]


def delete_cascade_notes(spark, d):
    return _after_delete(spark, d)[2]


# --- stored tables: written, changed and read back --------------------------------------------
def _stored(spark, **tables_of):
    made = stored.StoredTables(spark, tables.new_folder(spark), buckets=16)
    for name, rows in tables_of.items():
        made.append(name, rows)
    return made


def _processed_twice(spark, d):
    """Two batches of requests, one after the other; the second leaves the first one's files alone."""
    made, requests = _stored(spark), fixtures.view(spark, d, "requests")
    for half in (0, 1):
        screening.process_and_store(requests.where(F.col("id") % 2 == half), _resumes(spark, d), made)
    return made


def stored_sessions(spark, d):
    return _processed_twice(spark, d).read("sessions")


def stored_candidates(spark, d):
    return _processed_twice(spark, d).read("candidates").drop("data_json")


def _candidate_rows(spark, d):
    return _candidates(spark, d).withColumn("data_json", F.lit("{}"))


def stored_notes(spark, d):
    made = _stored(spark)
    notes = fixtures.view(spark, d, "notes")
    for half in (0, 1):
        batch = notes.where(F.col("id") % 2 == half)
        made.append("notes", store.new_notes(made.read("notes"), batch, "id"))
    return made.read("notes")


def stored_status_updates(spark, d):
    """Two rounds of updates; the later round wins."""
    made, updates = _stored(spark, candidates=_candidate_rows(spark, d)), fixtures.view(spark, d, "status_updates")
    for half in (0, 1):
        made.update_status(updates.where(F.col("seq") % 2 == half))
    return made.read("candidates").drop("data_json")


def _stored_after_delete(spark, d):
    made = _stored(
        spark, sessions=_sessions(spark, d), candidates=_candidate_rows(spark, d), notes=fixtures.view(spark, d, "notes")
    )
    made.delete_sessions(fixtures.table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("s_suppkey as id"))
    return made


def stored_delete_sessions(spark, d):
    return _stored_after_delete(spark, d).read("sessions")


def stored_delete_candidates(spark, d):
    return _stored_after_delete(spark, d).read("candidates").drop("data_json")


def stored_delete_notes(spark, d):
    return _stored_after_delete(spark, d).read("notes")


def stored_session_by_id(spark, d):
    return _stored(spark, sessions=_sessions(spark, d)).lookup("sessions", 7)


def stored_candidates_of_session(spark, d):
    return _stored(spark, candidates=_candidate_rows(spark, d)).lookup("candidates", 0).drop("data_json")


def stored_notes_of_candidate(spark, d):
    return _stored(spark, notes=fixtures.view(spark, d, "notes")).lookup("notes", 1)


def candidate_json_variant(spark, d):
    """Records with keys that no schema knows, stored as VARIANT and opened again."""
    unknown = F.format_string(', "reviewed": {"team": "T%d", "level": %d}}', F.col("id") % 5, F.col("id") % 3)
    candidates = persist_candidates(spark, d)
    longer = F.concat(F.expr("substring(data_json, 1, length(data_json) - 1)"), unknown)
    path = tables.new_folder(spark)
    store.variant_records(candidates.withColumn("data_json", longer)).write.parquet(path)
    fields = {
        "record_name": ("$.name", "string"), "overall": ("$.overall", "double"), "first_skill": ("$.all_skills[0]", "string"),
        "team": ("$.reviewed.team", "string"), "level": ("$.reviewed.level", "int"), "absent": ("$.reviewed.none", "string"),
    }
    opened = store.record_fields(spark.read.parquet(path), fields)
    return opened.select("id", "session_id", *fields)


def scan_files(spark, d):
    """Job descriptions as files, some of them damaged: each is read or rejected."""
    path = tables.new_folder(spark)
    jobs = fixtures.view(spark, d, "requests").select("id", F.encode("jd_text", "utf-8").alias("bytes"))
    damaged = F.when(F.col("id") % 7 == 1, F.concat("bytes", F.unhex(F.lit("FFFE")))).otherwise(F.col("bytes"))
    files_of = jobs.select(F.concat(F.lit("jd_"), F.col("id").cast("string")).alias("file"), damaged.cast("string").alias("value"))
    # A set number of tasks: by the few bytes of small files they would be merged into one or two.
    tasks = min(max(math.ceil(files_of.count() / 250), spark.sparkContext.defaultParallelism), 10_000)
    files_of.repartition(tasks, "file").write.partitionBy("file").text(path)
    number = F.regexp_extract("path", "/file=jd_([0-9]+)/", 1).cast("bigint")
    return files.scan_files(spark, path, "*.txt").select(number.alias("id"), "raw_text", "reject_reason")


def tfidf_corpus_stored(spark, d):
    """Document frequencies kept as a table and added to in two batches."""
    path, resumes = tables.new_folder(spark), _resumes(spark, d)
    for half in (0, 1):
        append_frequencies(document_frequencies(resumes.where(F.col("candidate_id") % 2 == half)), path)
    return corpus_similarity(resumes, _sessions(spark, d), frequencies=tables.materialize(stored_frequencies(spark, path)))


def stored_schema_evolve(spark, d):
    """Files of two generations in one table: the older ones lack a column."""
    path = tables.new_folder(spark)
    stored.append_evolved(_sessions(spark, d).drop("browser_id"), path)
    new = fixtures.view(spark, d, "requests").select("id", "job_title", F.col("jd_text").alias("job_description"), "created_at", "browser_id")
    stored.append_evolved(new, path)
    return stored.evolved(spark, path)


# --- reads ------------------------------------------------------------------------------------
def session_by_id(spark, d):
    return reports.sessions_by_ids(
        _sessions(spark, d), fixtures.view(spark, d, "lookups"), "request_id"
    ).select("request_id", "wanted_session_id", "job_title", "job_description", "created_at", "browser_id")


def visible_sessions(spark, d):
    return reports.visible_sessions(_sessions(spark, d), "b2")


def session_candidates(spark, d):
    return reports.session_candidates(_candidates(spark, d))


def candidate_notes(spark, d):
    return reports.candidate_notes(fixtures.view(spark, d, "notes"))


def candidates_of_session(spark, d):
    return reports.session_candidates(_candidates(spark, d), 0)


def notes_of_candidate(spark, d):
    return reports.candidate_notes(fixtures.view(spark, d, "notes"), 1)


def session_options(spark, d):
    return reports.session_options(_sessions(spark, d))


def dashboard(spark, d):
    return reports.dashboard(_sessions(spark, d), _candidates(spark, d))


def processed_count(spark, d):
    return reports.processed_counts(_sessions(spark, d), _candidates(spark, d))


def candidates_with_notes(spark, d):
    return reports.candidates_with_notes(_candidates(spark, d), fixtures.view(spark, d, "notes"))


def status_by_name(spark, d):
    return reports.status_by_name(_candidates(spark, d)).select(
        "id", "session_id", "name", "status", "name_status"
    )


def first_by_name(spark, d):
    return reports.first_by_name(_candidates(spark, d))


# --- text -------------------------------------------------------------------------------------
def contact_info(spark, d):
    text = F.col("raw_text")
    return _resumes(spark, d).select(
        "candidate_id",
        contact.name(text).alias("name"),
        contact.email(text).alias("email"),
        contact.phone(text).alias("phone"),
    )


def contact_info_documents(spark, d):
    text = F.col("text")
    return fixtures.documents(spark, d).select(
        "doc_id",
        contact.name(text).alias("name"),
        contact.email(text).alias("email"),
        contact.phone(text).alias("phone"),
    )


def skills(spark, d):
    return _resumes(spark, d).select(
        "candidate_id", F.array_join(extract_skills(F.col("raw_text")), ", ").alias("skills")
    )


def required(spark, d):
    return _sessions(spark, d).select(
        F.col("id").alias("session_id"),
        F.array_join(required_skills("job_description"), ", ").alias("required_skills"),
    )


def _skill_table(spark):
    return spark.createDataFrame(list(enumerate(ALL_SKILLS)), "pos int, term string")


def lexicon_skills(spark, d):
    """Skills of résumés by a lexicon that is a table: an automaton over each text."""
    table = _skill_table(spark)
    found = lexicon.find_terms(_resumes(spark, d), table, "candidate_id", "raw_text")
    return lexicon.terms_in_order(found, table, "candidate_id", "pos").select("candidate_id", F.array_join("terms", ", ").alias("skills"))


def lexicon_required(spark, d):
    """Skills named anywhere in job descriptions, by joins."""
    table = _skill_table(spark)
    found = lexicon.find_terms(_sessions(spark, d), table, "id", "job_description", how="anywhere", broadcast_limit=0)
    return lexicon.terms_in_order(found, table, "id", "pos").select(
        F.col("id").alias("session_id"), F.array_join("terms", ", ").alias("required_skills")
    )


def lexicon_documents(spark, d):
    """Every two neighbouring words of the benchmark, as a lexicon, in all documents, by joins."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    terms = fixtures.table(spark, d, "benchmark").select(F.explode(pairs).alias("term"))
    return lexicon.find_terms(fixtures.documents(spark, d), terms, "doc_id", "text", broadcast_limit=0)


def skills_by_category(spark, d):
    return reports.skills_by_category(_parsed(spark, d))


def section_items(spark, d):
    s = _resumes(spark, d).select(
        "candidate_id", extract_sections("raw_text", split_headers=False).alias("s")
    )
    return s.select("candidate_id", *[F.array_join(f"s.{c}", " | ").alias(c) for c in SECTIONS])


def split_headers(spark, d):
    return _resumes(spark, d).select("candidate_id", split_merged_headers("raw_text").alias("text"))


def sections_all(spark, d):
    s = _resumes(spark, d).select("candidate_id", extract_sections("raw_text").alias("s"))
    return s.select("candidate_id", *[F.array_join(f"s.{c}", " | ").alias(c) for c in SECTIONS])


def parse_resumes(spark, d):
    return _with_joined_lists(_parsed(spark, d))


def sanitize_text(spark, d):
    return _resumes(spark, d).select("candidate_id", plain_characters(F.col("raw_text")).alias("text"))


def parse_ai_reply(spark, d):
    return relevance.parsed_replies(fixtures.ai_replies(spark, d)).select("candidate_id", "category", "score")


def reading_order(spark, d):
    return layout.reading_order(fixtures.extracted_pages(spark, d))


def reading_order_words(spark, d):
    """Reading order from one row a word and one row a page."""
    pages = fixtures.extracted_pages(spark, d).select("doc_id", F.posexplode_outer("pages").alias("page_no", "page"))
    pages = tables.materialize(pages)
    words = pages.select("doc_id", "page_no", F.posexplode("page.words").alias("word_no", "w")).select(
        "doc_id", "page_no", "word_no", "w.text", "w.x0", "w.x1", "w.top"
    )
    return layout.texts_of_words(words, pages.select("doc_id", "page_no", "page.height"))


def text_fallback(spark, d):
    return layout.extract_texts(fixtures.damaged_pages(spark, d)).withColumnRenamed("doc_id", "candidate_id")


def parse_documents(spark, d):
    """Pages to records: layout, fallback and parse in one plan."""
    known = _resumes(spark, d).select("candidate_id", "session_id", "filename")
    texts = text_fallback(spark, d).withColumnRenamed("text", "raw_text")
    parsed = screening.parse_resumes(texts.join(known, "candidate_id"))
    return _with_joined_lists(parsed)


# --- scores -----------------------------------------------------------------------------------
def _one_score(category):
    def run(spark, d):
        return _sub_scores(spark, d).select("candidate_id", "session_id", f"score_{category}")

    return run


def tfidf_pairwise(spark, d):
    jobs = _sessions(spark, d).select(
        F.col("id").alias("session_id"), term_counts("job_description").alias("job")
    )
    own = _resumes(spark, d).select("candidate_id", "session_id", term_counts("raw_text").alias("own"))
    return lookup_join(own, jobs, "session_id", "candidate_id", "left").select(
        "candidate_id",
        "session_id",
        F.coalesce(pairwise_similarity("job", "own"), F.lit(0.0)).alias("similarity"),
    )


def tfidf_pairwise_documents(spark, d):
    items = fixtures.table(spark, d, "benchmark").select("item_id", term_counts("text").alias("job"))
    # Items are numbered from 0; every document meets the one of its turn.
    docs = fixtures.documents(spark, d).select(
        "doc_id", (F.col("doc_id") % F.lit(items.count())).alias("item_id"), term_counts("text").alias("own")
    )
    return lookup_join(docs, items, "item_id", "doc_id", "left").select(
        "doc_id",
        "item_id",
        F.coalesce(pairwise_similarity("job", "own"), F.lit(0.0)).alias("similarity"),
    )


def tfidf_corpus(spark, d):
    return corpus_similarity(_resumes(spark, d), _sessions(spark, d))


def overall_score(spark, d):
    return _scored(spark, d).select("candidate_id", "session_id", "overall", *screening.WEIGHTS)


def matched_skills(spark, d):
    return _scored(spark, d).select("candidate_id", F.array_join("matched_skills", ", ").alias("matched_skills"))


def missing_skills(spark, d):
    return _scored(spark, d).select("candidate_id", F.array_join("missing_skills", ", ").alias("missing_skills"))


def ai_score_fallback(spark, d):
    s = _sub_scores(spark, d, ai=True)
    return s.select("candidate_id", *[c for c in s.columns if c.startswith("score_")])


def relevance_prompts(spark, d):
    return prompts.relevance_prompts(_parsed(spark, d), _sessions(spark, d))


def _offline_scorer(system_prompt: str, user_prompt: str) -> str:
    """A stand-in for a model: judges by length and fails on some requests."""
    n = len(user_prompt)
    if n % 5 == 0:
        raise RuntimeError("no reply")
    return '```json\n{"score": %d, "reason": "length"}\n```' % (n % 130)


def relevance_with_scorer(spark, d):
    wanted = prompts.relevance_prompts(_parsed(spark, d), _sessions(spark, d))
    return relevance.score_relevance(wanted, _offline_scorer)


def rank_candidates_ai(spark, d):
    """Requests to the model, its scores or the rules, overall score and rank, in one flow."""
    ranked = screening.rank_resumes(
        _resumes(spark, d),
        _sessions(spark, d),
        relevance_with_scorer(spark, d),
        columns=["candidate_id", "session_id", "name", "email", "overall", *screening.WEIGHTS],
    )
    return ranked.select("session_id", "rank", "candidate_id", "name", "email", "overall", *screening.WEIGHTS)


# --- rankings and reports ----------------------------------------------------------------------------
def rank_candidates(spark, d):
    ranked = screening.rank_resumes(
        _resumes(spark, d),
        _sessions(spark, d),
        columns=["candidate_id", "session_id", "name", "email", "overall", *screening.WEIGHTS],
    )
    return ranked.select("session_id", "rank", "candidate_id", "name", "email", "overall", *screening.WEIGHTS)


def _stored_rank(spark, d):
    return ranking.rank_within_sessions(_candidates(spark, d), score="overall_score", id_col="id")


def rank_min_score(spark, d):
    kept = ranking.min_score(_stored_rank(spark, d), 60, "overall_score")
    return kept.select("session_id", "rank", "id", "overall_score")


def score_band(spark, d):
    return _candidates(spark, d).select(
        "id", "overall_score", ranking.score_band(F.col("overall_score")).alias("band")
    )


def top_k_per_session(spark, d):
    return ranking.top_k(_candidates(spark, d), 3, "overall_score", "id").select(
        "session_id", F.col("rank").cast("bigint").alias("rank"), "id", "name", "overall_score"
    )


def rankings_table(spark, d):
    return reports.rankings_table(_ranked_with_status(spark, d))


def column_widths(spark, d):
    return reports.column_widths(_ranked_with_status(spark, d))


def score_unpivot(spark, d):
    return reports.score_unpivot(_scored(spark, d))


def profile_cards(spark, d):
    scored = reports.with_status(_scored(spark, d), _candidates(spark, d))
    return reports.profile_cards(scored)


def compare_scores(spark, d):
    return reports.compare_scores(reports.default_pairs(_scored(spark, d)))


def compare_chosen(spark, d):
    """The oldest candidate of each session against the newest."""
    scored = tables.materialize(_scored(spark, d))
    chosen = scored.groupBy("session_id").agg(F.min("candidate_id").alias("a_id"), F.max("candidate_id").alias("b_id"))
    return reports.compare_scores(reports.pairs(scored, chosen))


def compare_skills(spark, d):
    return reports.compare_skills(reports.default_pairs(_scored(spark, d)))


def report_lines(spark, d):
    return reports.report_lines(_ranked_with_status(spark, d), _sessions(spark, d))


def candidate_context(spark, d):
    # Smaller pieces than a request holds, so that large sessions show how they add up.
    return prompts.candidate_context(_ranked(spark, d), per_piece=200)


def interview_prompts(spark, d):
    return prompts.interview_prompts(_scored(spark, d))


def email_prompts(spark, d):
    return prompts.email_prompts(_candidates(spark, d))


def quick_questions(spark, d):
    return prompts.quick_questions(_sessions(spark, d))


# Smaller pieces than a request holds, so that large sessions are sent in several.
_PIECE = 200


def _system_prompts(spark, d):
    return tables.materialize(prompts.system_prompts(_ranked(spark, d), per_piece=_PIECE))


def chat_messages(spark, d):
    return prompts.chat_messages(fixtures.view(spark, d, "chat"), _system_prompts(spark, d))


def _offline_answerer(messages: list[dict]) -> str:
    """A stand-in for a chat model: tells what it was sent, refuses some requests."""
    if len(messages) % 4 == 0:
        raise RuntimeError("busy")
    return f"{len(messages)} messages, first of {len(messages[0]['content'])} characters, last: {messages[-1]['content']}"


def chat_answers(spark, d):
    """Each question with every piece of its session's ranking, and the answers combined."""
    asked = prompts.chat_questions(fixtures.view(spark, d, "chat"))
    return relevance.answer_rankings(asked, _system_prompts(spark, d), ["conv_id"], _offline_answerer).drop("error")


def _answers(spark, d, asked):
    """Each candidate's prompt with every piece of its session's ranking, and the answers combined."""
    asked, keys = prompts.single_questions(asked, "candidate_id"), ["session_id", "candidate_id", "_row"]
    return relevance.answer_rankings(asked, _system_prompts(spark, d), keys, _offline_answerer).drop("error", "_row")


def email_answers(spark, d):
    return _answers(spark, d, prompts.email_prompts(_candidates(spark, d)))


def interview_answers(spark, d):
    return _answers(spark, d, interview_prompts(spark, d))


def _refuse(*_):
    raise RuntimeError("asked again")


def stored_replies(spark, d):
    """Scores from a reply store: the second run has a model that refuses everything, and gets the first one's replies."""
    kept = ReplyStore(spark, tables.new_folder(spark), "offline")
    wanted = tables.materialize(prompts.relevance_prompts(_parsed(spark, d), _sessions(spark, d)))
    relevance.score_relevance(wanted, _offline_scorer, kept).write.format("noop").mode("overwrite").save()
    return relevance.score_relevance(wanted, _refuse, kept)


# --- driver contract -------------------------------------------------------------------------------------
def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: every résumé parsed, scored and ranked within its session."""
    return rank_candidates(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        scan_resumes, ingest_rejects, parsed_empty, final_jd, session_validation, schema_evolve,
        append_sessions, append_notes, process_sessions, process_candidates, persist_candidates, candidate_json_roundtrip,
        apply_status_updates, delete_cascade_sessions, delete_cascade_candidates,
        delete_cascade_notes, stored_sessions, stored_candidates, stored_notes, stored_status_updates, stored_delete_sessions,
        stored_delete_candidates, stored_delete_notes, stored_session_by_id, stored_candidates_of_session,
        stored_notes_of_candidate, stored_schema_evolve, candidate_json_variant, scan_files, tfidf_corpus_stored, session_by_id, visible_sessions, session_candidates,
        candidate_notes, candidates_of_session, notes_of_candidate, session_options, dashboard, processed_count, candidates_with_notes,
        status_by_name, first_by_name, contact_info, contact_info_documents, lexicon_skills, lexicon_required, lexicon_documents, skills_by_category,
        section_items, split_headers, sections_all, parse_resumes, sanitize_text, parse_ai_reply,
        reading_order, reading_order_words, text_fallback, parse_documents, tfidf_pairwise, tfidf_pairwise_documents, tfidf_corpus,
        overall_score, matched_skills, missing_skills, ai_score_fallback, relevance_prompts,
        relevance_with_scorer, rank_candidates, rank_candidates_ai, rank_min_score, score_band, top_k_per_session,
        rankings_table, column_widths, score_unpivot, profile_cards, compare_scores, compare_chosen,
        compare_skills, report_lines, candidate_context, interview_prompts, email_prompts,
        quick_questions, chat_messages, chat_answers, email_answers, interview_answers, stored_replies,
    ]
    named = {f.__name__: f for f in plain}
    named["extract_skills"] = skills
    named["required_skills"] = required
    named |= {f"score_{c}": _one_score(c) for c in screening.WEIGHTS}
    if llm_queries is not None:
        named |= llm_queries.queries()
    return named


def oracle_sql() -> dict[str, str]:
    from oracle.sql import statements

    named = statements()
    if llm_queries is not None:
        named |= llm_queries.oracle_sql()
    return named
