"""Texts of the requests sent to a language model, for all sessions at once."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import (
    AI_CATEGORIES,
    CHAT_SYSTEM_HEAD,
    CHAT_SYSTEM_TAIL,
    EMAIL_PROMPTS,
    INTERVIEW_PROMPT,
    QUICK_QUESTIONS,
    RELEVANCE_SYSTEM,
    RELEVANCE_USER,
)
from hiresift.functions.text import bullet_text, joined_or
from hiresift.operators.joins import lookup_join, rows_per_key
from hiresift.plans.reports import CATEGORIES, percent_text
from hiresift.sources.tables import materialize

# About what fits in one request to a model with a 128k-token window.  Larger sessions and
# longer conversations are sent whole, in several requests whose answers are combined.
CANDIDATES_PER_PIECE = 1000
MESSAGES_PER_REQUEST = 1000

# How many conversations one copy of a system text meets, how much text lies beside it (three such shelves, should a task get them,
# fit in a Parquet dictionary of 1 MB), and how much of a chat's messages one task writes, at most and at least about.
CONVERSATIONS_PER_TEXT = 5_000
SHELF_BYTES = 336 * 1024
BYTES_PER_TASK = 1024 * 1024 * 1024
LEAST_PER_TASK = 8 * 1024 * 1024
MOST_TASKS = 10_000


def filled(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places taken by columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


# --- relevance ------------------------------------------------------------------------------
def relevance_prompts(parsed: DataFrame, sessions: DataFrame, **options) -> DataFrame:
    """System and user prompt per candidate and category that has items to judge."""
    jobs = sessions.select(
        F.col("id").alias("session_id"), F.coalesce("job_description", F.lit("")).alias("job_description")
    )
    wanted = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(category).alias("category"),
                    F.lit(RELEVANCE_SYSTEM.replace("{item_type}", item_type)).alias("system_prompt"),
                    F.lit(item_type).alias("item_type"),
                    F.col(category).alias("items"),
                )
                for category, item_type in AI_CATEGORIES.items()
            ]
        )
    )
    rows = parsed.select("candidate_id", "session_id", wanted).where(F.size("items") > 0)
    # Counting résumés instead of their items spares a second parse; it only sets the split.
    sizes = rows_per_key(parsed, ["session_id"])
    joined = lookup_join(rows, jobs, "session_id", "candidate_id", sizes=sizes, **options)
    return joined.where((F.col("category") != "skills") | (F.length("job_description") > 0)).select(
        "candidate_id",
        "category",
        "system_prompt",
        filled(
            RELEVANCE_USER,
            job_description=F.col("job_description"),
            item_type=F.col("item_type"),
            items=bullet_text(F.col("items")),
        ).alias("user_prompt"),
    )


# --- ranking context ----------------------------------------------------------------------------
def _context_part() -> Column:
    lines = [F.concat(F.lit("Rank "), F.col("rank").cast("string"), F.lit(": "), F.col("name"),
                      F.lit(" — Overall Score: "), percent_text(F.col("overall")))]
    lines += [F.concat(F.lit(f"  {c.capitalize()} Match: "), percent_text(F.col(c))) for c in CATEGORIES]
    lines += [
        F.concat(F.lit(f"  {c.capitalize()} Skills: "), joined_or(F.col(f"{c}_skills"), "None"))
        for c in ("matched", "missing")
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def _piece(per_piece: int) -> Column:
    return F.floor((F.col("rank") - 1) / per_piece).cast("bigint")


def candidate_context(ranked: DataFrame, per_piece: int = CANDIDATES_PER_PIECE) -> DataFrame:
    """The ranking of a session as text, in pieces of ``per_piece`` candidates.

    A small session is one piece.  The text of a larger one is its pieces in order,
    joined by a line break; no session is ever gathered into one value.
    """
    return (
        ranked.select("session_id", "rank", _piece(per_piece).alias("piece_no"), _context_part().alias("part"))
        .groupBy("session_id", "piece_no")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("parts"))
        .select(
            "session_id",
            "piece_no",
            F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("context"),
        )
    )


def _system_text(context: Column) -> Column:
    return F.concat(F.lit(CHAT_SYSTEM_HEAD), context, F.lit(CHAT_SYSTEM_TAIL))


def system_prompts(ranked: DataFrame, per_piece: int = CANDIDATES_PER_PIECE) -> DataFrame:
    """System prompts ``(session_id, piece_no, system_prompt)``: one for each piece of a session's ranking."""
    return as_system_prompts(candidate_context(ranked, per_piece))


def as_system_prompts(contexts: DataFrame) -> DataFrame:
    return contexts.select("session_id", "piece_no", _system_text(F.col("context")).alias("system_prompt"))


def whole_prompts(contexts: DataFrame, digests: DataFrame) -> DataFrame:
    """One system prompt per session: its ranking if that is one piece, else what it was condensed to."""
    first = contexts.where("piece_no = 0").join(digests, "session_id", "left")
    return first.select("session_id", "piece_no", _system_text(F.coalesce("digest", "context")).alias("system_prompt"))


def own_prompts(contexts: DataFrame, digests: DataFrame) -> DataFrame:
    """A system prompt for each piece: the piece itself, after the condensed ranking if there are several."""
    both = lookup_join(contexts, digests, "session_id", "piece_no", "left")
    text = F.concat_ws("\n\n", "digest", "context")
    return both.select("session_id", "piece_no", _system_text(text).alias("system_prompt"))


def places(ranked: DataFrame, per_piece: int = CANDIDATES_PER_PIECE) -> DataFrame:
    """In which piece of its session's ranking each candidate stands."""
    return ranked.select("candidate_id", _piece(per_piece).alias("piece_no"))


# --- chat --------------------------------------------------------------------------------------------
def chat_messages(chat: DataFrame, prompts: DataFrame, **options) -> DataFrame:
    """Message list of each conversation's latest question, one row per message.

    Read in (part, turn) order: 0 the system prompt, one row for each piece of the
    session's ranking, 1 the turns before the question, 2 the question itself, which is
    not repeated in the history.  Turns after the question are not sent.  Without
    candidates the system prompt has an empty ranking.
    """
    said = _turns(chat, **options).select(
        "conv_id", "part", F.lit(None).cast("bigint").alias("piece_no"), "turn", "role", "content"
    )
    system = _beside_texts(_asking(chat), prompts, **options).select(
        "conv_id",
        F.lit(0).alias("part"),
        F.coalesce("piece_no", F.lit(0)).cast("bigint").alias("piece_no"),
        F.lit(-1).cast("bigint").alias("turn"),
        F.lit("system").alias("role"),
        F.coalesce("system_prompt", _system_text(F.lit(""))).alias("content"),
    )
    return system.unionByName(said)


def _questions(chat: DataFrame) -> DataFrame:
    return chat.where(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("_asked"))


def _turns(chat: DataFrame, **options) -> DataFrame:
    """Turns up to each conversation's latest question, as ``part`` 1, and that question, as ``part`` 2."""
    row_key = F.xxhash64("conv_id", "turn")
    return (
        lookup_join(chat.where(F.col("role") != "system"), _questions(chat), "conv_id", row_key, **options)
        .where(F.col("turn") <= F.col("_asked"))
        .select(
            "conv_id",
            F.when(F.col("turn") == F.col("_asked"), 2).otherwise(1).alias("part"),
            "turn",
            "role",
            F.col("text").alias("content"),
        )
    )


def _asking(chat: DataFrame) -> DataFrame:
    """``(conv_id, session_id)`` of the conversations with a question."""
    return chat.groupBy("conv_id").agg(F.min("session_id").alias("session_id")).join(
        _questions(chat).select("conv_id"), "conv_id", "left_semi"
    )


def _beside_texts(conversations: DataFrame, prompts: DataFrame, **options) -> DataFrame:
    """``(conv_id, piece_no, system_prompt)``: every conversation with every piece of its session's ranking, or with nulls.

    Which texts a conversation meets is found without them.  Neighbouring texts of up to ``SHELF_BYTES`` then go to one task
    for each ``CONVERSATIONS_PER_TEXT`` conversations, and every conversation has them one after the other: a file in a
    columnar format holds each of them about once however many rows name it, as they fit in its dictionary.  Since
    neighbouring rows differ, a writer that keeps the least and the greatest value need not compare long equal texts to
    the end for each row, which took half of the time.
    """
    conversations = materialize(conversations)
    pieces = prompts.select("session_id", F.coalesce("piece_no", F.lit(-1)).alias("_piece"), "piece_no", "system_prompt")
    sized = pieces.groupBy("session_id").agg(F.max(F.octet_length("system_prompt")).alias("_b"))
    counts = rows_per_key(conversations.where("session_id is not null"), ["session_id"]).join(sized, "session_id").select(
        "session_id", "_n", F.ceil(F.col("_n") / CONVERSATIONS_PER_TEXT).cast("int").alias("_salts"),
        F.greatest(F.floor(F.lit(SHELF_BYTES) / F.greatest("_b", F.lit(1))), F.lit(1)).alias("_beside"),
    )
    texts = lookup_join(pieces, counts, "session_id", F.xxhash64("session_id", "_piece"), **options)
    shelves = materialize(
        texts.groupBy("session_id", F.floor(F.col("_piece") / F.col("_beside")).alias("_shelf"), "_salts").agg(
            F.array_sort(F.collect_list(F.struct("piece_no", "system_prompt"))).alias("_texts"),
            F.sum(F.octet_length("system_prompt") * F.col("_n")).alias("_written"), F.sum(F.octet_length("system_prompt") * F.col("_salts")).alias("_copied"),
        )
    )
    met = lookup_join(conversations, shelves.select("session_id", "_shelf", "_salts"), "session_id", "conv_id", "left", **options).select(
        "session_id", "_shelf", F.pmod(F.xxhash64("conv_id"), F.col("_salts")).cast("int").alias("_salt"), "conv_id"
    )
    # The rows to write, not those to shuffle, set the number of tasks; where texts repeat much, hardly a task gets four shelves.
    written, copied = (b or 0 for b in shelves.agg(F.sum("_written"), F.sum("_copied")).first())
    apart = min(math.ceil(4 * copied / SHELF_BYTES), math.ceil(written / LEAST_PER_TASK))
    tasks = min(max(math.ceil(written / BYTES_PER_TASK), apart, prompts.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
    by = ["session_id", "_shelf", "_salt"]
    copies = shelves.select("session_id", "_shelf", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "_texts")
    beside = met.repartition(tasks, *by).join(copies.repartition(tasks, *by).hint("merge"), by, "left")
    return beside.select("conv_id", F.inline_outer("_texts"))


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def chat_requests(messages: DataFrame, max_messages: int = MESSAGES_PER_REQUEST) -> DataFrame:
    """Requests ``(conv_id, part_no, question, messages)``: every piece with every stretch of history.

    A stretch has ``max_messages`` turns at most, so no conversation is gathered whole.
    One piece and a short history make the one request of the plain case.
    """
    asked = messages.where("part = 2").groupBy("conv_id").agg(F.first("content").alias("question"))
    system = messages.where("part = 0").select("conv_id", "piece_no", F.col("content").alias("_system"))
    every = system.join(asked, "conv_id").join(_stretches(messages, max_messages), "conv_id", "left")
    sent = F.concat(F.array(_message(F.lit("system"), F.col("_system"))), _said_and_asked())
    number = F.coalesce(F.col("piece_no") * F.col("_stretches") + F.col("_stretch"), F.col("piece_no"))
    return every.select("conv_id", number.cast("bigint").alias("part_no"), "question", sent.alias("messages"))


def _stretches(messages: DataFrame, max_messages: int) -> DataFrame:
    """``(conv_id, _stretch, _stretches, _said)``: the history of each conversation, ``max_messages`` turns at most in a row."""
    said = messages.where("part = 1").select("conv_id", "turn", "role", "content")
    begins = said.groupBy("conv_id").agg(F.min("turn").alias("_begin"), F.max("turn").alias("_end"))
    stretch = F.floor((F.col("turn") - F.col("_begin")) / max_messages)
    stretches = F.floor((F.col("_end") - F.col("_begin")) / max_messages) + 1
    return (
        lookup_join(said, begins, "conv_id", F.xxhash64("conv_id", "turn"))
        .groupBy("conv_id", stretch.alias("_stretch"), stretches.alias("_stretches"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_said"))
        .withColumn("_said", F.transform("_said", lambda m: _message(m["role"], m["content"])))
    )


def _said_and_asked() -> Column:
    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.coalesce("_said", none), F.array(_message(F.lit("user"), F.col("question"))))


def chat_questions(chat: DataFrame, max_messages: int = MESSAGES_PER_REQUEST) -> DataFrame:
    """What follows the system text in ``chat_requests``: ``(session_id, conv_id, question, messages, stretch, stretches)``.

    Each conversation's latest question with every stretch of its history; no text of a ranking is in it.
    """
    turns = materialize(_turns(chat))
    asked = turns.where("part = 2").groupBy("conv_id").agg(F.first("content").alias("question"))
    every = _asking(chat).join(asked, "conv_id").join(_stretches(turns, max_messages), "conv_id", "left")
    return every.select(
        "session_id", "conv_id", "question", _said_and_asked().alias("messages"),
        F.coalesce("_stretch", F.lit(0)).cast("bigint").alias("stretch"), F.coalesce("_stretches", F.lit(1)).cast("bigint").alias("stretches"),
    )


def single_questions(asked: DataFrame, key: str) -> DataFrame:
    """Prompts ``(session_id, key, prompt)`` as requests without a history, each with a ``_row`` of its own: keys may repeat."""
    return asked.select(
        "session_id", key, F.monotonically_increasing_id().alias("_row"), F.col("prompt").alias("question"),
        F.array(_message(F.lit("user"), F.col("prompt"))).alias("messages"),
        F.lit(0).cast("bigint").alias("stretch"), F.lit(1).cast("bigint").alias("stretches"),
    )


# --- other requests ---------------------------------------------------------------------------------
def interview_prompts(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "session_id",
        "candidate_id",
        filled(
            INTERVIEW_PROMPT,
            name=F.col("name"),
            matched=joined_or(F.col("matched_skills"), "none"),
            missing=joined_or(F.col("missing_skills"), "none"),
        ).alias("prompt"),
    )


def email_prompts(candidates: DataFrame) -> DataFrame:
    """Request for an e-mail that suits the candidate's status."""
    text = None
    for status, template in EMAIL_PROMPTS.items():
        if status is not None:
            hit, body = F.col("status") == status, filled(template, name=F.col("name"))
            text = F.when(hit, body) if text is None else text.when(hit, body)
    text = text.otherwise(filled(EMAIL_PROMPTS[None], name=F.col("name")))
    return candidates.select("session_id", F.col("id").alias("candidate_id"), "status", text.alias("prompt"))


def quick_questions(sessions: DataFrame) -> DataFrame:
    """The four ready-made questions for every session."""
    rows = F.inline(
        F.array(
            *[
                F.struct(F.lit(label).alias("label"), F.lit(prompt).alias("prompt"))
                for label, prompt in QUICK_QUESTIONS.items()
            ]
        )
    )
    return sessions.select(F.col("id").alias("session_id"), rows)
