"""Relevance scores and free-text answers from a model the caller supplies.

The model is a plain Python callable.  It runs on Arrow batches inside tasks; everything
before and after it is built-in expressions.  A ranking in several pieces reaches the model
whole with every request: ``answer_pieces`` sends the request with each piece, and the
answers are combined.  That takes requests x pieces calls.  Where this is too many,
``condensed`` and ``answer_each`` take requests + pieces calls, but the model then sees of
most pieces only what it was condensed to.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import CHAT_APOLOGY, CHAT_SYSTEM_HEAD, CHAT_SYSTEM_TAIL
from hiresift.functions.text import strip
from hiresift.operators.joins import lookup_join
from hiresift.operators.replies import NAME, SCHEMA, ReplyStore, request_name
from hiresift.sources.tables import drop, materialize

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How many partial answers one combining request holds, and how it begins.
ANSWERS_PER_REQUEST = 20
CONDENSE_PROMPT = (
    "Condense this part of the ranking: keep every candidate's rank, name and overall score, "
    "and what sets the strongest and the weakest apart."
)
# How much text of a ranking a task holds if partial answers leave it, and if it makes whole answers (in Python a text may take
# twice its bytes); how many calls share one copy of it at most, and how many make a task, at least about; how much a batch holds.
HELD_BYTES = 32 * 1024 * 1024
WHOLE_BYTES = 96 * 1024 * 1024
CALLS_PER_COPY = 16_000_000
CALLS_PER_TASK = 1_000_000
MOST_TASKS = 10_000
BATCH_BYTES = 16 * 1024 * 1024
COMBINE_HEAD = "Each partial answer below was given from a part of the candidates. Make one answer of them.\nQuestion: "

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def reply_score(reply: Column) -> Column:
    """Score in a model's reply, clamped to 0-100; NULL for anything unusable.

    The reply must be one JSON object with a numeric (or numeric text) ``score``,
    optionally inside code fences.
    """
    bare = F.replace(F.replace(strip(reply), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    bare = strip(bare)
    # As the one element of a list, anything after the object is an error; of repeated keys the last holds.
    listed = F.concat(F.lit("["), F.when(bare.rlike(r"(?s)^\{.*\}\z"), bare), F.lit("]"))
    parsed = F.from_json(listed, "array<struct<score:string>>", {"allowSingleQuotes": "false"})
    value = strip(F.when(F.size(parsed) == 1, F.get(parsed, 0)["score"]))
    number = F.when(value.rlike(_NUMBER), value).try_cast("double")
    # ``greatest`` skips NULLs, so an unusable reply must be kept apart from a low one.
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(100.0)))


def ask_model(
    prompts: DataFrame, scorer: Callable[[str, str], str | None], replies: ReplyStore | None = None
) -> DataFrame:
    """Add ``raw_reply``: ``scorer(system_prompt, user_prompt)`` per row, NULL if it fails.

    With a reply store, requests that it knows are not sent, and the others are stored.
    """
    if replies is not None:
        attempts = replies.attempts
        asked = prompts.select(
            "candidate_id", "category", "system_prompt", "user_prompt",
            request_name(replies.model, F.col("system_prompt"), F.col("user_prompt")).alias(NAME),
        )
        one = lambda r: _tried(lambda: scorer(r.system_prompt, r.user_prompt), attempts)
        told = replies.answered(asked, F.struct("candidate_id", "category"), lambda part: _called(part, one))
        return told.select("candidate_id", "category", F.col("reply").alias("raw_reply"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [_tried(lambda s=s, u=u: scorer(s, u), 1)[0] for s, u in zip(frame["system_prompt"], frame["user_prompt"])]
            yield frame[["candidate_id", "category"]].assign(raw_reply=told)

    return prompts.select("candidate_id", "category", "system_prompt", "user_prompt").mapInPandas(
        batches, "candidate_id bigint, category string, raw_reply string"
    )


def _tried(call: Callable[[], str | None], attempts: int) -> tuple[str | None, str | None, int]:
    """(reply, last error, attempts made) of a call that is repeated while it fails."""
    error = None
    for attempt in range(1, attempts + 1):
        try:
            return call(), None, attempt
        except Exception as failed:
            error = str(failed)
    return None, error, attempts


def _called(requests: DataFrame, one: Callable) -> DataFrame:
    """Rows of a reply store: ``one`` gives (reply, error, attempts) for a row of ``requests``."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [(getattr(r, NAME), *one(r)) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(told, columns=[NAME, "reply", "error", "attempts"])

    return requests.mapInPandas(batches, SCHEMA)


def score_relevance(
    prompts: DataFrame, scorer: Callable[[str, str], str | None], replies: ReplyStore | None = None
) -> DataFrame:
    """``(candidate_id, category, score)``; rows whose reply is unusable are left out,
    so that scoring falls back to the rules for them."""
    return (
        ask_model(prompts, scorer, replies)
        .select("candidate_id", "category", reply_score(F.col("raw_reply")).alias("score"))
        .where(F.col("score").isNotNull())
    )


def parsed_replies(replies: DataFrame) -> DataFrame:
    """``(candidate_id, category, raw_reply)`` with ``score``."""
    return replies.withColumn("score", reply_score(F.col("raw_reply")))


Answerer = Callable[[list[dict]], str]


def _spoken(answerer: Answerer, messages: list[dict]) -> tuple[str, str | None]:
    """The answer, and the error if the model failed; only then is the answer the apology."""
    try:
        return answerer(messages), None
    except Exception as failed:
        error = str(failed)
        return f"{CHAT_APOLOGY}{error}", error


def _answer_or_apology() -> list[Column]:
    apology = F.concat(F.lit(CHAT_APOLOGY), F.col("error"))
    return [F.when(F.col("error").isNotNull(), apology).otherwise(F.col("reply")).alias("answer"), F.col("error")]


def _message_list(messages: Iterable) -> list[dict]:
    return [{"role": m["role"], "content": m["content"]} for m in messages]


def answer(requests: DataFrame, answerer: Answerer, replies: ReplyStore | None = None) -> DataFrame:
    """Replace ``messages ARRAY<STRUCT<role, content>>`` by ``answer`` and ``error`` (NULL if all went well).

    With a reply store, requests that it knows are not sent, and the others are stored.
    """
    key_fields = [f for f in requests.schema.fields if f.name != "messages"]
    keys = [f.name for f in key_fields]
    if replies is not None:
        attempts = replies.attempts
        asked = requests.withColumn(NAME, request_name(replies.model, F.col("messages")))
        one = lambda r: _tried(lambda: answerer(_message_list(r.messages)), attempts)
        told = replies.answered(asked, F.struct(*keys), lambda part: _called(part.select(NAME, "messages"), one))
        return told.select(*keys, *_answer_or_apology())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", answer string, error string"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [_spoken(answerer, _message_list(ms)) for ms in frame["messages"]]
            yield frame[keys].assign(answer=[a for a, _ in told], error=[e for _, e in told])

    return requests.mapInPandas(batches, schema)


def condensed(
    session_prompts: DataFrame, answerer: Answerer, fan_in: int = ANSWERS_PER_REQUEST, replies: ReplyStore | None = None
) -> DataFrame:
    """``(session_id, digest)`` for each session whose ranking has several pieces.

    Every piece of ``session_prompts(session_id, piece_no, system_prompt)`` is condensed once;
    the parts are combined ``fan_in`` at a time until one is left.
    """
    several = session_prompts.where("piece_no > 0").select("session_id").distinct()
    asked = session_prompts.join(several, "session_id", "left_semi").select(
        "session_id", F.col("piece_no").alias("part_no"), F.lit(CONDENSE_PROMPT).alias("question"),
        F.array(_message("system", F.col("system_prompt")), _message("user", F.lit(CONDENSE_PROMPT))).alias("messages"),
    )
    whole = combined(answer(asked, answerer, replies), ["session_id"], answerer, fan_in, replies)
    return whole.select("session_id", F.col("answer").alias("digest"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def answer_each(
    prompts: DataFrame, places: DataFrame, session_prompts: DataFrame, key: str, answerer: Answerer, replies: ReplyStore | None = None
) -> DataFrame:
    """One answer to each of ``prompts(session_id, key, prompt)``: ``session_id, key, answer, error``.

    A prompt is sent with one system text of ``session_prompts(session_id, piece_no, system_prompt)``:
    that of the piece which ``places(key, piece_no)`` names, or, for a key without a place, of one
    picked by its hash; so every text has a bounded number of prompts, apart from keys that repeat.
    The texts are not copied into the rows: a task gets a text once, ahead of the prompts that go
    with it, and holds one at a time.  Prompts without a session, or of one without pieces, are
    sent with the system text of an empty ranking.  With a reply store, requests that it knows are
    not sent, and the others are stored.
    """
    texts = session_prompts.select("session_id", "piece_no", "system_prompt", F.sha2("system_prompt", 256).alias("system_sha256"))
    numbers = texts.groupBy("session_id").agg(F.max("piece_no").alias("_last"))
    placed = lookup_join(prompts.select("session_id", key, "prompt"), numbers, "session_id", key, "left")
    placed = placed.join(places.select(key, F.col("piece_no").alias("_own")), key, "left")
    picked = F.coalesce("_own", F.pmod(F.xxhash64(key), F.col("_last") + 1))
    nothing = F.lit(f"{CHAT_SYSTEM_HEAD}{CHAT_SYSTEM_TAIL}")
    placed = placed.select("session_id", key, "prompt", F.when(F.col("_last").isNotNull(), picked).alias("piece_no"))

    known = placed.where("piece_no is not null")
    alone = placed.where("piece_no is null").select(
        F.col("session_id").cast("string"), key, F.array(_message("system", nothing), _message("user", F.col("prompt"))).alias("messages"),
    )  # a null would make numbers floats
    own, kind = (prompts.schema[c].dataType.simpleString() for c in ("session_id", key))
    rest = answer(alone, answerer, replies).select(F.col("session_id").cast(own), key, "answer", "error")

    def streamed(asked: DataFrame, columns: list[str], schema: str, attempts: int) -> DataFrame:
        """Rows of ``columns`` and (reply, error, attempts), each text ahead of its prompts."""
        by = ["session_id", "piece_no"]
        stream = texts.drop("system_sha256").unionByName(asked, allowMissingColumns=True).repartition(*by)
        stream = stream.sortWithinPartitions(*by, F.col("system_prompt").isNull())

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            system = None
            for frame in frames:
                rows = []
                for r in frame.itertuples(index=False):
                    if r.system_prompt is not None and r.system_prompt == r.system_prompt:
                        system = r.system_prompt
                        continue
                    sent = [{"role": "system", "content": system}, {"role": "user", "content": r.prompt}]
                    rows.append((*(getattr(r, c) for c in columns), *_tried(lambda sent=sent: answerer(sent), attempts)))
                yield pd.DataFrame(rows, columns=[*columns, "reply", "error", "attempts"])

        return stream.select(*by, *[c for c in columns if c not in by], "prompt", "system_prompt").mapInPandas(batches, schema)

    if replies is None:
        schema = f"session_id {own}, {key} {kind}, reply string, error string, attempts int"
        told = streamed(known, ["session_id", key], schema, 1)
    else:
        shas = texts.select("session_id", "piece_no", "system_sha256")
        named = lookup_join(known, shas, ["session_id", "piece_no"], key).withColumn(
            NAME, request_name(replies.model, F.col("system_sha256"), F.col("prompt"))
        ).drop("system_sha256")
        told = replies.answered(named, key, lambda part: streamed(part.drop(key), [NAME], SCHEMA, replies.attempts))
    return told.select("session_id", key, *_answer_or_apology()).unionByName(rest)


def answer_pieces(
    requests: DataFrame, session_prompts: DataFrame, answerer: Answerer, fan_in: int = ANSWERS_PER_REQUEST,
    held_bytes: int = HELD_BYTES, calls_per_copy: int = CALLS_PER_COPY,
) -> DataFrame:
    """Every request with every piece of its session's ranking: ``requests`` with ``part_no``, ``answer`` and ``error``.

    ``requests(session_id, question, messages, stretch, stretches, ...)`` hold what follows the system text;
    ``stretch`` counts the requests that share a question, from 0.  The texts of
    ``session_prompts(session_id, piece_no, system_prompt)`` are not copied into the rows: a task holds up to
    ``held_bytes`` of one session (``fan_in`` pieces at least) and streams the requests past.  The first round of
    combining is done there too, so what leaves is one answer for ``fan_in`` pieces; ``combined`` does the
    others.  Requests without a session, or of one without pieces, are sent with the system text of an empty
    ranking.  Pieces without a number, those of candidates without rank, are not sent.  ``messages`` is left out.
    """
    return _streamed(materialize(requests), _packed(session_prompts), answerer, fan_in, held_bytes, calls_per_copy)


def answer_rankings(
    requests: DataFrame, session_prompts: DataFrame, keys: list[str], answerer: Answerer, fan_in: int = ANSWERS_PER_REQUEST,
    whole_bytes: int = WHOLE_BYTES, calls_per_copy: int = CALLS_PER_COPY,
) -> DataFrame:
    """One answer to each question, from every piece of its session's ranking: ``keys, answer, error``.

    It is what ``combined`` makes of ``answer_pieces``.  Where the ranking's text has up to ``whole_bytes``, a task
    holds all of it and does all rounds of combining, so that partial answers, which may be long, are never stored
    or shuffled.  Larger rankings, and questions that need several requests, go the other way; their
    partial answers meet on ``keys``.
    """
    requests, pieces = materialize(requests), _packed(session_prompts)
    large = pieces.groupBy("session_id").agg(F.sum("_b").alias("_b")).where(F.col("_b") > whole_bytes).select("session_id", F.lit(True).alias("_large"))
    told = lookup_join(requests, large, "session_id", F.xxhash64(*keys), "left")
    told = told.withColumn("_large", F.coalesce("_large", F.lit(False)) | (F.col("stretches") > 1))
    if told.where("_large").isEmpty():
        return _streamed(requests, pieces, answerer, fan_in, None, calls_per_copy, keys)
    parts = _streamed(materialize(told.where("_large").drop("_large")), pieces, answerer, fan_in, HELD_BYTES, calls_per_copy)
    rest = materialize(told.where("not _large").drop("_large"))
    return _streamed(rest, pieces, answerer, fan_in, None, calls_per_copy, keys).unionByName(
        combined(parts.select(*keys, "part_no", "question", "answer", "error"), keys, answerer, fan_in)
    )


def _packed(session_prompts: DataFrame) -> DataFrame:
    """``(session_id, piece_no, packed, _b)``: the texts of numbered pieces, compressed, and their sizes.

    A ranking's lines are much alike.  Compressed, its copies for many tasks take little room on disk and in the
    batches that go to Python.
    """
    pieces = session_prompts.where("session_id is not null and piece_no is not null")
    pieces = pieces.select("session_id", "piece_no", "system_prompt", F.coalesce(F.octet_length("system_prompt"), F.lit(0)).cast("bigint").alias("_b"))
    tasks = _tasks(pieces, pieces.agg(F.sum("_b").alias("b")).first()["b"] or 0, BATCH_BYTES)
    kinds = [pieces.schema[c].dataType.simpleString() for c in ("session_id", "piece_no")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("system_prompt")]
            small = pa.array([None if t is None else zlib.compress(t.encode(), 1) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("session_id"), batch.column("piece_no"), small, batch.column("_b")], names=["session_id", "piece_no", "packed", "_b"]
            )

    schema = f"session_id {kinds[0]}, piece_no {kinds[1]}, packed binary, _b bigint"
    return materialize(pieces.repartition(tasks, "session_id", "piece_no").mapInArrow(packed, schema))


def _tasks(df: DataFrame, work: int, each: int) -> int:
    return min(max(math.ceil(work / each), df.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)


def _streamed(
    requests: DataFrame, pieces: DataFrame, answerer: Answerer, fan_in: int, held_bytes: int | None, calls_per_copy: int,
    keys: list[str] | None = None,
) -> DataFrame:
    """``answer_pieces`` with the texts of ``_packed``; with ``keys``, whole rankings are held and all rounds done."""
    whole = keys is not None
    sized = pieces.groupBy("session_id").agg((F.max("piece_no") + 1).alias("_pieces"), F.max("_b").alias("_b"))
    said = F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(F.octet_length(m["content"]), F.lit(0)))
    asking = requests.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(said).alias("_said"))
    sizes = materialize(sized.join(asking, "session_id"))
    calls, text = sizes.agg(F.sum(F.col("_pieces") * F.col("_n")), F.sum("_said")).first()
    calls, text = calls or 0, text or 0
    tasks = max(_tasks(requests, calls, CALLS_PER_TASK), _tasks(requests, text, BATCH_BYTES))
    # A copy of the texts costs little beside the calls that share it, but all cores should have some.
    shared = min(calls_per_copy, max(_ceil(calls, 2 * requests.sparkSession.sparkContext.defaultParallelism), CALLS_PER_TASK))
    held = F.col("_pieces") if whole else fan_in * F.greatest(F.floor(F.lit(held_bytes) / (fan_in * F.greatest("_b", F.lit(1)))), F.lit(1))
    copies = F.greatest(F.ceil(F.col("_n") * F.least("_pieces", "_held") / shared), F.ceil(F.col("_said") / BATCH_BYTES), F.lit(1)).cast("int")
    sizes = sizes.withColumn("_held", held).withColumn("_copies", copies).select("session_id", "_pieces", "_held", "_copies")

    texts = lookup_join(pieces.drop("_b"), sizes, "session_id", F.xxhash64("session_id", "piece_no")).select(
        "session_id", F.floor(F.col("piece_no") / F.col("_held")).alias("_cell"),
        F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"), "piece_no", "packed",
    )
    cells = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_pieces") - 1) / F.col("_held")))).alias("_cell")
    spread = F.xxhash64(*[c for c in requests.columns if c not in ("question", "messages")])
    asked = lookup_join(requests, sizes.select("session_id", cells, "_copies"), "session_id", spread, "left")
    asked = asked.withColumn("_copy", F.pmod(spread, F.col("_copies")).cast("int")).drop("_copies")

    alone = asked.where("_cell is null").drop("_cell", "_copy")
    nothing = _message("system", F.lit(f"{CHAT_SYSTEM_HEAD}{CHAT_SYSTEM_TAIL}"))
    alone = alone.withColumn("messages", F.concat(F.array(nothing), "messages")).withColumn("part_no", F.col("stretch").cast("bigint"))
    kept = [f for f in requests.schema.fields if (f.name in keys if whole else f.name not in ("messages", "stretch", "stretches"))]
    names, numbers = [f.name for f in kept], ["_cell", "_copy", "piece_no"]
    made = ["answer", "error"] if whole else ["part_no", "answer", "error"]
    kinds = [pa.int64(), pa.string(), pa.string()][-len(made) :]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{m} {'bigint' if m == 'part_no' else 'string'}" for m in made)])

    def said_by(batches: Iterator[pa.RecordBatch], told: Callable) -> Iterator[pa.RecordBatch]:
        """A row for each tuple of ``made`` that ``told`` gives for a row of its batch, in batches of bounded size."""
        for batch in batches:
            rows = max(1, min(64, BATCH_BYTES // 4 * batch.num_rows // max(batch.nbytes, 1)))
            for begin in range(0, batch.num_rows, rows):
                some = batch.slice(begin, rows)
                at, given, size = [], [], 0
                for i, row in enumerate(some.to_pylist()):
                    for g in told(row):
                        at.append(i)
                        given.append(g)
                        size += len(g[-2] or "")
                    if size > BATCH_BYTES // 4:
                        yield rows_of(some, at, given)
                        at, given, size = [], [], 0
                yield rows_of(some, at, given)

    def rows_of(batch: pa.RecordBatch, at: list[int], given: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([g[k] for g in given], kind) for k, kind in enumerate(kinds)]
        took = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([*(batch.column(n).take(took) for n in names), *columns], names=[*names, *made])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, groups = None, {}

        def told(row: dict) -> list[tuple]:
            nonlocal cell, groups
            own = (row["session_id"], row["_cell"], row["_copy"])
            if row["piece_no"] is not None:
                if own != cell:
                    cell, groups = own, {}
                text = None if row["packed"] is None else zlib.decompress(row["packed"]).decode()
                groups.setdefault(row["piece_no"] // fan_in, []).append({"role": "system", "content": text})
                return []
            if own != cell:
                return []
            messages, question = row["messages"], row["question"]
            answers = {g: together(question, [_spoken(answerer, [s, *messages]) for s in systems]) for g, systems in groups.items()}
            if not whole:
                return [(g * row["stretches"] + row["stretch"], *a) for g, a in answers.items()]
            while any(answers):
                rounds: dict[int, list] = {}
                for g, a in answers.items():
                    rounds.setdefault(g // fan_in, []).append(a)
                answers = {g: together(question, a) for g, a in rounds.items()}
            return [answers[0]]

        return said_by(batches, told)

    def together(question: str | None, answers: list[tuple]) -> tuple[str | None, str | None]:
        if len(answers) == 1:
            return answers[0]
        listed = "\n\n".join(a for a, _ in answers if a is not None)
        text = None if question is None else f"{COMBINE_HEAD}{question}\n\n{listed}"
        return _spoken(answerer, [{"role": "user", "content": text}])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (lambda row: ()) if whole else (lambda row: (row["part_no"],))
        return said_by(batches, lambda row: [(*number(row), *_spoken(answerer, row["messages"]))])

    by = ["session_id", "_cell", "_copy"]
    stream = texts.unionByName(asked.where("_cell is not null"), allowMissingColumns=True)
    stream = stream.repartition(tasks, *by).sortWithinPartitions(*by, F.col("piece_no").isNull(), "piece_no")
    columns = list(dict.fromkeys([*names, "session_id", "question", "messages", "stretch", "stretches", *numbers, "packed"]))
    told = stream.select(*columns).mapInArrow(streamed, schema)
    return told.unionByName(alone.select(*names, "messages", "part_no").mapInArrow(single, schema))


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def combined(
    parts: DataFrame, keys: list[str], answerer: Answerer, fan_in: int = ANSWERS_PER_REQUEST, replies: ReplyStore | None = None
) -> DataFrame:
    """One answer per key from ``parts(keys, part_no, question, answer, error)``.

    ``fan_in`` partial answers at a time go back to the model, in rounds, until one is left;
    a key with one part keeps its answer.  ``part_no`` counts from 0 within a key.
    """
    parts = materialize(parts)
    while parts.where("part_no > 0").limit(1).count():
        group = F.floor(F.col("part_no") / fan_in).alias("part_no")
        grouped = parts.groupBy(*keys, group).agg(
            F.first("question").alias("question"),
            F.array_sort(F.collect_list(F.struct(F.col("part_no").alias("n"), "answer", "error"))).alias("_parts"),
        )
        alone = F.size("_parts") == 1
        text = F.concat(
            F.lit(COMBINE_HEAD), F.col("question"), F.lit("\n\n"),
            F.array_join(F.transform("_parts", lambda x: x["answer"]), "\n\n"),
        )
        asked = grouped.where(~alone).select(
            *keys, "part_no", "question",
            F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"),
        )
        first = F.get("_parts", 0)
        kept = grouped.where(alone).select(
            *keys, "part_no", "question", first["answer"].alias("answer"), first["error"].alias("error")
        )
        before, parts = parts, materialize(kept.unionByName(answer(asked, answerer, replies)))
        if hasattr(parts, "stored_at"):  # else it is not computed yet
            drop(before)
    return parts.select(*keys, "answer", "error")
