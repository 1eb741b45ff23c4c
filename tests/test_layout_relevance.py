import json
import random
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from hiresift.operators import layout, relevance
from hiresift.operators.replies import ReplyStore, request_name
from hiresift.plans import prompts, screening
from hiresift.sources import tables
from tests.test_scoring import by_id, frames

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stand-in models travel with the job

PAGES = "array<struct<height: double, words: array<struct<text: string, x0: double, x1: double, top: double>>>>"


def brute_force(pages):
    """Reading order straight from the rules, by index."""
    words, offset = [], 0.0
    for height, page in pages:
        words += [(top + offset, x0, x1, text) for text, x0, x1, top in page]
        offset += height
    words.sort(key=lambda w: w[:2])
    anchors = []
    for i, w in enumerate(words):
        if not anchors or abs(w[0] - words[anchors[-1]][0]) > 3:
            anchors.append(i)
    lines = [sorted(words[a:b], key=lambda w: w[1]) for a, b in zip(anchors, anchors[1:] + [len(words)])]

    def split(line):
        best = max(((line[i + 1][1] - line[i][2], -i) for i in range(len(line) - 1)), default=(0, 0))
        return None if best[0] <= 15 else 1 - best[1]

    def text(part):
        return " ".join(w[3] for w in part)

    out, block, boundary = [], ([], []), None
    for line in lines + [None]:
        at = split(line) if line else None
        if at is not None:
            boundary = (line[at - 1][2] + line[at][1]) / 2
            block[0].append(text(line[:at]))
            block[1].append(text(line[at:]))
            continue
        if line and boundary is not None and all(w[1] < boundary for w in line):
            block[0].append(text(line))
        elif line and boundary is not None and all(w[1] > boundary for w in line):
            block[1].append(text(line))
        else:
            out += block[0] + block[1] + ([text(line)] if line else [])
            block, boundary = ([], []), None
    return "\n".join(out)


def random_pages(rng):
    pages = []
    for _ in range(rng.randrange(0, 4)):
        words = []
        for row in range(rng.randrange(0, 9)):
            top = row * rng.choice([2.0, 4.0, 10.0]) + rng.choice([0.0, 1.5, 3.0])
            x = rng.choice([0.0, 0.0, 150.0, 300.0])
            for k in range(rng.randrange(1, 6)):
                width = rng.randrange(5, 60)
                words.append((f"w{row}_{k}", x, x + width, top))
                x += width + rng.choice([3.0, 5.0, 15.0, 16.0, 90.0])
        rng.shuffle(words)
        pages.append((rng.choice([50.0, 200.0]), words))
    return pages


def test_reading_order(spark):
    rng = random.Random(10)
    documents = [(i, random_pages(rng)) for i in range(400)]
    got = layout.reading_order(spark.createDataFrame(documents, f"doc_id bigint, pages {PAGES}")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: brute_force(p) for i, p in documents}


def as_words(spark, documents):
    """The pages of documents as one row a word and one row a page."""
    pages = [(i, p, height) for i, all_pages in documents for p, (height, _) in enumerate(all_pages)]
    words = [(i, p, k, *w) for i, all_pages in documents for p, (_, ws) in enumerate(all_pages) for k, w in enumerate(ws)]
    r = random.Random(1)
    r.shuffle(words)
    return (
        spark.createDataFrame(words, "doc_id bigint, page_no int, word_no int, text string, x0 double, x1 double, top double").repartition(5),
        spark.createDataFrame(pages, "doc_id bigint, page_no int, height double"),
    )


def test_reading_order_of_a_word_table(spark, monkeypatch):
    monkeypatch.setattr(layout, "ROWS", 7)
    rng = random.Random(11)
    documents = [(i, random_pages(rng)) for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in layout.texts_of_words(*as_words(spark, documents)).collect()}
    assert got == {i: brute_force(p) for i, p in documents if p}


def test_words_without_a_place_in_a_word_table(spark):
    whole = ("w", 1.0, 2.0, 3.0)
    documents = [(0, [(100.0, [whole])]), (1, [(100.0, [])])]
    for field in range(4):
        broken = tuple(None if i == field else v for i, v in enumerate(whole))
        documents += [(len(documents) + k, [(100.0, w)]) for k, w in enumerate(([broken], [("a", 0.0, 0.5, 1.0), broken, ("z", 9.0, 10.0, 90.0)]))]
    got = {r["doc_id"]: r["text"] for r in layout.texts_of_words(*as_words(spark, documents)).collect()}
    assert got == {i: {0: "w", 1: ""}.get(i) for i, _ in documents}


def test_a_long_document_is_streamed(spark):
    """A million words in lines of ten, in two columns whose blocks are short: what a task holds doesn't grow."""
    n, per_line = 1_000_000, 10
    i = F.col("id")
    line, k = F.floor(i / per_line), i % per_line
    left = F.when(k < 5, 0.0).otherwise(400.0) + 20.0 * (k % 5)
    across = line % 4 == 0
    left = F.when(across, 50.0 * k).otherwise(left)
    right = left + F.when(across, 45.0).otherwise(12.0)
    words = spark.range(n).select(
        F.lit(7).cast("bigint").alias("doc_id"), F.lit(0).alias("page_no"), i.cast("int").alias("word_no"),
        F.concat(F.lit("w"), i.cast("string")).alias("text"), left.alias("x0"), right.alias("x1"), (10.0 * line).alias("top"),
    )
    pages = spark.createDataFrame([(7, 0, 1e9)], "doc_id bigint, page_no int, height double")
    lines = layout.lines_of_words(words, pages)
    # A block is three lines of two columns, between lines that go across: 1 + 6 lines out of 4.
    assert lines.count() == n // per_line // 4 * 7
    first = [r["text"] for r in lines.where("line_no < 8").orderBy("line_no").collect()]
    at = lambda a, b: " ".join(f"w{x}" for x in range(a, b))
    assert first == [at(0, 10), at(10, 15), at(20, 25), at(30, 35), at(15, 20), at(25, 30), at(35, 40), at(40, 50)]
    assert sum(len(r["text"].split()) for r in lines.where("line_no < 70").collect()) == 400


def test_documents_without_pages(spark):
    df = spark.createDataFrame([(1, []), (2, None)], f"doc_id bigint, pages {PAGES}")
    assert [r["text"] for r in layout.reading_order(df).collect()] == ["", ""]


def test_words_without_a_place_or_text(spark):
    """One lone word, or the last of a line, that lacks a field: the plain text is taken."""
    whole = ("w", 1.0, 2.0, 3.0)
    rows, want = [(0, [(100.0, [whole])], "plain")], {0: "w"}
    for field in range(4):
        broken = tuple(None if i == field else v for i, v in enumerate(whole))
        for words in ([broken], [("a", 0.0, 0.5, 3.0), broken], [broken, ("z", 9.0, 10.0, 3.0)], [("up", 0.0, 1.0, 1.0), broken, ("down", 0.0, 1.0, 50.0)]):
            rows.append((len(rows), [(100.0, words)], f"plain {len(rows)}"))
            want[len(want)] = f"plain {len(want)}"
    df = spark.createDataFrame(rows, f"id int, pages {PAGES}, plain string").selectExpr("cast(id as bigint) as doc_id", "pages", "plain as plain_text")
    assert {r["doc_id"]: r["text"] for r in layout.extract_texts(df).collect()} == want
    assert {r["doc_id"] for r in layout.reading_order(df).collect() if r["text"] is not None} == {0}


def test_fallback(spark):
    rows = [(1, "laid out", "plain"), (2, " \n", "plain"), (3, None, "plain"), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = df.orderBy("id").select(layout.text_or_fallback(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["laid out", "plain", "plain", ""]


def want_score(reply):
    try:
        bare = reply.strip().replace("```json", "").replace("```", "").strip()
        return max(0.0, min(100.0, float(json.loads(bare)["score"])))
    except Exception:
        return None


def test_reply_scores(spark):
    replies = [
        '{"score": 85, "reason": "x"}', '```json\n{"score": 85}\n```', ' {"score": "140"} ', "not json",
        '{"reason": "x"}', '{"score": null}', '{"score": -3.5}', '{"score": " 7e1 "}', '{"score": "12d"}',
        '{"score": 85} extra', '[{"score": 85}]', '{"score": {"a": 1}}', '{"score": [1]}', '{"score": 61.25}',
        "", "   ", '{"score": ".5"}', '{"score": "5."}', '{"score": "0x10"}', '{"a": {"score": 5}}', '{"score": 85',
        '{"score": 85} {}', "{'score': 85}", '{"score": 10, "score": 90}', '{"score": 85}, {"score": 86}',
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "id int, r string")
    got = [r[0] for r in df.orderBy("id").select(relevance.reply_score(F.col("r"))).collect()]
    assert got == [want_score(r) for r in replies]
    assert df.limit(1).select(relevance.reply_score(F.lit(None).cast("string"))).first()[0] is None


def test_failing_model_falls_back_to_the_rules(spark):
    resumes, sessions = frames(spark)
    wanted = prompts.relevance_prompts(screening.parse_resumes(resumes), sessions)

    def fails(system, user):
        raise RuntimeError("no network")

    def flat(system, user):
        assert "Rate relevance 0-100." in user and "strict technical recruiter" in system
        return '{"score": 50}'

    plain = by_id(screening.score_resumes(resumes, sessions))
    assert by_id(screening.score_resumes(resumes, sessions, relevance.score_relevance(wanted, fails))) == plain
    scored = by_id(screening.score_resumes(resumes, sessions, relevance.score_relevance(wanted, flat)))
    assert (scored[1]["skills"], scored[1]["certifications"], scored[1]["projects"]) == (50.0, 50.0, 0.0)


def test_prompts_only_for_items(spark):
    resumes, sessions = frames(spark)
    rows = prompts.relevance_prompts(screening.parse_resumes(resumes), sessions).collect()
    asked = {(r["candidate_id"], r["category"]) for r in rows}
    assert asked == {
        (1, "skills"), (1, "experience"), (1, "certifications"), (2, "projects"), (4, "skills"),
    }
    mine = next(r for r in rows if r["category"] == "certifications")
    assert mine["user_prompt"] == (
        "Job description:\npython sql services\n\nCandidate's certifications:\n- AWS\n- GCP\n- CKA\n\nRate relevance 0-100."
    )


def test_answers_and_apologies(spark):
    rows = [(1, [("system", "s"), ("user", "q")]), (3, [("user", "boom")])]
    df = spark.createDataFrame(rows, "conv_id bigint, messages array<struct<role: string, content: string>>")

    def answerer(messages):
        if messages[-1]["content"] == "boom":
            raise ValueError("down")
        return messages[-1]["content"].upper()

    got = {r["conv_id"]: (r["answer"], r["error"]) for r in relevance.answer(df, answerer).collect()}
    apology = "Sorry, I ran into an error contacting the AI assistant: "
    assert got == {1: ("Q", None), 3: (apology + "down", "down")}


def ranking(spark, sizes):
    columns = "overall double, skills double, experience double, education double, certifications double, projects double"
    rows = [
        (s, i + 1, f"<{s}.{i}>", 50.0, 1.0, 2.0, 3.0, 4.0, 5.0, ["sql"], [])
        for s, n in sizes.items() for i in range(n)
    ]
    return spark.createDataFrame(
        rows, f"session_id bigint, rank bigint, name string, {columns}, matched_skills array<string>, missing_skills array<string>"
    )


def test_every_candidate_and_message_reaches_the_model(spark):
    sizes = {0: 23, 1: 5}
    pieces = prompts.system_prompts(ranking(spark, sizes), per_piece=5)
    chat = [(c, s, t, "user" if t % 2 == 0 else "assistant", f"[{c}:{t}]") for c, s, n in ((7, 0, 9), (8, 1, 3), (9, 5, 1)) for t in range(n)]
    chat = spark.createDataFrame(chat, "conv_id bigint, session_id bigint, turn bigint, role string, text string")
    requests = prompts.chat_requests(prompts.chat_messages(chat, pieces), max_messages=3).collect()
    for conv, session, turns, parts in ((7, 0, 9, 5 * 3), (8, 1, 3, 1), (9, 5, 1, 1)):
        mine = [r for r in requests if r["conv_id"] == conv]
        assert sorted(r["part_no"] for r in mine) == list(range(parts))
        sent = "".join(m["content"] for r in mine for m in r["messages"])
        for i in range(sizes.get(session, 0)):
            assert sent.count(f"<{session}.{i}>") == parts * 5 // len(range(0, sizes[session], 5)) // 5
        assert all(f"[{conv}:{t}]" in sent for t in range(turns))
        assert all(r["messages"][0]["role"] == "system" and r["messages"][-1]["content"] == f"[{conv}:{turns - 1}]" for r in mine)
        assert all(len(r["messages"]) <= 5 for r in mine)
    whole = prompts.chat_requests(prompts.chat_messages(chat, prompts.system_prompts(ranking(spark, sizes)))).collect()
    assert len(whole) == 3 and {len(r["messages"]) for r in whole if r["conv_id"] == 7} == {10}


def test_messages_hold_each_text_about_once(spark, tmp_path):
    """Many conversations of one session: its texts are spread over tasks and lie side by side in the files."""
    r = random.Random(5)
    texts = {p: f"{r.getrandbits(160_000):x}" for p in range(60)}
    pieces = spark.createDataFrame([(0, p, t) for p, t in texts.items()], "session_id bigint, piece_no bigint, system_prompt string")
    sessions = {c: (None if c == 0 else 9 if c == 1 else 0) for c in range(150)}
    chat = [(c, s, t, "user", f"[{c}:{t}]") for c, s in sessions.items() for t in range(2)]
    chat = spark.createDataFrame(chat, "conv_id bigint, session_id bigint, turn bigint, role string, text string")
    prompts.chat_messages(chat, pieces).write.parquet(str(tmp_path / "m"))
    assert sum(f.stat().st_size for f in (tmp_path / "m").glob("*.parquet")) < 3 * sum(map(len, texts.values()))
    got = spark.read.parquet(str(tmp_path / "m")).where("part = 0").collect()
    empty = prompts.CHAT_SYSTEM_HEAD + prompts.CHAT_SYSTEM_TAIL
    want = [(c, p, t) for c, s in sessions.items() if s == 0 for p, t in texts.items()] + [(0, 0, empty), (1, 0, empty)]
    assert sorted((r["conv_id"], r["piece_no"], r["content"]) for r in got) == sorted(want)


def test_neighbouring_messages_hold_different_texts(spark, tmp_path):
    """A writer that keeps the least and the greatest text would compare equal neighbours to the end, for each row."""
    import pyarrow.parquet as pq

    pieces = spark.createDataFrame([(0, p, f"{p:03d}" * 2000) for p in range(12)], "session_id bigint, piece_no bigint, system_prompt string")
    chat = spark.createDataFrame([(c, 0, 0, "user", "?") for c in range(200)], "conv_id bigint, session_id bigint, turn bigint, role string, text string")
    prompts.chat_messages(chat, pieces).where("part = 0").write.parquet(str(tmp_path / "m"))
    texts = [pq.read_table(f).column("content").to_pylist() for f in (tmp_path / "m").glob("*.parquet")]
    assert sum(map(len, texts)) == 200 * 12
    assert sum(a == b for t in texts for a, b in zip(t, t[1:])) < 200 * 12 / 10


def names(messages):
    """A stand-in that repeats every candidate it is told of."""
    import re

    return " ".join(sorted(set(re.findall(r"<\d+\.\d+>", "".join(m["content"] for m in messages)))))


def test_rankings_in_pieces_are_condensed_in_rounds(spark):
    ranked = ranking(spark, {0: 23, 1: 5, 2: 3})
    contexts = prompts.candidate_context(ranked, per_piece=3)
    digests = relevance.condensed(prompts.as_system_prompts(contexts), names, fan_in=2)
    assert {r["session_id"]: len(r["digest"].split()) for r in digests.collect()} == {0: 23, 1: 5}
    whole = {r["session_id"]: r["system_prompt"] for r in prompts.whole_prompts(contexts, digests).collect()}
    assert all(names([{"content": whole[s]}]).split() == sorted(f"<{s}.{i}>" for i in range(n)) for s, n in {0: 23, 1: 5, 2: 3}.items())
    own = {(r["session_id"], r["piece_no"]): r["system_prompt"] for r in prompts.own_prompts(contexts, digests).collect()}
    assert len(own) == 8 + 2 + 1
    assert own[2, 0] == {r["session_id"]: r for r in prompts.system_prompts(ranked, 3).collect()}[2]["system_prompt"]
    assert own[0, 7].count("<0.21>") == 2 and own[0, 7].count("<0.20>") == 1  # the condensed ranking, and the own piece


def test_one_request_for_each_candidate(spark):
    """Requests grow with candidates and pieces, not with their product; each holds the candidate's own piece."""
    n, per_piece = 60, 4
    columns = "overall double, skills double, experience double, education double, certifications double, projects double"
    ranked = spark.createDataFrame(
        [(0, 100 + i, i + 1, f"<0.{i}>", 50.0, 1.0, 2.0, 3.0, 4.0, 5.0, ["sql"], []) for i in range(n)],
        f"session_id bigint, candidate_id bigint, rank bigint, name string, {columns}, matched_skills array<string>, missing_skills array<string>",
    )
    calls = spark.sparkContext.accumulator(0)

    def counted(messages):
        calls.add(1)
        return names(messages)

    contexts = prompts.candidate_context(ranked, per_piece)
    digests = tables.materialize(relevance.condensed(prompts.as_system_prompts(contexts), counted, fan_in=5))
    asked = spark.createDataFrame([(0, 100 + i, f"about {i}") for i in range(n)], "session_id bigint, candidate_id bigint, prompt string")
    answers = relevance.answer_each(asked, prompts.places(ranked, per_piece), prompts.own_prompts(contexts, digests), "candidate_id", counted)
    got = {r["candidate_id"]: r["answer"].split() for r in answers.collect()}
    assert len(got) == n and all(len(a) == n for a in got.values())
    assert calls.value == n + 15 + 3 + 1  # 15 pieces, combined five at a time


def test_candidates_without_session_or_ranking_are_answered(spark):
    pieces = prompts.system_prompts(ranking(spark, {0: 5}), per_piece=3)
    rows = [(0, 1, "a"), (None, 2, "b"), (9, 3, "c"), (2**60 + 1, 4, "d"), (0, 5, "e")]
    asked = spark.createDataFrame(rows, "session_id bigint, candidate_id bigint, prompt string")
    places = spark.createDataFrame([(1, 1)], "candidate_id bigint, piece_no bigint")

    def told(messages):
        return f"{len(messages)}|{messages[0]['content']}|{messages[-1]['content']}"

    empty = prompts.CHAT_SYSTEM_HEAD + prompts.CHAT_SYSTEM_TAIL
    texts = {r["piece_no"]: r["system_prompt"] for r in pieces.collect()}
    for kept in (None, ReplyStore(spark, tables.new_folder(spark))):
        answers = relevance.answer_each(asked, places, pieces, "candidate_id", told, kept)
        got = {r["candidate_id"]: (r["session_id"], r["answer"], r["error"]) for r in answers.collect()}
        assert got[1] == (0, f"2|{texts[1]}|a", None)
        assert {c: got[c] for c in (2, 3, 4)} == {c: (s, f"2|{empty}|{p}", None) for s, c, p in rows[1:4]}
        assert got[5] in [(0, f"2|{t}|e", None) for t in texts.values()]  # it has no place, but its session has pieces


def ranks_told(messages):
    """A stand-in that names the ranks it is told of, and forgets all when asked to condense."""
    import re

    if messages[-1]["content"] == relevance.CONDENSE_PROMPT:
        return "short"
    return " ".join(sorted(set(re.findall(r"Rank \d+:", "".join(m["content"] for m in messages)))))


def test_the_queries_send_every_question_with_the_whole_ranking(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry_points

    spark.range(60).selectExpr("id as c_custkey", "concat('Ann ', id) as c_name", "'FURNITURE' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(6).selectExpr("id as s_suppkey", "concat('S', id) as s_name", "cast(id as int) as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    chat = spark.createDataFrame([(c, t, "user", f"[{c}:{t}]") for c in (0, 1, 3, 9) for t in range(3)], "conv_id bigint, turn bigint, role string, text string")
    chat.write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(entry_points, "_PIECE", 4)
    monkeypatch.setattr(entry_points, "_offline_answerer", ranks_told)
    sizes = {r["session_id"]: r["count"] for r in entry_points.rank_candidates(spark, str(tmp_path)).groupBy("session_id").count().collect()}
    assert sizes[0] == 30
    want = lambda s: " ".join(sorted(f"Rank {i + 1}:" for i in range(sizes.get(s, 0))))
    for asked in (entry_points.email_answers, entry_points.interview_answers):
        got = {r["candidate_id"]: (r["session_id"], r["answer"]) for r in asked(spark, str(tmp_path)).collect()}
        assert len(got) == 60 and all(a == want(s) for s, a in got.values())
    said = {r["conv_id"]: r["answer"] for r in entry_points.chat_answers(spark, str(tmp_path)).collect()}
    assert said == {c: want(0 if c % 3 == 0 else c) for c in (0, 1, 3, 9)}


def test_answers_of_pieces_are_combined(spark):
    """Small cells and several copies of a text give what one task would; repeated and null keys keep their rows."""
    sizes = {0: 23, 1: 5}
    pieces = prompts.system_prompts(ranking(spark, sizes), per_piece=2)
    rows = [(0, 1, "a"), (0, 1, "a"), (0, None, "b"), (None, 2, "c"), (7, 3, "d"), (1, 4, "e"), (1, 5, None)]
    asked = prompts.single_questions(spark.createDataFrame(rows, "session_id bigint, candidate_id bigint, prompt string"), "candidate_id")
    calls = spark.sparkContext.accumulator(0)

    def counted(messages):
        calls.add(1)
        return names(messages) if messages[-1]["content"] is not None else None

    for options in ({}, {"held_bytes": 1, "calls_per_copy": 5}):
        calls.value = 0
        parts = tables.materialize(relevance.answer_pieces(asked, pieces, counted, fan_in=3, **options))
        assert parts.count() == 3 * 4 + 2 + 2 * 1
        assert calls.value == 3 * (12 + 4) + 2 + 2 * (3 + 1)
        got = relevance.combined(parts, ["session_id", "candidate_id", "_row"], counted, fan_in=3).collect()
        told = {(r["session_id"], r["candidate_id"]): (r["answer"] or "").split() for r in got}
        assert len(got) == len(rows) and all(e is None for e in (r["error"] for r in got))
        whole = {s: sorted(f"<{s}.{i}>" for i in range(n)) for s, n in sizes.items()}
        assert told == {(0, 1): whole[0], (0, None): whole[0], (None, 2): [], (7, 3): [], (1, 4): whole[1], (1, 5): []}


def small_tables(spark, folder):
    spark.range(60).selectExpr("id as c_custkey", "concat('Ann ', id) as c_name", "'FURNITURE' as c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.range(6).selectExpr("id as s_suppkey", "concat('S', id) as s_name", "cast(id as int) as s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    chat = spark.createDataFrame([(c, t, "user", f"[{c}:{t}]") for c in (0, 1, 3, 9) for t in range(3)], "conv_id bigint, turn bigint, role string, text string")
    chat.write.parquet(f"{folder}/conversations.parquet")


def stored_columns(monkeypatch):
    """The columns of all intermediates that answers are made from."""
    stored, kept = [], relevance.materialize
    monkeypatch.setattr(relevance, "materialize", lambda df: stored.append(df.columns) or kept(df))
    return stored


def test_chat_answers_stores_no_partial_answers(spark, tmp_path, monkeypatch):
    """Partial answers of a long ranking, which filled executors, stay in the task that asks; no other row needs them."""
    import __spark_entry__ as entry_points

    small_tables(spark, tmp_path)
    stored = stored_columns(monkeypatch)
    monkeypatch.setattr(entry_points, "_PIECE", 1)  # 30 pieces, so two rounds
    monkeypatch.setattr(entry_points, "_offline_answerer", ranks_told)
    said = {r["conv_id"]: r["answer"] for r in entry_points.chat_answers(spark, str(tmp_path)).collect()}
    assert len(said) == 4 and len(said[0].split("Rank")) == 1 + 30
    assert stored and not any("answer" in columns for columns in stored)


def no_partial_answers_stored(spark, folder, monkeypatch, name):
    import __spark_entry__ as entry_points

    small_tables(spark, folder)
    stored = stored_columns(monkeypatch)
    monkeypatch.setattr(entry_points, "_PIECE", 1)  # 30 pieces, so two rounds
    monkeypatch.setattr(entry_points, "_offline_answerer", ranks_told)
    said = {r["candidate_id"]: (r["session_id"], r["answer"]) for r in getattr(entry_points, name)(spark, str(folder)).collect()}
    assert len(said) == 60 and all(len(a.split("Rank")) == 1 + 30 for s, a in said.values() if s == 0)
    assert stored and not any("answer" in columns for columns in stored)


def test_email_answers_stores_no_partial_answers(spark, tmp_path, monkeypatch):
    no_partial_answers_stored(spark, tmp_path, monkeypatch, "email_answers")


def test_interview_answers_stores_no_partial_answers(spark, tmp_path, monkeypatch):
    no_partial_answers_stored(spark, tmp_path, monkeypatch, "interview_answers")


def test_whole_rankings_give_what_their_pieces_do(spark):
    """In one task, in cells, or with a history in stretches: the answers, failures among them, are those of the rounds over stored parts."""
    pieces = prompts.system_prompts(ranking(spark, {0: 23, 1: 5}), per_piece=1)
    no_number = spark.createDataFrame([(0, None, "?"), (None, 0, "?")], "session_id bigint, piece_no bigint, system_prompt string")
    pieces = pieces.unionByName(no_number)

    def told(messages):
        text = "".join(f"{m['role']}:{m['content']}" for m in messages)
        if len(text) % 7 == 0:
            raise RuntimeError(f"no {len(text)}")
        return None if len(text) % 5 == 0 else f"<{text[-300:]}>"

    rows = [(0, 1, "a"), (0, 1, "a"), (0, None, "bb"), (None, 2, "c"), (7, 3, "d"), (1, 4, "eee"), (1, 5, None), *((s % 2, 10 + s, "q" * s) for s in range(20))]
    single = prompts.single_questions(spark.createDataFrame(rows, "session_id bigint, candidate_id bigint, prompt string"), "candidate_id")
    chat = [(c, s, t, "user" if t % 2 == 0 else "assistant", f"[{c}:{t}]") for c, s, n in ((7, 0, 9), (8, 1, 3), (9, 5, 1), (10, 0, 1)) for t in range(n)]
    chat = spark.createDataFrame(chat, "conv_id bigint, session_id bigint, turn bigint, role string, text string")
    for asked, keys in (
        (tables.materialize(single), ["session_id", "candidate_id", "_row"]), (tables.materialize(prompts.chat_questions(chat, max_messages=3)), ["conv_id"]),
    ):
        parts = relevance.answer_pieces(asked, pieces, told, fan_in=3)
        want = sorted(map(str, relevance.combined(parts.select(*keys, "part_no", "question", "answer", "error"), keys, told, fan_in=3).collect()))
        assert len(want) in (len(rows), 4) and any("Sorry" in w for w in want)
        for options in ({}, {"whole_bytes": 2500}, {"whole_bytes": 1}, {"calls_per_copy": 5}):
            assert sorted(map(str, relevance.answer_rankings(asked, pieces, keys, told, fan_in=3, **options).collect())) == want


# --- kept replies -----------------------------------------------------------------------------
def counting(spark):
    calls = spark.sparkContext.accumulator(0)

    def told(messages):
        calls.add(1)
        if "bad" in messages[-1]["content"]:
            raise RuntimeError(f"no {messages[-1]['content']}")
        return messages[-1]["content"].upper()

    return calls, told


def message_rows(spark, texts):
    rows = [(i, [("user", t)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conv_id bigint, messages array<struct<role: string, content: string>>")


def test_a_second_run_asks_nothing(spark, tmp_path):
    calls, told = counting(spark)
    kept = ReplyStore(spark, str(tmp_path), attempts=2, per_round=3)
    asked = message_rows(spark, ["a", "b", "a", "bad", "c", "d", "e", "a"])
    first = sorted(map(tuple, relevance.answer(asked, told, kept).collect()))
    assert [a for _, a, _ in first if a.startswith("Sorry")] == [f"{relevance.CHAT_APOLOGY}no bad"]
    assert [a for i, a, _ in first if i != 3] == ["A", "B", "A", "C", "D", "E", "A"]
    assert calls.value == 5 + 2  # equal requests once; the failing one twice
    again = relevance.answer(asked, told, ReplyStore(spark, str(tmp_path)))
    assert sorted(map(tuple, again.collect())) == first and calls.value == 7
    more = relevance.answer(message_rows(spark, ["a", "new"]), told, ReplyStore(spark, str(tmp_path)))
    assert sorted(r["answer"] for r in more.collect()) == ["A", "NEW"] and calls.value == 8
    assert {(r["error"], r["attempts"]) for r in kept.read().where("reply is null").collect()} == {("no bad", 2)}


def test_failed_requests_can_be_sent_again(spark, tmp_path):
    _, told = counting(spark)
    asked = message_rows(spark, ["bad", "good"])
    relevance.answer(asked, told, ReplyStore(spark, str(tmp_path))).collect()
    better = ReplyStore(spark, str(tmp_path), retry_failed=True)
    got = relevance.answer(asked, lambda messages: "now", better).collect()
    assert sorted((r["conv_id"], r["answer"], r["error"]) for r in got) == [(0, "now", None), (1, "GOOD", None)]


def test_models_and_message_borders_are_kept_apart(spark, tmp_path):
    asked = message_rows(spark, ["x"])
    assert relevance.answer(asked, lambda m: "one", ReplyStore(spark, str(tmp_path), "one")).first()["answer"] == "one"
    assert relevance.answer(asked, lambda m: "two", ReplyStore(spark, str(tmp_path), "two")).first()["answer"] == "two"
    name = lambda a, b: spark.range(1).select(request_name("m", F.lit(a), F.lit(b))).first()[0]
    assert len({name("a", "b"), name("ab", ""), name("", "ab"), name(None, "ab")}) == 4


def test_scores_and_combined_answers_from_a_store(spark, tmp_path):
    resumes, sessions = frames(spark)
    wanted = prompts.relevance_prompts(screening.parse_resumes(resumes), sessions)
    plain = sorted(map(tuple, relevance.score_relevance(wanted, lambda s, u: '{"score": %d}' % (len(u) % 100)).collect()))
    kept = ReplyStore(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, relevance.score_relevance(wanted, lambda s, u: '{"score": %d}' % (len(u) % 100), kept).collect())) == plain

    def refuses(*_):
        raise RuntimeError("asked again")

    assert sorted(map(tuple, relevance.score_relevance(wanted, refuses, kept).collect())) == plain
    contexts = prompts.candidate_context(ranking(spark, {0: 23}), per_piece=3)
    kept = ReplyStore(spark, str(tmp_path / "b"))
    made = [relevance.condensed(prompts.as_system_prompts(contexts), model, 2, kept).collect() for model in (names, refuses)]
    assert made[0] == made[1] and len(made[0][0]["digest"].split()) == 23


def test_unreadable_pages_fall_back_without_harm_to_others(spark):
    from hiresift.operators import layout

    words = "array<struct<text: string, x0: double, x1: double, top: double>>"
    rows = [
        (1, [(100.0, [("a", 0.0, 5.0, 1.0)])], "plain"), (2, None, "plain"), (3, [(100.0, None)], "plain"),
        (4, [(100.0, [("a", 0.0, 5.0, None), ("b", 6.0, 9.0, 1.0)])], "plain"), (5, [(100.0, [(None, 0.0, 5.0, 1.0)])], None),
        (6, [(100.0, None), (None, [("b", 0.0, 5.0, 1.0)])], "plain"), (7, [None], "plain"),
    ]
    df = spark.createDataFrame(rows, f"doc_id bigint, pages array<struct<height: double, words: {words}>>, plain_text string")
    got = {r["doc_id"]: r["text"] for r in layout.extract_texts(df).collect()}
    assert got == {1: "a", 2: "plain", 3: "plain", 4: "plain", 5: "", 6: "b", 7: "plain"}
