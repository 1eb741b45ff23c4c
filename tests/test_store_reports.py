import csv
import glob
import os

from pyspark.sql import functions as F

from hiresift.operators import store
from hiresift.plans import prompts, reports, screening
from hiresift.sources import tables
from tests.test_scoring import by_id, frames

SESSION_COLUMNS = "id bigint, job_title string, job_description string, created_at string, browser_id string"
CANDIDATE_COLUMNS = "id bigint, session_id bigint, name string, email string, overall_score double, status string"
NOTE_COLUMNS = "id bigint, candidate_id bigint, note_text string, created_at string"


def sessions(spark):
    rows = [
        (1, "Data Engineer", "sql", "2024-01-02T10:00:00", "b1"),
        (2, "Data Engineer", "sql", "2024-01-02T09:00:00", None),
        (3, "Chef", "soup", "2024-01-03T09:00:00", "b2"),
    ]
    return spark.createDataFrame(rows, SESSION_COLUMNS)


def candidates(spark):
    rows = [
        (1, 1, "Ann", "a@x.org", 90.0, "New"),
        (2, 1, "Ann", "b@x.org", 70.0, "Rejected"),
        (3, 1, "Bob", "c@x.org", 90.0, "Interview"),
        (4, 2, "Dee", "d@x.org", 10.0, "Shortlisted"),
    ]
    return spark.createDataFrame(rows, CANDIDATE_COLUMNS)


def notes(spark):
    rows = [(i, 1 if i < 8 else 4, f"note {i}", f"2024-01-0{i % 3 + 1}T10:20:30") for i in range(1, 10)]
    return spark.createDataFrame(rows, NOTE_COLUMNS)


def test_schemas_match_the_stored_tables(spark):
    stored = store.persisted_candidates(screening.score_resumes(*frames(spark)))
    assert [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in tables.CANDIDATES_SCHEMA]
    assert sessions(spark).schema == tables.SESSIONS_SCHEMA
    assert notes(spark).schema == tables.NOTES_SCHEMA


def test_json_record_comes_back_whole(spark):
    scored = screening.score_resumes(*frames(spark))
    loaded = store.loaded_candidates(store.persisted_candidates(scored))
    assert [r["status"] for r in loaded.collect()] == ["New"] * scored.count()
    assert by_id(loaded.drop("status").select(scored.columns)) == by_id(scored)


def test_unknown_keys_survive_as_variant(spark, tmp_path):
    import json

    records = ['{"name": "Ann", "overall": 81.5, "extra": {"a": [1, "x", null], "b": true}}', '{"name": null, "list": []}', "no json", None, '{"overall": "high"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id bigint, data_json string")
    store.variant_records(df).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    back = {r["id"]: r["data_json"] and json.loads(r["data_json"]) for r in store.json_records(stored).collect()}
    assert back == {0: json.loads(records[0]), 1: json.loads(records[1]), 2: None, 3: None, 4: json.loads(records[4])}
    fields = {"name": ("$.name", "string"), "overall": ("$.overall", "double"), "deep": ("$.extra.a[1]", "string")}
    got = {r["id"]: (r["name"], r["overall"], r["deep"]) for r in store.record_fields(stored, fields).collect()}
    assert got == {0: ("Ann", 81.5, "x"), 1: (None, None, None), 2: (None, None, None), 3: (None, None, None), 4: (None, None, None)}
    assert "extra" in store.record_schema(stored) and "list" in store.record_schema(stored)


def test_delete_leaves_no_orphans(spark):
    gone = spark.createDataFrame([(1,), (77,)], "id bigint")
    for options in ({}, {"broadcast_limit": 0, "rows_per_salt": 1}):
        s, c, n = store.delete_sessions(sessions(spark), candidates(spark), notes(spark), gone, **options)
        assert sorted(r["id"] for r in s.collect()) == [2, 3]
        assert [r["id"] for r in c.collect()] == [4]
        assert sorted(r["id"] for r in n.collect()) == [8, 9]
        assert c.join(s, c["session_id"] == s["id"], "left_anti").count() == 0
        assert n.join(c, n["candidate_id"] == c["id"], "left_anti").count() == 0


def test_status_updates(spark):
    updates = spark.createDataFrame(
        [(1, "Interview", 1), (1, "Rejected", 5), (1, "Hired", 9), (3, "Interview", 2), (99, "New", 1)],
        "id bigint, new_status string, seq bigint",
    )
    got = {r["id"]: (r["status"], r["changed"]) for r in store.apply_status_updates(candidates(spark), updates).collect()}
    assert got == {1: ("Rejected", True), 2: ("Rejected", False), 3: ("Interview", False), 4: ("Shortlisted", False)}


def test_notes_are_stripped_numbered_and_never_blank(spark):
    batch = spark.createDataFrame(
        [(30, 4, " \t", "t"), (10, 4, "  kept\n", "t"), (20, 1, "also", "t")], NOTE_COLUMNS
    )
    got = store.append_notes(notes(spark), batch, "id").where("id > 9").orderBy("id").collect()
    assert [(r["id"], r["candidate_id"], r["note_text"]) for r in got] == [(10, 4, "kept"), (11, 1, "also")]


def test_first_append_starts_at_one(spark):
    empty = sessions(spark).limit(0)
    got = store.append_sessions(empty, sessions(spark), "id").orderBy("id").collect()
    assert [r["id"] for r in got] == [1, 2, 3]


def test_missing_column_is_added(spark):
    old = sessions(spark).drop("browser_id")
    got = store.with_columns_of(old, sessions(spark))
    assert got.count() == 6 and got.where("browser_id is null").count() == 4


def test_validation_order(spark):
    rows = [(1, " ", " ", None), (2, " ", "text", None), (3, "T", " ", ""), (4, "T", " ", None), (5, "T", "text", None)]
    requests = spark.createDataFrame(rows, "id bigint, job_title string, jd_text string, jd_doc string")
    resumes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "session_id bigint")
    got = {r["id"]: r["reject_reason"] for r in store.validate_requests(requests, resumes).collect()}
    assert got == {1: "no job description", 2: "no job title", 3: None, 4: "no job description", 5: "no resume"}
    chosen = requests.select("id", store.chosen_description(F.col("jd_text"), F.col("jd_doc")).alias("jd"))
    assert {r["id"]: r["jd"] for r in chosen.collect()}[3] == ""


def test_reads(spark):
    s, c = sessions(spark), candidates(spark)
    assert [r["id"] for r in reports.visible_sessions(s, "b1").collect()] == [1, 2]
    assert reports.session_by_id(s, 3).first()["job_title"] == "Chef"
    assert reports.session_by_id(s, 9).first() is None
    assert [r["id"] for r in reports.session_candidates(c, 1).collect()] == [1, 3, 2]
    assert {(r["label"], r["id"]) for r in reports.session_options(s).collect()} == {
        ("Data Engineer — 2024-01-02", 2), ("Chef — 2024-01-03", 3),
    }
    lines = [r["line"] for r in reports.candidate_notes(notes(spark), 4).collect()]
    assert lines == ["2024-01-03T10:20 — note 8", "2024-01-01T10:20 — note 9"]
    assert {r["id"]: r["name_status"] for r in reports.status_by_name(c, rows_per_salt=1).collect()} == {
        1: "Rejected", 2: "Rejected", 3: "Interview", 4: "Shortlisted",
    }
    assert {r["name"]: r["id"] for r in reports.first_by_name(c).collect()} == {"Ann": 1, "Bob": 3, "Dee": 4}


def test_dashboard_keeps_empty_sessions(spark):
    got = {r["session_id"]: r for r in reports.dashboard(sessions(spark), candidates(spark)).collect()}
    assert (got[1]["candidates"], got[1]["interview"], got[1]["rejected"], got[1]["top_score"]) == (3, 1, 1, "90.0%")
    assert (got[3]["candidates"], got[3]["top_score"]) == (0, "0%")


def test_notes_of_a_busy_candidate(spark):
    got = reports.candidates_with_notes(candidates(spark), notes(spark), rows_per_salt=2).collect()
    assert len(got) == 9 + 2
    assert sum(r["candidate_id"] == 1 for r in got) == 7
    assert sorted(r["candidate_id"] for r in got if r["note_id"] is None) == [2, 3]


def with_status(spark):
    return screening.rank_resumes(*frames(spark)).withColumn("status", F.lit("New"))


def test_comparison_of_a_single_candidate_is_with_itself(spark):
    scored = screening.score_resumes(*frames(spark))
    rows = reports.compare_scores(reports.default_pairs(scored)).where("session_id = 11").collect()
    assert len(rows) == 6 and all(r["a_name"] == r["b_name"] == "Dee" and r["arrow"] == "−" for r in rows)
    chosen = spark.createDataFrame([(10, 2, 1)], "session_id bigint, a_id bigint, b_id bigint")
    rows = {r["category"]: r["arrow"] for r in reports.compare_scores(reports.pairs(scored, chosen)).collect()}
    assert (rows["Education"], rows["Skills"]) == ("←", "→")
    skills = reports.compare_skills(reports.pairs(scored, chosen)).first()
    assert (skills["only_a"], skills["both"], skills["only_b"]) == ("None", "None", "aws, gcp, python, sql")


def test_report_reads_in_order_and_exports(spark, tmp_path):
    all_sessions = sessions(spark).withColumn("id", F.col("id") + 9)
    lines = reports.report_lines(with_status(spark), all_sessions)
    text = [r["line"] for r in lines.where("session_id = 10").orderBy("rank", "line_no").collect()]
    assert text[:3] == ["Candidate Ranking Report", "Job: Data Engineer", "Generated: 2024-01-02"]
    assert len(text) == 3 + 4 * 3 and text[3].startswith("1. ") and text[6].startswith("Missing skills: ")
    path = str(tmp_path / "reports")
    tables.export_reports(lines, path)
    folder = glob.glob(f"{path}/session_id=10/file_name=hiring_report_Data_Engineer")
    parts = sorted(glob.glob(f"{folder[0]}/part-*"))
    written = [line for p in parts for line in open(p, encoding="utf-8").read().splitlines()]
    assert written == text


def test_rankings_export(spark, tmp_path):
    path = str(tmp_path / "rankings")
    tables.export_rankings(reports.rankings_table(with_status(spark)), path)
    parts = sorted(glob.glob(f"{path}/session_id=10/part-*"))
    rows = [row for p in parts for row in csv.DictReader(open(p, encoding="utf-8"))]
    assert [row["rank"] for row in rows] == ["1", "2", "3"]
    assert rows[0]["overall"].endswith("%")


def test_resume_files(spark, tmp_path):
    for name, text in {"a.txt": "Ann\nx", "b.txt": " \n"}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    files = tables.read_resume_files(spark, str(tmp_path))
    assert {r["filename"]: r["raw_text"] for r in files.collect()} == {"a.txt": "Ann\nx", "b.txt": " \n"}
    assert [r["filename"] for r in tables.readable(files).collect()] == ["a.txt"]
    assert [r["filename"] for r in tables.unreadable(files).collect()] == ["b.txt"]


def test_materialize_writes_to_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda spark: f"file://{tmp_path}")
    copy = tables.materialize(candidates(spark))
    assert sorted(copy.collect()) == sorted(candidates(spark).collect())
    file = copy.inputFiles()[0].removeprefix("file://")
    assert file.startswith(str(tmp_path)) and os.path.exists(file)
    tables.release(spark)
    assert not os.path.exists(os.path.dirname(file))


def test_materialize_persists_without_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda spark: None)
    copy = tables.materialize(candidates(spark))
    assert copy.is_cached and sorted(copy.collect()) == sorted(candidates(spark).collect())
    tables.release(spark)
    assert not copy.is_cached


def test_scopes_drop_what_they_made(spark, tmp_path, monkeypatch):
    import os

    for folder in (None, str(tmp_path)):
        monkeypatch.setattr(tables, "shared_folder", lambda _: folder)
        before = tables.materialize(spark.range(3))
        with tables.scope(spark) as made:
            inner = tables.materialize(spark.range(5).withColumn("x", F.col("id") * 2))
            kept = made.keep(inner.where("x > 2"))
        assert sorted(r["x"] for r in kept.collect()) == [4, 6, 8] and before.count() == 3
        if folder:
            assert not os.path.exists(inner.stored_at) and os.path.exists(kept.stored_at)
        else:
            assert not inner.is_cached and kept.is_cached and before.is_cached
        tables.drop(kept)
        tables.drop(before)
        assert not (os.path.exists(kept.stored_at) if folder else kept.is_cached)
        tables.drop(spark.range(1))  # not a copy: nothing happens


def test_context_pieces_add_up(spark):
    ranked = screening.rank_resumes(*frames(spark))
    whole = prompts.candidate_context(ranked, 1000).where("session_id = 10").first()["context"]
    pieces = prompts.candidate_context(ranked, 2).where("session_id = 10").orderBy("piece_no").collect()
    assert len(pieces) == 2 and "\n".join(r["context"] for r in pieces) == whole
    assert whole.startswith("Rank 1: ") and whole.count("Missing Skills") == 3


def test_chat_history_leaves_the_question_out(spark):
    turns = [(1, 10, 0, "user", "hi"), (1, 10, 1, "assistant", "hello"), (1, 10, 2, "user", "who?"),
             (2, 11, 0, "system", "x"), (2, 11, 1, "user", "best?"), (2, 11, 2, "assistant", "later")]
    chat = spark.createDataFrame(turns, "conv_id bigint, session_id bigint, turn bigint, role string, text string")
    session_prompts = prompts.system_prompts(screening.rank_resumes(*frames(spark)), per_piece=2)
    messages = prompts.chat_messages(chat, session_prompts)
    got = {
        c: [(r["role"], r["content"]) for r in messages.where(f"conv_id = {c}").orderBy("part", "piece_no", "turn").collect()]
        for c in (1, 2)
    }
    assert [role for role, _ in got[1]] == ["system", "system", "user", "assistant", "user"]
    assert [text for _, text in got[1][2:]] == ["hi", "hello", "who?"]
    assert got[2][0][1].startswith("You are an HR assistant") and got[2][1:] == [("user", "best?")]
    requests = prompts.chat_requests(messages).collect()
    assert sorted((r["conv_id"], r["part_no"], len(r["messages"])) for r in requests) == [(1, 0, 4), (1, 1, 4), (2, 0, 2)]


def test_email_prompt_follows_status(spark):
    got = {r["candidate_id"]: r["prompt"] for r in prompts.email_prompts(candidates(spark)).collect()}
    assert "acknowledging" in got[1] and "rejection email to Ann" in got[2]
    assert "inviting them" in got[3] and "inviting them" in got[4]
