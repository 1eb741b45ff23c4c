"""The stored tables: what is written, what is left alone, what a lookup reads."""

import glob
import os
import random

import pytest

from hiresift.operators import store
from hiresift.plans import screening
from hiresift.sources import stored, tables
from tests.test_scoring import frames
from tests.test_store_reports import candidates, notes, sessions


def files(made, name):
    """Each data file with the time of its last change."""
    found = glob.glob(f"{made.path(name)}/**/*.parquet", recursive=True)
    return {os.path.relpath(f, made.path(name)): os.stat(f).st_mtime_ns for f in found}


def bucket_of(file):
    return int(file.split("/")[0].split("=")[1])


def with_json(df):
    return df.selectExpr("id", "session_id", "name", "email", "overall_score", "'{}' as data_json", "status")


@pytest.fixture
def made(spark, tmp_path):
    return stored.StoredTables(spark, str(tmp_path / "store"), buckets=8)


@pytest.fixture
def filled(spark, made):
    rng = random.Random(3)
    made.append("sessions", spark.createDataFrame([(i, f"job {i}", "sql", "2024-01-01", None) for i in range(40)], tables.SESSIONS_SCHEMA))
    people = [(i, 0 if i % 3 == 0 else rng.randrange(40), f"n{i}", None, float(i % 100), "{}", "New") for i in range(300)]
    made.append("candidates", spark.createDataFrame(people, tables.CANDIDATES_SCHEMA))
    made.append("notes", spark.createDataFrame([(i, rng.randrange(300), f"note {i}", "2024") for i in range(900)], tables.NOTES_SCHEMA))
    return made


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_creation_is_done_once_and_remembers_its_buckets(spark, tmp_path):
    first = stored.StoredTables(spark, str(tmp_path), buckets=4)
    assert [first.read(n).count() for n in stored.LAYOUTS] == [0, 0, 0]
    assert {n: first.read(n).schema for n in stored.LAYOUTS} == {n: x.schema for n, x in stored.LAYOUTS.items()}
    first.append("sessions", sessions(spark))
    again = stored.StoredTables(spark, str(tmp_path), buckets=32)
    assert again.buckets == 4 and rows(again.read("sessions")) == rows(sessions(spark))


def test_a_second_batch_leaves_old_files_untouched(spark, made):
    resumes, postings = frames(spark)
    requests = postings.selectExpr(
        "id", "coalesce(job_title, 'Title') as job_title", "job_description as jd_text", "cast(null as string) as jd_doc",
        "'2024-01-01' as created_at", "cast(null as string) as browser_id",
    )
    screening.process_and_store(requests, resumes, made)
    before = {n: files(made, n) for n in ("sessions", "candidates")}
    count = made.read("sessions").count()
    assert count and made.read("candidates").count()
    screening.process_and_store(requests, resumes, made)
    for name, old in before.items():
        assert old and old.items() <= files(made, name).items() and len(files(made, name)) > len(old)
    ids = [r["id"] for r in made.read("sessions").select("id").collect()]
    assert sorted(ids) == list(range(1, 2 * count + 1))
    assert {r["session_id"] for r in made.read("candidates").collect()} <= set(ids)


def test_update_writes_the_touched_buckets_only(spark, filled):
    before, old = files(filled, "candidates"), rows(filled.read("candidates"))
    updates = spark.createDataFrame([(7, "Rejected", 1), (7, "Interview", 2), (8, "Hired", 1), (9, "New", 1), (5000, "Rejected", 1)], "id long, new_status string, seq long")
    touched = filled.update_status(updates)
    home = filled.with_buckets("candidates").where("id = 7").first()["bucket"]
    assert touched == [home]  # 8 has no known status, 9 doesn't change, 5000 isn't there
    after = files(filled, "candidates")
    assert {f: t for f, t in before.items() if bucket_of(f) != home} == {f: t for f, t in after.items() if bucket_of(f) != home}
    assert not {f for f in before if bucket_of(f) == home} & set(after)
    assert rows(filled.read("candidates")) == sorted([(*r[:6], "Interview") if r[0] == 7 else r for r in old], key=str)
    assert filled.update_status(updates.limit(0)) == [] and files(filled, "candidates") == after


def test_delete_reads_and_writes_what_it_must(spark, filled):
    everything = {n: filled.read(n) for n in stored.LAYOUTS}
    want = store.delete_sessions(*[spark.createDataFrame(df.collect(), df.schema) for df in everything.values()], gone := spark.createDataFrame([(0,), (11,), (99,), (None,)], "id long"))
    before = {n: files(filled, n) for n in stored.LAYOUTS}
    touched = filled.delete_sessions(gone)
    for name, left in zip(stored.LAYOUTS, want, strict=True):
        assert rows(filled.read(name)) == rows(left.select(filled.read(name).columns))
        unread = {f: t for f, t in before[name].items() if bucket_of(f) not in touched[name]}
        assert unread.items() <= files(filled, name).items()
    assert len(touched["sessions"]) <= 3
    state = {n: rows(filled.read(n)) for n in stored.LAYOUTS}
    filled.delete_sessions(gone)  # once more changes nothing
    assert {n: rows(filled.read(n)) for n in stored.LAYOUTS} == state


def test_a_bucket_that_loses_all_rows_goes(spark, made):
    made.append("sessions", sessions(spark))
    made.append("candidates", with_json(candidates(spark)))
    made.append("notes", notes(spark))
    made.delete_sessions(spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert [made.read(n).count() for n in ("sessions", "candidates")] == [0, 0]
    assert not files(made, "candidates") and not files(made, "sessions")


def test_lookups_prune_buckets_and_row_groups(spark, filled):
    for name, key in (("sessions", 11), ("candidates", 0), ("notes", 17)):
        found, column = filled.lookup(name, key), stored.LAYOUTS[name].key
        assert rows(found) == rows(filled.read(name).where(f"{column} = {key}")) and found.count()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan and f"EqualTo({column},{key})" in plan.replace(" ", "")
        home = filled.with_buckets(name).where(f"{column} = {key}").first()["bucket"]
        assert f"= {home})" in plan
    assert filled.lookup("sessions", 10**6).count() == 0


def test_files_have_bloom_filters_and_order(spark, filled):
    import pyarrow.parquet as pq

    for name, layout in stored.LAYOUTS.items():
        for file in files(filled, name):
            path = f"{filled.path(name)}/{file}"
            keys = pq.read_table(path, columns=[layout.key], partitioning=None).column(0).to_pylist()
            assert keys == sorted(keys)
            sizes = os.path.getsize(path)
            meta = pq.read_metadata(path)
            data = sum(meta.row_group(i).column(c).total_compressed_size for i in range(meta.num_row_groups) for c in range(meta.num_columns))
            assert sizes - data > 1024  # Bloom filters lie between the data and the footer


def test_compaction_keeps_the_rows(spark, made):
    for i in range(4):
        made.append("notes", spark.createDataFrame([(10 * i + k, k, "x", "2024") for k in range(6)], tables.NOTES_SCHEMA))
    before, count = rows(made.read("notes")), len(files(made, "notes"))
    made.compact("notes", list(range(made.buckets)))
    assert rows(made.read("notes")) == before and len(files(made, "notes")) < count


def test_rows_without_a_key_are_kept(spark, made):
    made.append("candidates", spark.createDataFrame([(1, None, "a", None, 1.0, "{}", "New"), (2, 5, "b", None, 1.0, "{}", None)], tables.CANDIDATES_SCHEMA))
    assert made.update_status(spark.createDataFrame([(1, "Rejected", 1), (2, "Rejected", 1)], "id long, new_status string, seq long"))
    assert {r["id"]: r["status"] for r in made.read("candidates").collect()} == {1: "Rejected", 2: "Rejected"}
    made.delete_sessions(spark.createDataFrame([(5,)], "id long"))
    assert [r["id"] for r in made.read("candidates").collect()] == [1]


def test_two_generations_of_files(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.append_evolved(spark.createDataFrame([(1, "a")], "id long, title string"), path)
    old = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*.parquet")}
    stored.append_evolved(spark.createDataFrame([(2, "b", "me")], "id long, title string, owner string"), path)
    assert old.items() <= {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*.parquet")}.items()
    assert rows(stored.evolved(spark, path)) == [(1, "a", None), (2, "b", "me")]
