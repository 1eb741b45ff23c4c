"""Folders with damaged files: each is told apart, good ones go on."""

from hiresift.sources import files


def folder(path):
    def put(name, data):
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(data)

    put("good.txt", "Ann Müller\nline 2\r\n".encode())
    put("sub/deep/other.txt", b"x")
    put("with spaces ä.txt", b"spaces")
    put("mark.txt", b"\xef\xbb\xbfmarked")
    put("empty.txt", b"")
    put("blank.txt", b" \n\t \xc2\xa0")
    put("latin.txt", "Jos\xe9".encode("latin-1"))
    put("binary.txt", b"%PDF-1.4\x00\xff\xfe\x80")
    put("cut.txt", "né".encode()[:-1])
    put("broken.txt", b"the contents")
    put(".broken.txt.crc", b"crc\x00\x00\x00\x02\x00\x01\x02\x03\x04")  # a checksum that the contents don't have
    put("note.md", b"not asked for")
    return str(path)


WANT = {
    "good.txt": ("Ann Müller\nline 2\r\n", None), "other.txt": ("x", None), "with spaces ä.txt": ("spaces", None), "mark.txt": ("marked", None),
    "empty.txt": (None, files.EMPTY), "blank.txt": (" \n\t \xa0", files.BLANK), "latin.txt": (None, files.NO_TEXT),
    "binary.txt": (None, files.NO_TEXT), "cut.txt": (None, files.NO_TEXT), "broken.txt": (None, files.UNREADABLE),
}


def test_every_file_is_read_or_rejected(spark, tmp_path):
    scanned = files.scan_files(spark, folder(tmp_path), "*.txt")
    assert {r["filename"]: (r["raw_text"], r["reject_reason"]) for r in scanned.collect()} == WANT
    good, rejected = files.good_and_rejected(scanned)
    assert {r["filename"]: r["raw_text"] for r in good.collect()} == {n: t for n, (t, e) in WANT.items() if e is None}
    assert {r["filename"]: r["reject_reason"] for r in rejected.collect()} == {n: e for n, (_, e) in WANT.items() if e}
    assert "note.md" in {r["filename"] for r in files.scan_files(spark, str(tmp_path)).collect()}


def test_contents_are_asked_for_once(spark, tmp_path):
    plan = files.scan_files(spark, folder(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<path:string,content:binary>") == 1 and "ReadSchema: struct<path:string>" in plan


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert files.scan_files(spark, str(tmp_path)).collect() == []


def test_good_files_are_parsed(spark, tmp_path):
    from pyspark.sql import functions as F

    from hiresift.plans import screening

    good, _ = files.good_and_rejected(files.scan_files(spark, folder(tmp_path), "*.txt"))
    numbered = good.select(F.xxhash64("filename").alias("candidate_id"), F.lit(1).cast("bigint").alias("session_id"), "filename", "raw_text")
    names = {r["filename"]: r["name"] for r in screening.parse_resumes(numbered).collect()}
    assert names == {"good.txt": "Ann Müller", "other.txt": "x", "with spaces ä.txt": "spaces", "mark.txt": "marked"}


def test_many_small_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """However few bytes they have, files are not all written by one task; each is still read or rejected."""
    import __spark_entry__ as entry_points

    spark.range(600).selectExpr("id as s_suppkey", "concat('S', id) as s_name", "cast(id as int) as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(entry_points.tables, "new_folder", lambda _: str(tmp_path / "files"))
    scanned = entry_points.scan_files(spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in scanned) == list(range(600))
    assert {r["id"] for r in scanned if r["reject_reason"] == files.NO_TEXT} == {i for i in range(600) if i % 7 == 1}
    assert len({f.name.split("-")[1] for f in (tmp_path / "files").glob("*/part-*")}) >= 4
