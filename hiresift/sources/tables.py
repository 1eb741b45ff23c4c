"""Schemas, readers, exports and the shared-folder cut used between costly steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiresift.functions.text import is_blank

SESSIONS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("job_title", T.StringType()),
        T.StructField("job_description", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("browser_id", T.StringType()),
    ]
)
CANDIDATES_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("overall_score", T.DoubleType()),
        T.StructField("data_json", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
NOTES_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("candidate_id", T.LongType()),
        T.StructField("note_text", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)
_SCORES = ["overall", "skills", "experience", "education", "certifications", "projects"]
_LISTS = [
    "matched_skills", "missing_skills", "education_details", "experience_details",
    "certifications_details", "projects_details", "all_skills",
]
SCORED_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("email", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in _SCORES]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS]
)


def read_resume_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file of a folder: ``filename``, ``raw_text``."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"),
        F.col("value").alias("raw_text"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row-wise work on a table that comes as one small file.

    A table with at least as many splits as cores is left alone, so this never
    shuffles a large one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def readable(resumes: DataFrame) -> DataFrame:
    return resumes.where(~is_blank(F.col("raw_text")))


def unreadable(resumes: DataFrame) -> DataFrame:
    """The rejects of an ingest, with the reason; the rest goes on unharmed."""
    return resumes.where(is_blank(F.col("raw_text"))).withColumn(
        "reject_reason", F.lit("no text could be extracted")
    )


_written: list[str] = []
_persisted: list[DataFrame] = []


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share, as the session names it."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; only where none is set, as in tests, in a local one.  ``release`` removes it."""
    base = shared_folder(spark) or tempfile.mkdtemp(prefix="hiresift-")
    _written.append(f"{base.rstrip('/')}/hiresift-{uuid.uuid4().hex}")
    return _written[-1]


def materialize(df: DataFrame) -> DataFrame:
    """Compute a costly intermediate once.

    With a shared folder (``spark.checkpoint.dir``) it is written there as Parquet and
    read back: the copy survives lost executors, and each later pass reads only the
    columns it needs.  Without one it is persisted in memory and on disk with its
    lineage, so a lost part is computed again.  Both ways hold on every master.
    ``drop``, ``scope`` and ``release`` remove the copies.
    """
    spark = df.sparkSession
    if shared_folder(spark) is None:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        _persisted.append(kept)
        return kept
    path = new_folder(spark)
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy.stored_at = path
    return copy


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(copy: DataFrame) -> None:
    """Give up one copy that ``materialize`` made, when nothing reads it any more."""
    path = getattr(copy, "stored_at", None)
    if path in _written:
        _written.remove(path)
        _delete(copy.sparkSession, path)
    elif any(copy is p for p in _persisted):
        _persisted[:] = [p for p in _persisted if p is not copy]
        copy.unpersist()


class scope:
    """A step whose intermediates are given up at its end; ``keep`` stores what stays."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scope:
        self.written, self.persisted, self.kept = list(_written), list(_persisted), []
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(materialize(df))
        if shared_folder(self.spark) is None:
            self.kept[-1].count()  # computed while its intermediates are there
        return self.kept[-1]

    def __exit__(self, *failure) -> None:
        stay = [*self.written, *(getattr(k, "stored_at", None) for k in self.kept)]
        for path in [p for p in _written if p not in stay]:
            _written.remove(path)
            _delete(self.spark, path)
        for copy in [p for p in _persisted if not any(p is k for k in [*self.persisted, *self.kept])]:
            drop(copy)


def release(spark: SparkSession) -> None:
    """Delete the copies this process made, once the results built on them are stored."""
    while _persisted:
        _persisted.pop().unpersist()
    while _written:
        _delete(spark, _written.pop())


def export_rankings(table: DataFrame, path: str, max_rows_per_file: int = 1_000_000) -> None:
    """Rankings as CSV, one folder per session, rows in rank order.

    Rows are range-partitioned on (session, rank), so a large session becomes
    several files in order instead of one task's work.
    """
    (
        table.repartitionByRange("session_id", "rank")
        .sortWithinPartitions("session_id", "rank")
        .write.option("header", True)
        .option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy("session_id")
        .mode("overwrite")
        .csv(path)
    )


def export_reports(lines: DataFrame, path: str) -> None:
    """Report lines as text, one folder per session and report name, in line order.

    The order begins with the folder columns, so writing by folder needs no other sort.
    """
    order = ["session_id", "file_name", "rank", "line_no"]
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("session_id", "file_name", "line")
        .write.partitionBy("session_id", "file_name")
        .mode("overwrite")
        .text(path)
    )
