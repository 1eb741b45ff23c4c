"""Sessions, candidates and notes as stored Parquet tables.

Each table is partitioned by ``bucket``, a hash of the key it is looked up by: sessions by
their id, candidates by their session, notes by their candidate.  Within a bucket rows are
range-partitioned and sorted by that key and the id, so a key with very many rows becomes
several files and row groups with narrow ranges; the columns that single rows are found by
have Bloom filters.  A lookup reads one bucket, of it the row groups that may hold its key.

Appends add files and leave the others alone.  Updates and deletions read and write the
buckets they touch (``partitionOverwriteMode=dynamic``); files of other buckets stay as they
are.  The number of buckets bounds the lists of touched buckets that the driver handles, and is
stored with the tables.  One writer at a time is assumed, as with any plain Parquet folder; a
deletion that breaks off can be repeated, because notes go before candidates and these before
sessions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiresift.operators.joins import lookup_join, salted_join
from hiresift.operators.store import apply_status_updates, latest_status
from hiresift.sources.tables import CANDIDATES_SCHEMA, NOTES_SCHEMA, SESSIONS_SCHEMA, materialize

BUCKET = "bucket"


@dataclass(frozen=True)
class Layout:
    """How a table lies: its columns, the key of its buckets, and the columns with Bloom filters."""

    schema: T.StructType
    key: str
    found_by: tuple[str, ...]

    @property
    def order(self) -> list[str]:
        return [self.key, *(["id"] if self.key != "id" else [])]


LAYOUTS = {
    "sessions": Layout(SESSIONS_SCHEMA, "id", ("id", "browser_id")),
    "candidates": Layout(CANDIDATES_SCHEMA, "session_id", ("id", "session_id")),
    "notes": Layout(NOTES_SCHEMA, "candidate_id", ("candidate_id",)),
}


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class StoredTables:
    """The three tables under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, rows_per_file: int = 5_000_000):
        self.spark, self.root, self.rows_per_file = spark, root.rstrip("/"), rows_per_file
        self.buckets = self._create(buckets)

    def _create(self, buckets: int) -> int:
        """Make the tables that aren't there; the number of buckets is that of the first creation."""
        place, system = _file_system(self.spark, f"{self.root}/layout")
        if not system.exists(place):
            for name, layout in LAYOUTS.items():
                empty = self.spark.createDataFrame([], T.StructType([*layout.schema.fields, T.StructField(BUCKET, T.IntegerType())]))
                empty.write.mode("ignore").partitionBy(BUCKET).parquet(self.path(name))
            self.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.root}/layout")
        return self.spark.read.schema("buckets int").parquet(f"{self.root}/layout").first()["buckets"]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(self.buckets)).cast("int")

    # --- reads ------------------------------------------------------------------------------
    def with_buckets(self, name: str) -> DataFrame:
        schema = T.StructType([*LAYOUTS[name].schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """The table as it is now; a frame made before a change must not be used after it."""
        return self.with_buckets(name).drop(BUCKET)

    def lookup(self, name: str, key: int) -> DataFrame:
        """Rows of one session, of one session's candidates, or of one candidate's notes."""
        wanted = F.lit(key).cast("long")
        return self.with_buckets(name).where((F.col(BUCKET) == self.bucket_of(wanted)) & (F.col(LAYOUTS[name].key) == wanted)).drop(BUCKET)

    # --- writes -----------------------------------------------------------------------------
    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        layout = LAYOUTS[name]
        order = [BUCKET, *layout.order]
        placed = rows.select(*[F.col(f.name).cast(f.dataType) for f in layout.schema.fields]).withColumn(BUCKET, self.bucket_of(F.col(layout.key)))
        writer = (
            placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode)
            .partitionBy(BUCKET).option("maxRecordsPerFile", self.rows_per_file)
            .option("partitionOverwriteMode", "dynamic")
        )
        for column in layout.found_by:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, "append")

    def _rewrite(self, name: str, buckets: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of some buckets; a bucket without rows afterwards is removed."""
        if not buckets:
            return
        changed = change(self.with_buckets(name).where(F.col(BUCKET).isin(buckets)).drop(BUCKET))
        filled = {r[BUCKET] for r in changed.select(self.bucket_of(F.col(LAYOUTS[name].key)).alias(BUCKET)).distinct().collect()}
        if filled:
            self._write(name, changed, "overwrite")
        for bucket in set(buckets) - filled:
            place, system = _file_system(self.spark, f"{self.path(name)}/{BUCKET}={bucket}")
            system.delete(place, True)

    def compact(self, name: str, buckets: list[int]) -> None:
        """Merge the small files that many appends leave in some buckets."""
        self._rewrite(name, buckets, lambda rows: rows)

    def update_status(self, updates: DataFrame) -> list[int]:
        """Apply ``updates(id, new_status, seq)``; gives the buckets that were written.

        Which buckets hold a candidate that changes is found from three columns of the table.
        """
        updates = materialize(latest_status(updates).select("id", F.col("_new").alias("new_status"), F.lit(0).alias("seq")))
        here = self.with_buckets("candidates").select("id", "status", BUCKET).join(updates, "id")
        changed = here.where(F.col("new_status") != F.coalesce("status", F.lit(""))).select(BUCKET).distinct()
        touched = sorted(r[BUCKET] for r in changed.collect())
        self._rewrite("candidates", touched, lambda rows: apply_status_updates(rows, updates).drop("changed"))
        return touched

    def delete_sessions(self, deleted: DataFrame, **options) -> dict[str, list[int]]:
        """Delete the sessions ``deleted(id)`` with their candidates and those's notes; gives the buckets read."""
        ids = materialize(deleted.select(F.col("id").cast("long").alias("session_id")).where("session_id is not null").distinct())
        touched = self._buckets_of(ids, "session_id")
        theirs = self.with_buckets("candidates").where(F.col(BUCKET).isin(touched)).select("id", "session_id")
        gone = materialize(
            lookup_join(theirs, ids, "session_id", "id", "left_semi", **options).select(F.col("id").alias("candidate_id")).distinct()
        )
        noted = self._buckets_of(gone, "candidate_id")
        self._rewrite("notes", noted, lambda rows: salted_join(rows, gone, "candidate_id", "id", "left_anti"))
        self._rewrite("candidates", touched, lambda rows: lookup_join(rows, ids, "session_id", "id", "left_anti", **options))
        self._rewrite("sessions", touched, lambda rows: rows.join(ids.withColumnRenamed("session_id", "id"), "id", "left_anti"))
        return {"sessions": touched, "candidates": touched, "notes": noted}

    def _buckets_of(self, keys: DataFrame, key: str) -> list[int]:
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(key))).distinct().collect())


def evolved(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files are of several generations: columns that older files lack are NULL there."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def append_evolved(rows: DataFrame, path: str) -> None:
    """Add rows with further columns to a table; its old files stay as they are."""
    rows.write.mode("append").parquet(path)
