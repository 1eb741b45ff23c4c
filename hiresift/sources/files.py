"""Folders of text files: every file is either read or rejected with a reason.

Names come from the file index, which Spark keeps on the driver for every scan of files and
which alone knows empty files.  Sizes are listed without opening the files, contents are read
apart, and what could not be read shows as a listed file without contents.  Decoding is strict
and an expression of the JVM, so a damaged file harms no other one.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.functions.text import is_blank
from hiresift.sources.tables import materialize

UNREADABLE, EMPTY, NO_TEXT, BLANK = (
    "the file could not be read", "the file is empty", "the file is not UTF-8 text", "no text could be extracted",
)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, filename, raw_text, reject_reason)`` of the folder's files and those of its subfolders; reject_reason is NULL for good ones.

    ``pattern`` is a glob on file names.  A byte order mark is left out of the text.
    """

    # One listing serves all three reads.  Only reading contents can find a corrupt file; it is left out there.
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    index = found.option("ignoreCorruptFiles", "true").load(folder)
    # An empty authority is written as three slashes there and as one in the column.
    names = spark.createDataFrame([(unquote(p).replace(":///", ":/", 1),) for p in index.inputFiles()], "path string")
    filled = index.select("path", F.lit(True).alias("_filled"))  # nothing of the contents is asked for, so no file is opened
    listed = names.join(filled, "path", "left")
    contents = index.select("path", F.col("content").cast("string").alias("_bytes"))
    text = F.regexp_replace(F.try_validate_utf8("_bytes"), "^\\x{FEFF}", "")
    read = contents.select("path", F.lit(True).alias("_read"), text.alias("raw_text"))
    reason = (
        F.when(F.col("_filled").isNull(), EMPTY).when(F.col("_read").isNull(), UNREADABLE)
        .when(F.col("raw_text").isNull(), NO_TEXT).when(is_blank(F.col("raw_text")), BLANK)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return listed.join(read, "path", "left").select("path", name.alias("filename"), "raw_text", reason.alias("reject_reason"))


def good_and_rejected(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(filename, raw_text)`` of the good files, and path, filename and reason of the others; the scan is done once."""
    scanned = materialize(scanned)
    good = scanned.where("reject_reason is null").select("filename", "raw_text")
    return good, scanned.where("reject_reason is not null").select("path", "filename", "reject_reason")
