"""Documents to packed training sequences, in five stages.

Every stage reads all that the one before kept, and its decisions take effect: documents of
no learned language go, repeated lines go, one document of each group of near copies stays,
secrets are masked, and what is left becomes sequences of token ids.  All stages but the last
return the columns of ``documents``; ``n_chars`` follows the text.

A document that has lost all its words to line dedup goes too; one that had none before stays.
Rows with one doc_id and different texts are judged one by one, and so are rows without an id; of
near copies among them one row stays.  Equal rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm import language_id, line_dedup, ngram_join, packing, secret_scan
from hiresift.sources.tables import drop, scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _documents(df: DataFrame) -> DataFrame:
    counted = df.withColumn("n_chars", F.char_length("text").cast("long"))
    return counted.select(*COLUMNS)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that language ID rejects (``und``); a missing lang is filled with the prediction."""
    judged = language_id.identify(docs.select(*COLUMNS), language_id.learn(docs))
    return judged.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_whole(docs.select(*COLUMNS))
    emptied = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(line_dedup.BLANKS)) == "")
    return _documents(left.where(~F.coalesce(emptied, F.lit(False))))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents, that of the smallest doc_id; of equal ids that of the smallest text hash."""
    return ngram_join.first_of_groups(docs.select(*COLUMNS), size=NEAR_WORDS, percent=NEAR_PERCENT).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan_secrets(docs.select(*COLUMNS))
    return _documents(scanned.withColumn("text", F.col("masked_text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences."""
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", by_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_near_copies),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Learned statistics and token ids can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage stored for itself, and the documents it read, are deleted once its own are stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scope(spark) as made:
            read, docs = docs, made.keep(stage(spark, docs, sf_dir))
        drop(read)
    return STAGES[-1][1](spark, docs, sf_dir)
