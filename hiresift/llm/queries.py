"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hiresift.llm import bpe, conversation_repair, embedding_dedup, hard_negatives, language_id, line_dedup, ngram_join, packing, quality, secret_scan, substring_dedup, tree_bpe, url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        substring_dedup.op1_substring_dedup,
        packing.op2_packing,
        language_id.op3_language_id,
        line_dedup.op4_line_dedup,
        embedding_dedup.op5_embedding_dedup,
        bpe.op6_bpe_codec,
        quality.op7_quality_rules,
        secret_scan.op8_secret_scan,
        ngram_join.op9_ngram_join,
        url_filter.op10_url_filter,
        conversation_repair.op11_conversation_repair,
        hard_negatives.op12_hard_negatives,
        tree_bpe.op13_tree_bpe,
    ]
    return {f.__name__: f for f in [*found, pipeline]}


def oracle_sql() -> dict[str, str]:
    return {**substring_dedup.SQL, **line_dedup.SQL, **embedding_dedup.SQL, **ngram_join.SQL, **url_filter.SQL, **conversation_repair.SQL, **hard_negatives.SQL}
