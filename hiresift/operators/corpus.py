"""TF-IDF similarity of résumés to their job description, weighted over the session.

Unlike the pairwise form, document frequencies come from the whole session: its
résumés and its job description.  Common terms of a large session are hot keys;
their frequency is known before the join, so they are split without another count.

Sums are exact decimals and don't depend on the order of a shuffle.  Document frequencies can
be kept as a table and added to, so that new résumés don't recount their session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.functions.similarity import percent
from hiresift.functions.text import term_counts, term_rows
from hiresift.operators.joins import ROWS_PER_SALT, lookup_join, salted_join
from hiresift.sources.tables import materialize


#: Squared weights are rounded to twelve places, so that sums are exact in any order.
WEIGHT = "decimal(24,12)"
FREQUENCIES = "session_id bigint, term string, df bigint"


def _counted_terms(resumes: DataFrame) -> DataFrame:
    """One compact row per résumé; opened into terms where they are needed."""
    return resumes.select("candidate_id", "session_id", term_counts("raw_text").alias("terms"))


def document_frequencies(resumes: DataFrame) -> DataFrame:
    """``(session_id, term, df)``: how many résumés of a session hold a term; the row without term counts them all.

    Frequencies of further résumés are added to these; nothing is counted twice.
    """
    counts = _counted_terms(resumes)
    every = F.concat(F.col("terms.terms"), F.array(F.lit(None).cast("string")))
    # A term occurs once per document in ``terms``, so rows are document counts.
    return counts.select("session_id", F.explode(every).alias("term")).groupBy("session_id", "term").agg(F.count(F.lit(1)).alias("df"))


def append_frequencies(frequencies: DataFrame, path: str) -> None:
    """Add the frequencies of new résumés to a stored table; the old files stay as they are."""
    frequencies.write.mode("append").parquet(path)


def stored_frequencies(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(FREQUENCIES).parquet(path)
    return rows.groupBy("session_id", "term").agg(F.sum("df").alias("df"))


def corpus_similarity(
    resumes: DataFrame, sessions: DataFrame, rows_per_salt: int = ROWS_PER_SALT, frequencies: DataFrame | None = None, **options
) -> DataFrame:
    """``(candidate_id, session_id, similarity)`` for every résumé.

    ``frequencies`` are those of the sessions' résumés, these included, if they are known already.
    """
    counts = materialize(_counted_terms(resumes))
    terms = counts.select("candidate_id", "session_id", term_rows("terms"))
    jobs = sessions.select(
        F.col("id").alias("session_id"), term_counts("job_description").alias("terms")
    ).select("session_id", term_rows("terms"))
    key = ["session_id", "term"]
    known = materialize(document_frequencies(resumes)) if frequencies is None else frequencies

    documents = known.where("term is null").select("session_id", (F.col("df") + 1).alias("n_docs"))
    counted = (
        known.where("term is not null").select(*key, "df", F.col("df").alias("in_resumes"), F.lit(0).alias("job_tf"))
        .unionByName(jobs.select(*key, F.lit(1).alias("df"), F.lit(0).alias("in_resumes"), F.col("tf").alias("job_tf")))
        .groupBy(*key)
        .agg(F.sum("df").alias("df"), F.sum("in_resumes").alias("_n"), F.sum("job_tf").alias("job_tf"))
    )
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    # Stored, because the norms, the list of hot terms and the join each read a part of it.
    vocabulary = materialize(
        lookup_join(
            counted, documents, "session_id", "term", rows_per_salt=rows_per_salt, **options
        ).select(*key, "_n", "job_tf", F.round(idf * idf, 12).cast(WEIGHT).alias("w2"))
    )

    def weighted(a: str, b: str) -> Column:
        return F.sum((F.col(a) * F.col(b)).cast("decimal(12,0)") * F.col("w2"))

    job_norms = vocabulary.groupBy("session_id").agg(weighted("job_tf", "job_tf").alias("job_norm2"))
    per_resume = (
        salted_join(
            terms,
            vocabulary.where(F.col("_n") > 0),
            key,
            "candidate_id",
            sizes="_n",
            rows_per_salt=rows_per_salt,
        )
        .groupBy("candidate_id")
        .agg(weighted("tf", "job_tf").alias("dot"), weighted("tf", "tf").alias("norm2"))
    )
    scored = lookup_join(
        counts.select("candidate_id", "session_id"),
        job_norms,
        "session_id",
        "candidate_id",
        "left",
        rows_per_salt=rows_per_salt,
        **options,
    ).join(per_resume, "candidate_id", "left")
    dot, norm2, job_norm2 = (F.col(c).cast("double") for c in ("dot", "norm2", "job_norm2"))
    cosine = F.when(dot > 0, dot / F.sqrt(norm2 * job_norm2))
    return scored.select(
        "candidate_id", "session_id", F.coalesce(percent(cosine), F.lit(0.0)).alias("similarity")
    )
