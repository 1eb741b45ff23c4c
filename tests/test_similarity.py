import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import STOP_WORDS
from hiresift.functions.similarity import pairwise_similarity
from hiresift.functions.text import term_counts
from hiresift.operators.corpus import append_frequencies, corpus_similarity, document_frequencies, stored_frequencies

WORDS = "python data team The and sql cloud built services lead été kafka spark with of go".split()


def counts(text):
    return Counter(w for w in re.findall(r"\w\w+", text.lower()) if w not in set(STOP_WORDS))


def similarities(job, resumes):
    """TF-IDF cosine in percent, vectors written out."""
    docs = [counts(job), *map(counts, resumes)]
    n = len(docs)
    vocabulary = sorted(set().union(*docs))
    idf = {t: math.log((1 + n) / (1 + sum(t in d for d in docs))) + 1 for t in vocabulary}
    rows = [[d[t] * idf[t] for t in vocabulary] for d in docs]

    def norm(v):
        return math.sqrt(sum(x * x for x in v))

    return [
        0.0 if not norm(rows[0]) or not norm(r) else 100 * sum(a * b for a, b in zip(rows[0], r)) / norm(rows[0]) / norm(r)
        for r in rows[1:]
    ]


def random_text(rng, longest):
    return " ".join(rng.choices(WORDS, k=rng.randrange(0, longest)))


def test_pairwise(spark):
    rng = random.Random(6)
    rows = [(i, random_text(rng, 12), random_text(rng, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, job string, own string").select(
        "id", term_counts("job").alias("a"), term_counts("own").alias("b")
    )
    got = {r["id"]: r["s"] for r in df.select("id", pairwise_similarity("a", "b").alias("s")).collect()}
    for i, job, own in rows:
        assert got[i] == pytest.approx(similarities(job, [own])[0], abs=0.0501)
    assert any(v > 0 for v in got.values())


@pytest.mark.parametrize("rows_per_salt, limit", [(1_000_000, None), (5, 0)])
def test_corpus(spark, rows_per_salt, limit):
    rng = random.Random(7)
    jobs = {s: random_text(rng, 15) for s in range(4)} | {4: " "}
    resumes = [(i, 0 if i % 3 == 0 else rng.randrange(5), random_text(rng, 25)) for i in range(120)]
    got = corpus_similarity(
        spark.createDataFrame(resumes, "candidate_id bigint, session_id bigint, raw_text string"),
        spark.createDataFrame(list(jobs.items()), "id bigint, job_description string"),
        rows_per_salt=rows_per_salt,
        broadcast_limit=limit,
    ).collect()
    got = {r["candidate_id"]: r["similarity"] for r in got}
    assert len(got) == len(resumes)
    for s, job in jobs.items():
        own = [(i, t) for i, session, t in resumes if session == s]
        for (i, _), want in zip(own, similarities(job, [t for _, t in own])):
            assert got[i] == pytest.approx(want, abs=0.0501)


def test_corpus_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    jobs = spark.createDataFrame([(s, random_text(rng, 40)) for s in range(3)], "id bigint, job_description string")
    rows = [(i, rng.randrange(3), random_text(rng, 60)) for i in range(200)]
    resumes = spark.createDataFrame(rows, "candidate_id bigint, session_id bigint, raw_text string")
    results = []
    for partitions in (1, 7, 200):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            results.append(sorted(map(tuple, corpus_similarity(resumes.repartition(partitions), jobs, broadcast_limit=0).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1] == results[2]


def test_stored_frequencies_are_added_to(spark, tmp_path):
    rng = random.Random(10)
    jobs = spark.createDataFrame([(s, random_text(rng, 15)) for s in range(3)], "id bigint, job_description string")
    rows = [(i, rng.randrange(3), random_text(rng, 25)) for i in range(90)]
    make = lambda some: spark.createDataFrame(some, "candidate_id bigint, session_id bigint, raw_text string")
    path = str(tmp_path / "df")
    for begin in (0, 30, 60):
        append_frequencies(document_frequencies(make(rows[begin : begin + 30])), path)
    known = stored_frequencies(spark, path)
    assert sorted(map(tuple, known.collect()), key=str) == sorted(map(tuple, document_frequencies(make(rows)).collect()), key=str)
    whole = sorted(map(tuple, corpus_similarity(make(rows), jobs).collect()))
    assert sorted(map(tuple, corpus_similarity(make(rows), jobs, frequencies=known).collect())) == whole
    # The last batch by itself, against the frequencies of all: the session isn't counted again.
    assert sorted(map(tuple, corpus_similarity(make(rows[60:]), jobs, frequencies=known).collect())) == [r for r in whole if r[0] >= 60]
