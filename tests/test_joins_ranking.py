import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hiresift.operators import ranking
from hiresift.operators.joins import lookup_join, measured_bytes, salted_join


def skewed(spark, n=3000):
    rng = random.Random(8)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(40), rng.randrange(0, 60) / 10) for i in range(n)]
    return spark.createDataFrame(rows, "candidate_id bigint, session_id bigint, overall double").cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_salt", [7, 200, 10**6])
def test_salted_join_equals_plain_join(spark, how, rows_per_salt):
    fact = skewed(spark)
    lookup = spark.range(0, 50, 2).select(F.col("id").alias("session_id"), (F.col("id") * 2).alias("v"))
    got = salted_join(fact, lookup, "session_id", "candidate_id", how, rows_per_salt=rows_per_salt)
    want = fact.join(lookup, "session_id", how)
    assert got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect())


def test_counts_kept_with_the_lookup(spark):
    fact = skewed(spark)
    lookup = fact.groupBy("session_id").agg(F.max("overall").alias("top"), F.count(F.lit(1)).alias("_n"))
    got = salted_join(fact, lookup, "session_id", "candidate_id", sizes="_n", rows_per_salt=50)
    assert sorted(got.collect()) == sorted(fact.join(lookup.drop("_n"), "session_id").collect())


def test_hot_keys_are_spread(spark):
    fact = skewed(spark).repartition(1)
    lookup = fact.select("session_id").distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(fact, lookup, "session_id", "candidate_id", rows_per_salt=50)
        tasks = joined.where("session_id = 0").select(F.spark_partition_id()).distinct().count()
        joined_plainly = fact.join(lookup, "session_id")
        assert joined_plainly.where("session_id = 0").select(F.spark_partition_id()).distinct().count() == 1
        assert tasks > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_only_below_the_limit(spark):
    fact = skewed(spark)
    lookup = spark.range(50).select(F.col("id").alias("session_id"), F.lit("x" * 100).alias("text"))
    assert measured_bytes(lookup) >= 50 * 100

    def plan(limit):
        joined = lookup_join(fact, lookup, "session_id", "candidate_id", broadcast_limit=limit)
        return joined._jdf.queryExecution().optimizedPlan().toString()

    assert "_salt" not in plan(10**6)
    assert "_salt" in plan(1000)


@pytest.mark.parametrize("spacing", ["running", "sparse", "huge"])
@pytest.mark.parametrize("block_rows", [13, 500, 10**6])
def test_rank_equals_plain_window(spark, spacing, block_rows):
    ids = {"running": "candidate_id", "sparse": "candidate_id * candidate_id * 1000 - 5000000",
           "huge": "xxhash64(candidate_id)"}[spacing]
    df = skewed(spark).withColumn("candidate_id", F.expr(ids))
    order = Window.partitionBy("session_id").orderBy(F.desc("overall"), "candidate_id")
    want = df.withColumn("rank", F.row_number().over(order).cast("bigint"))
    got = ranking.rank_within_sessions(df, block_rows=block_rows)
    columns = ["session_id", "candidate_id", "overall", "rank"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


@pytest.mark.parametrize("block_rows", [13, 10**6])
def test_number_rows(spark, block_rows):
    df = skewed(spark).select((F.col("candidate_id") * 17 % 3001).alias("key"))
    got = ranking.number_rows(df, "key", F.lit(100), block_rows).collect()
    keys = sorted(r["key"] for r in got)
    assert {r["key"]: r["_number"] for r in got} == {k: 101 + i for i, k in enumerate(keys)}


def test_top_k_min_score_and_bands(spark):
    df = skewed(spark)
    ranked = ranking.rank_within_sessions(df)
    top = ranking.top_k(df, 3).select("session_id", "rank", "candidate_id").collect()
    best = ranked.where("rank <= 3").select("session_id", "rank", "candidate_id").collect()
    assert sorted(top) == sorted(best)
    assert "WindowGroupLimit" in ranking.top_k(df, 3)._jdf.queryExecution().executedPlan().toString()
    kept = {r["candidate_id"]: r["rank"] for r in ranking.min_score(ranked, 4).collect()}
    full = {r["candidate_id"]: r["rank"] for r in ranked.where("overall >= 4").collect()}
    assert kept == full
    bands = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (59.9,)], "s double")
    assert [r[0] for r in bands.select(ranking.score_band(F.col("s"))).collect()] == ["high", "mid", "mid", "low"]


def test_no_window_over_a_whole_session(spark):
    """Windows of the ranking group by more than the session, or run over counts."""
    plan = ranking.rank_within_sessions(skewed(spark), block_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert windows and all("_block" in line for line in windows)


def test_candidates_without_session_or_score_are_kept_unranked(spark):
    rows = [(1, 5, 80.0), (2, 5, 90.0), (3, None, 70.0), (4, 5, None), (5, None, None)]
    df = spark.createDataFrame(rows, "candidate_id bigint, session_id bigint, overall double")
    got = {r["candidate_id"]: r["rank"] for r in ranking.rank_within_sessions(df).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: None, 5: None}


def test_null_keys_are_spread_and_meet_nothing(spark):
    fact = spark.createDataFrame([(i, None if i % 2 else i % 6) for i in range(300)], "row bigint, k bigint")
    lookup = spark.createDataFrame([(0, "a"), (2, "b"), (None, "x")], "k bigint, v string")
    for how, n in (("inner", 100), ("left", 300), ("left_semi", 100), ("left_anti", 200)):
        for per in (1_000_000, 10):
            assert salted_join(fact, lookup, "k", "row", how, rows_per_salt=per).count() == n


def test_an_outlying_id_does_not_fill_one_block(spark):
    df = spark.range(1000).selectExpr("case when id = 999 then 1000000000000 else id end as id")
    blocks = ranking.with_blocks(df, "id", 100)
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 1000
    rows = sorted((r["_block"], r["id"]) for r in blocks.collect())
    assert [i for _, i in rows] == sorted(i for _, i in rows)
