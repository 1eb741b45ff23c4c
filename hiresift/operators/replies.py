"""Replies of a model, kept so that no request is sent twice.

A request is named by the SHA-256 of the model's label and its messages.  Its reply is stored
under that name, in Parquet files that are only ever added to.  Before the model is called,
the requests that have a reply are taken out by an anti-join, and equal requests are merged;
so a plan that is computed again, a second run, or a run after a broken one asks only for what
is missing.  New requests are sent in rounds of about ``per_round``, each stored by a job of
its own: what a lost task has to ask again lies within one round.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.operators.joins import salted_join
from hiresift.sources.tables import materialize

NAME = "request_sha256"
SCHEMA = f"{NAME} string, reply string, error string, attempts int"


def request_name(model: str, *parts: Column) -> Column:
    """The SHA-256 of a request: JSON keeps the borders of its parts apart."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


class ReplyStore:
    """The replies of one model under a folder that all executors share.

    A request whose attempts all failed is kept with its last error and counts as asked;
    with ``retry_failed`` such requests are sent again.
    """

    def __init__(self, spark: SparkSession, path: str, model: str = "", attempts: int = 3, per_round: int = 100_000, retry_failed: bool = False):
        self.spark, self.path, self.model = spark, path, model
        self.attempts, self.per_round, self.retry_failed = attempts, per_round, retry_failed
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        """One row per request: a reply if there is one, else the error of the last attempt."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        best = F.max_by(F.struct("reply", "error", "attempts"), F.struct(F.col("reply").isNotNull(), "attempts")).alias("kept")
        return rows.groupBy(NAME).agg(best).select(NAME, "kept.*")

    def answered(self, requests: DataFrame, row_key: str | Column, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``requests`` (with ``request_sha256``) with ``reply``, ``error`` and ``attempts``.

        ``call`` makes rows of the store from requests, one of each name.
        """
        known = self.read()
        if self.retry_failed:
            known = known.where("reply is not null")
        payload = [c for c in requests.columns if c != NAME]
        unseen = requests.join(known.select(NAME), NAME, "left_anti")
        wanted = materialize(unseen.groupBy(NAME).agg(F.first(F.struct(*payload)).alias("_r")).select(NAME, "_r.*"))
        rounds = math.ceil(wanted.count() / self.per_round)
        for k in range(rounds):
            part = wanted.where(F.pmod(F.xxhash64(NAME), F.lit(rounds)) == k)
            call(part).write.mode("append").parquet(self.path)
        return salted_join(requests, self.read(), NAME, row_key, "left")
