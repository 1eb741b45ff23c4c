"""Connected components of a table of links, by alternating star contractions.

Each round points every node at the smallest node it knows of (large star), then ties the
nodes it was linked with together (small star), until nothing changes; the number of rounds
grows with the logarithm of a component's size.  Minima are aggregates, merged before the
shuffle, and a node with very many links is split by a salted join.  Rounds are cut by
``materialize``; nothing but two sums comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.operators.joins import ROWS_PER_SALT, salted_join
from hiresift.sources.tables import materialize


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _meet(links: DataFrame, low: DataFrame, n: int, rows_per_salt: int) -> DataFrame:
    """Every link with the smallest neighbour of its ``u``; so few links in all that none is hot need no salt."""
    if n <= rows_per_salt:
        return links.join(low.drop("_rows"), "u")
    return salted_join(links, low, "u", "v", sizes="_rows", rows_per_salt=rows_per_salt)


def components(links: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); component is its smallest node.

    Links may repeat, point either way, and join a node to itself.
    """
    links = materialize(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_rows"))
        large = _meet(both.where("v >= u"), low, now[0], rows_per_salt)
        links = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.where("m <= u").select("u", F.col("m").alias("v"))
        ).distinct())
        low = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows"))
        small = _meet(links, low, now[0], rows_per_salt)
        links = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
