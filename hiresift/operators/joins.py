"""Joins of a large table to a table with one row per key, safe under hot keys.

Any key may hold a large share of the fact rows (a posting that attracts a third
of all applications).  ``lookup_join`` broadcasts the small side only when its
measured size is under a limit; beyond that, ``salted_join`` spreads each hot key
over several shuffle partitions and repeats only the matching lookup rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
ROWS_PER_SALT = 1_000_000
NULL_SALTS = 1024
_SALT = "_salt"
_SALTS = "_salts"


def measured_bytes(df: DataFrame) -> int:
    """Size of a table's values, measured by an aggregate over it (not estimated)."""
    per_row = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.typeName() == "string":
            per_row = per_row + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif f.dataType.typeName() in ("array", "struct", "map"):
            per_row = per_row + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row.cast("bigint")), F.lit(0)).alias("b")).first()["b"]


def rows_per_key(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts per key; partial counts are merged before the shuffle."""
    return fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def salted_join(
    fact: DataFrame,
    lookup: DataFrame,
    keys: str | list[str],
    row_key: str | Column,
    how: str = "inner",
    sizes: DataFrame | str | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Shuffle join of ``fact`` to ``lookup`` (unique on ``keys``) with hot keys split.

    ``how`` may be inner, left, left_semi or left_anti: each fact row meets exactly
    one copy of its lookup row, so the result equals the plain join.  ``sizes`` may
    be a frame (keys + ``_n``) from a cheaper source than ``fact``, or the name of a
    column of ``lookup`` that already counts the fact rows of each key (dropped from
    the result).  The list of hot keys has at most (fact rows / rows_per_salt)
    entries, so it is always small enough to broadcast.
    """
    keys = [keys] if isinstance(keys, str) else keys
    row_key = F.col(row_key) if isinstance(row_key, str) else row_key

    def salts_for(n: Column) -> Column:
        return F.ceil(n / rows_per_salt).cast("int")

    if isinstance(sizes, str):
        counted = lookup.select(*keys, F.col(sizes).alias("_n"))
        lookup = lookup.withColumn(_SALTS, salts_for(F.greatest(F.col(sizes), F.lit(1)))).drop(sizes)
    else:
        counted = rows_per_key(fact, keys) if sizes is None else sizes
    hot = F.broadcast(
        counted.where(F.col("_n") > rows_per_salt).select(*keys, salts_for(F.col("_n")).alias(_SALTS))
    )
    if _SALTS not in lookup.columns:
        lookup = lookup.join(hot, keys, "left")
    salts = F.coalesce(F.col(_SALTS), F.lit(1))
    # A NULL key meets nothing, so its rows may go anywhere; outer and anti joins keep them.
    nowhere = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    own = F.when(nowhere, F.lit(NULL_SALTS)).otherwise(salts)
    salted_fact = (
        fact.join(hot, keys, "left")
        .withColumn(_SALT, F.pmod(F.xxhash64(row_key), own).cast("int"))
        .drop(_SALTS)
    )
    salted_lookup = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), salts - 1))).drop(_SALTS)
    return salted_fact.join(salted_lookup, [*keys, _SALT], how).drop(_SALT)


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    keys: str | list[str],
    row_key: str | Column,
    how: str = "inner",
    sizes: DataFrame | None = None,
    broadcast_limit: int | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join to a one-row-per-key table: broadcast if measured small, else salted shuffle."""
    limit = BROADCAST_LIMIT_BYTES if broadcast_limit is None else broadcast_limit
    keys = [keys] if isinstance(keys, str) else keys
    if limit > 0 and measured_bytes(lookup) <= limit:
        return fact.join(F.broadcast(lookup), keys, how)
    return salted_join(fact, lookup, keys, row_key, how, sizes, rows_per_salt)
