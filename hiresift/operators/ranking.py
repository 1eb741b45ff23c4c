"""Ranking within a session without ever sorting a whole session in one task.

A session may hold a third of all candidates, so a single window per session is
out.  Scores have one decimal between 0 and 100 (at most 1,001 values) and ids
fall into blocks of consecutive values; a rank is the number of candidates with a higher score, plus
those with the same score in earlier blocks, plus the position inside the block.
The first two come from small running counts, the last from a window over at
most ``block_rows`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import LOWEST_BAND, SCORE_BANDS
from hiresift.sources.tables import materialize

BLOCK_ROWS = 1_000_000
MOST_SPLITS = 20  # each cuts an over-full block's own range into at least two


def _step(id_col: str, low: Column, high: Column, n: Column, block_rows: int) -> Column:
    """Which of equal steps from low to high an id is in, as many as blocks are needed."""
    width = F.greatest(F.lit(1.0), (high.cast("double") - low.cast("double") + 1.0) / F.ceil(n / block_rows))
    return F.floor((F.col(id_col).cast("double") - low.cast("double")) / width).cast("bigint")


def with_blocks(df: DataFrame, id_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block``, an array that never decreases with the id, for about ``block_rows`` ids each.

    The id range is cut into equal steps.  A block that is still too full, as beside an
    outlying id, is cut again by its own range, and so on; ids that are equal stay together.
    Only numbers per over-full block are read, and none if the table is small.
    """
    low, high, n = df.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1))).first()
    known = F.col(id_col).isNotNull()
    if n <= block_rows:
        return df.withColumn("_block", F.when(known, F.array(F.lit(0).cast("bigint"))))
    first = _step(id_col, F.lit(low), F.lit(high), F.lit(n), block_rows)
    keyed = df.withColumn("_block", F.when(known, F.array(first)))
    for _ in range(MOST_SPLITS):
        sizes = keyed.where(known).groupBy("_block").agg(
            F.count(F.lit(1)).alias("_rows"), F.min(id_col).alias("_low"), F.max(id_col).alias("_high")
        )
        full = materialize(sizes.where((F.col("_rows") > block_rows) & (F.col("_high") > F.col("_low"))))
        if full.isEmpty():
            break
        cut = _step(id_col, F.col("_low"), F.col("_high"), F.col("_rows"), block_rows)
        finer = F.when(F.col("_rows").isNotNull(), F.concat("_block", F.array(cut))).otherwise(F.col("_block"))
        keyed = keyed.join(F.broadcast(full), "_block", "left").withColumn("_block", finer).drop("_rows", "_low", "_high")
    return keyed


def _before(window) -> Column:
    """Sum of ``_n`` over the rows before the current one."""
    running = F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(running, F.lit(0))


def rank_within_sessions(
    scored: DataFrame,
    score: str = "overall",
    id_col: str = "candidate_id",
    session: str = "session_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``rank``: 1-based, by descending score, then ascending id (ids are unique).

    Without a session or a score a candidate is kept, with a NULL rank.

    ``scored`` is read several times, mostly for three columns only; pass a stored
    table, or a frame cut by ``materialize``, when it is costly to compute.
    """
    keys = [session, score, "_block"]
    keyed = with_blocks(scored, id_col, block_rows)
    # Said once here, the joins below need no filters of their own, which would differ
    # and keep the two uses of these counts from sharing one shuffle.
    present = F.col(session).isNotNull() & F.col(score).isNotNull() & F.col("_block").isNotNull()
    blocks = keyed.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    scores = (
        blocks.groupBy(session, score)
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_higher", _before(Window.partitionBy(session).orderBy(F.desc(score))))
        .drop("_n")
    )
    offsets = (
        blocks.withColumn("_earlier", _before(Window.partitionBy(session, score).orderBy("_block")))
        .join(scores, [session, score])
        .select(*keys, (F.col("_higher") + F.col("_earlier")).alias("_offset"))
    )
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(id_col))
    return (
        keyed.withColumn("_position", position)
        .join(offsets, keys, "left")
        .withColumn("rank", (F.col("_offset") + F.col("_position")).cast("bigint"))
        .drop("_block", "_position", "_offset")
    )


def number_rows(df: DataFrame, order_col: str, start: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_number``: ``start`` + 1, + 2, ... in ascending ``order_col`` (unique).

    Rows are numbered inside blocks; only the block counts are summed in one place.
    """
    keyed = with_blocks(df, order_col, block_rows)
    blocks = keyed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = blocks.select("_block", _before(Window.orderBy("_block")).alias("_offset"))
    position = F.row_number().over(Window.partitionBy("_block").orderBy(order_col))
    return (
        keyed.withColumn("_position", position)
        .join(offsets, "_block")
        .withColumn("_number", (start + F.col("_offset") + F.col("_position")).cast("bigint"))
        .drop("_block", "_position", "_offset")
    )


def top_k(
    scored: DataFrame,
    k: int,
    score: str = "overall",
    id_col: str = "candidate_id",
    session: str = "session_id",
) -> DataFrame:
    """The k best per session; each task keeps its own k best before the shuffle."""
    order = Window.partitionBy(session).orderBy(F.desc(score), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_score(ranked: DataFrame, threshold: float, score: str = "overall") -> DataFrame:
    """Keep candidates at or above a score; ranks are those of the full list."""
    return ranked.where(F.col(score) >= F.lit(float(threshold)))


def score_band(score: Column) -> Column:
    out = None
    for least, band in SCORE_BANDS:
        out = F.when(score >= least, F.lit(band)) if out is None else out.when(score >= least, F.lit(band))
    return out.otherwise(F.lit(LOWEST_BAND))
