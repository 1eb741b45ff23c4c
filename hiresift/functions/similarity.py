"""TF-IDF cosine similarity of two term histograms, as exact integer sums.

With two documents the inverse document frequency takes only two values: 1 for a
term in both and 1 + ln 1.5 for a term in one.  The cosine therefore needs the
shared products and the squared counts only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift.functions.text import let_sql

RARE_WEIGHT_SQUARED = (1 + math.log(1.5)) ** 2


def percent(cosine: Column) -> Column:
    """Cosine as a percentage with one decimal, halves to even."""
    return F.bround(cosine * 100, 1)


def pairwise_similarity(a: str, b: str) -> Column:
    """Percent similarity of the histogram columns ``a`` and ``b`` (see ``term_counts``);
    0.0 if no term is shared, NULL if a side is NULL."""
    # Both term lists in one order; a shared term stands twice in a row, first as ``a``'s.
    sides = ", ".join(
        f"transform({c}.terms, (w, i) -> struct(w as term, {n} as side, get({c}.tfs, i) as tf))"
        for n, c in enumerate((a, b))
    )
    pairs = (
        "filter(transform(m, (t, i) -> case when i > 0 and get(m, i - 1).term = t.term"
        " then struct(cast(get(m, i - 1).tf as bigint) as x, cast(t.tf as bigint) as y) end), p -> p is not null)"
    )
    shared = let_sql(f"array_sort(concat({sides}))", "m", pairs)
    norms = " * ".join(
        f"(acc.{s} + {RARE_WEIGHT_SQUARED!r}D * ({c}.squares - acc.{s}))" for s, c in (("x", a), ("y", b))
    )
    return F.expr(
        f"aggregate({shared}, struct(0L as dot, 0L as x, 0L as y),"
        " (acc, t) -> struct(acc.dot + t.x * t.y as dot, acc.x + t.x * t.x as x, acc.y + t.y * t.y as y),"
        f" acc -> case when acc.dot = 0 then 0.0D else bround(100 * (acc.dot / sqrt({norms})), 1) end)"
    )
