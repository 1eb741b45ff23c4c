"""Hard-negative mining by angular triangle filtering.

Components become the integers ``floor(256 x)``; a score is an integer inner product.  An
anchor's positives are its best rows of the same label; a positive's negatives are the best
rows of other labels whose score lies within given percentages of the positive's.

Every row stores its norm and its angles to some reference directions.  By the triangle
inequality on the sphere, the angle between two rows lies between the largest difference and
the smallest sum of their angles to a direction.  Its cosine times the norms bounds the score;
the bounds are widened by more than all rounding errors, so no row is lost to them.  Only rows
whose bounds meet a wanted window get an integer score: the window of an anchor's positives
begins at the worst of the best scores so far, that of a positive's negatives lies between the
percentages and narrows from below in the same way.  The same test is first made for blocks of
rows and for whole groups, with the ranges of their angles and norms.

At scale: rows are range-partitioned by label, nearest direction and angle into groups of
about ``GROUP_ROWS`` rows, whatever shares a label or a vector.  The anchors, a stated query
set, are sent to groups and stream past a group's rows in batches, so a task holds one group and
one batch.  They first go to the ``FIRST`` groups with the highest bounds; what is found there
narrows their windows, and they go on to those of the other groups that may still meet one.
From each group come at most a few rows per anchor.
Directions are chosen from ``SAMPLE`` rows; they decide only how much is filtered.  The driver
holds these and the ranges of at most ``RANGES`` runs of groups.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no
part.  A shorter vector counts as zero beyond its end; an empty or zero vector scores 0 with all.
Repeated rows are rows of their own: each is another's positive, and each is an anchor.  Equal
scores go by vec_id, null ids last.  Integers beyond 64 bits are computed exactly and given as
the nearest 64-bit value.  An empty table, or one without anchors, gives no rows.  Only vec_id,
label and embedding are read, so clashing names of other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hiresift.llm.common import add_columns
from hiresift.sources.tables import materialize

GROUP_ROWS, LEAST_ROWS = 32_768, 2_048
BLOCK_ROWS, BATCH_ANCHORS = 256, 512
DIRECTIONS, SAMPLE, RANGES = 32, 2_048, 4_096
FIRST = 8
NEAREST = 3  # directions by which single rows are judged, besides their block's
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


# --- vectors ------------------------------------------------------------------------------
def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Integer vectors as rows of a matrix, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (lengths == dim).all():
        return values.reshape(len(lengths), dim)
    made = np.zeros((len(lengths), dim), np.int64)
    made[np.arange(dim) < lengths[:, None]] = values
    return made


def angles_to(vectors: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to unit vectors; a zero vector has a right angle to all."""
    real = vectors.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", real, real))
    unit = real / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.arccos(np.clip(unit @ directions.T, -1, 1))


def choose_directions(sample: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors of the sample, each the farthest from those before."""
    real = sample.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", real, real))
    unit = real[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    chosen = [0]
    closest = unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(closest)))
        closest = np.maximum(closest, unit @ unit[chosen[-1]])
    return unit[chosen]


def score_bounds(least: np.ndarray, most: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on the scores of a row of ``norm`` with rows of norms from low to high, at angles from least to most."""
    top = np.cos(np.maximum(least - 2 * ANGLE_SLACK, 0))
    bottom = np.cos(np.minimum(most + 2 * ANGLE_SLACK, math.pi))
    slack = 1 + SCORE_SLACK * norm * high
    return norm * np.where(bottom > 0, low, high) * bottom - slack, norm * np.where(top > 0, high, low) * top + slack


def angle_ranges(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most angle between rows (own angles) and sets of rows (ranges of angles), by all directions."""
    least = np.zeros((len(own), len(low)))
    most = np.full(least.shape, math.pi)
    for r in range(own.shape[1]):
        mine = own[:, r, None]
        np.maximum(least, low[:, r] - mine, out=least)
        np.maximum(least, mine - high[:, r], out=least)
        np.minimum(most, mine + high[:, r], out=most)
        np.minimum(most, 2 * math.pi - mine - low[:, r], out=most)
    return least, most


def largest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, in falling order."""
    ordered = np.sort(scores, axis=1) if scores.dtype == object or scores.shape[1] <= k else np.sort(np.partition(scores, -k, axis=1)[:, -k:], axis=1)
    return ordered[:, ::-1][:, :k]


class Group:
    """Rows of one group, in blocks of one label with ranges of angles and norms."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.rows = rows.column("row").to_numpy()
        ids = rows.column("vec_id")
        self.unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.labels = rows.column("label").to_numpy()
        self.norms = rows.column("norm").to_numpy()
        self.angles = rows.column("angles").flatten().to_numpy().astype(np.float64).reshape(len(self.rows), -1)
        self.vectors = matrix(rows.column("v"), dim)
        self.peak = max((abs(int(f(self.vectors))) for f in (np.min, np.max) if self.vectors.size), default=0)
        changes = np.flatnonzero(np.diff(self.labels)) + 1
        starts = [begin for a, z in zip([0, *changes], [*changes, len(self.rows)], strict=True) for begin in range(a, z, BLOCK_ROWS)]
        self.starts, self.ends = np.array(starts), np.array([*starts[1:], len(self.rows)])
        self.low = np.minimum.reduceat(self.angles, self.starts)
        self.high = np.maximum.reduceat(self.angles, self.starts)
        self.low_norm = np.minimum.reduceat(self.norms, self.starts)
        self.high_norm = np.maximum.reduceat(self.norms, self.starts)
        self.nearest = self.high.argmin(axis=1)
        self.real = self.vectors.astype(np.float64)


class Best:
    """The best rows so far in each slot (anchor, window), with ties in the order of ids."""

    def __init__(self, k: int):
        self.k = k
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        """Slots, scores, whether the id is null, ids, rows."""
        self.parts.append(columns)
        self.size += len(columns[0])

    def reduce(self) -> tuple[np.ndarray, ...]:
        slots, scores, unnamed, ids, rows = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        if scores.dtype == object:
            order = np.array(sorted(range(len(slots)), key=lambda i: (slots[i], -scores[i], unnamed[i], ids[i], rows[i])))
        else:
            order = np.lexsort((rows, ids, unnamed, -scores, slots))
        first = np.searchsorted(slots[order], slots[order], side="left")
        order = order[np.arange(len(order)) - first < self.k]
        kept = slots[order], scores[order], unnamed[order], ids[order], rows[order]
        self.parts, self.size = [kept], len(order)
        return kept


def best_in_windows(
    group: Group, anchors: Group, low: np.ndarray, high: np.ndarray, k: int, same_label: bool
) -> tuple[np.ndarray, ...] | None:
    """The k best rows of the group in each window, (anchor, window) numbered row by row; None if there are none."""
    count, windows = low.shape
    exact = group.peak * anchors.peak * max(1, group.vectors.shape[1]) < 2**53
    kind = np.float64 if exact else object
    ours, theirs = (anchors.real, group.real) if exact else (anchors.vectors.astype(object), group.vectors.astype(object))
    need = low.astype(np.float64).copy()  # only compared with widened bounds
    tops = np.full((count, windows, k), -math.inf, kind)
    least, most = angle_ranges(anchors.angles, group.low, group.high)
    floors, ceilings = score_bounds(least, most, anchors.norms[:, None], group.low_norm, group.high_norm)
    closest = np.argsort(anchors.angles, axis=1, kind="stable")[:, :NEAREST]
    widest = high.max(axis=1, initial=-math.inf)
    best = Best(k)
    for b in np.argsort(-ceilings.max(axis=0), kind="stable"):
        begin, end = group.starts[b], group.ends[b]
        labelled = (anchors.labels == group.labels[begin]) == same_label
        some = np.flatnonzero(labelled & (ceilings[:, b] >= need.min(axis=1, initial=math.inf)) & (floors[:, b] <= widest))
        if not len(some):
            continue
        angles = group.angles[begin:end]
        nearest = np.column_stack([closest[some], np.full(len(some), group.nearest[b])])
        least, most = np.zeros((len(some), end - begin)), np.full((len(some), end - begin), math.pi)
        for r in nearest.T:
            mine, other = anchors.angles[some, r][:, None], angles.T[r]
            np.maximum(least, np.abs(mine - other), out=least)
            np.minimum(most, np.minimum(mine + other, 2 * math.pi - mine - other), out=most)
        norms = group.norms[begin:end]
        floor, ceiling = score_bounds(least, most, anchors.norms[some, None], norms, norms)
        wanted = np.zeros(floor.shape, bool)
        for w in range(windows):
            wanted |= (ceiling >= need[some, w, None]) & (floor <= high[some, w, None])
        if same_label:
            wanted &= anchors.rows[some, None] != group.rows[begin:end]
        which, there = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
        if not len(which):
            continue
        some, there, wanted = some[which], there + begin, wanted[np.ix_(which, there)]
        scores = ours[some] @ theirs[there].T
        for w in range(windows):
            inside = wanted & (scores >= low[some, w, None]) & (scores <= high[some, w, None])
            found = np.where(inside, scores, -math.inf).astype(kind, copy=False)
            tops[some, w] = largest(np.concatenate([tops[some, w], found], axis=1), k)
            need[some, w] = np.maximum(need[some, w], tops[some, w, -1].astype(np.float64))
            a, x = np.nonzero(inside & (scores >= tops[some, w, -1][:, None]))
            if len(a):
                rows = there[x]
                best.add(some[a] * windows + w, scores[a, x], group.unnamed[rows], group.ids[rows], group.rows[rows])
        if best.size > 1 << 17:
            best.reduce()
    return best.reduce() if best.size else None


# --- Spark --------------------------------------------------------------------------------
def usable_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and integer vector of the rows that take part."""
    x = F.col("embedding")
    broken = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return embeddings.where(F.col("label").isNotNull() & x.isNotNull()).where(~broken).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")).alias("v"),
    )


def laid_out(rows: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Rows with norm, angles, ``row`` (their name) and ``group``; the numbers of groups, dimensions and directions."""
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")
    ).first()
    n, dim = size["n"], max(size["dim"] or 0, 1)
    peak = max(abs(size["low"] or 0), abs(size["high"] or 0))
    narrow = "smallint" if peak < 2**15 else "int" if peak < 2**31 else "bigint"  # what is shuffled
    drawn = rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).toArrow()
    vectors = matrix(drawn.column("v").combine_chunks(), dim) if n else np.zeros((0, dim), np.int64)
    directions = choose_directions(np.unique(vectors, axis=0))

    def compute(batch: pa.RecordBatch) -> list:
        norms, angles = angles_to(matrix(batch.column("v"), dim), directions)
        return [norms, [*angles], angles.argmin(axis=1), angles.min(axis=1)]

    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(n / GROUP_ROWS), min(cores, math.ceil(n / LEAST_ROWS)))
    placed = add_columns(rows, compute, "norm double, angles array<float>, cell int, near double", sized_by=None)
    order = ["label", "cell", "near", "vec_id"]
    placed = placed.withColumn("_any", F.monotonically_increasing_id())  # spreads equal rows
    return (
        placed.repartitionByRange(groups, *order, "_any").sortWithinPartitions(*order, "_any")
        .withColumn("row", F.monotonically_increasing_id()).withColumn("group", F.spark_partition_id())
        .select("row", "group", "vec_id", "label", F.col("v").cast(f"array<{narrow}>").alias("v"), "norm", "angles"),
        groups, dim, len(directions),
    )


def ranges_of(laid: DataFrame, groups: int, directions: int) -> list:
    """Ranges of labels, norms and angles of runs of groups, at most ``RANGES`` of them."""
    run = F.floor(F.col("group") / math.ceil(groups / RANGES)).cast("int").alias("run")
    by_direction = [F.col("angles")[r] for r in range(directions)]
    return laid.groupBy(run).agg(
        F.array(*map(F.min, by_direction)).alias("low"), F.array(*map(F.max, by_direction)).alias("high"),
        *(getattr(F, f)(c).alias(f"{f}_{c}") for c in ("group", "label", "norm") for f in ("min", "max")),
    ).collect()


def sent_to_groups(anchors: DataFrame, ranges: list, same_label: bool, at_first: bool) -> DataFrame:
    """Anchors, repeated for each ``group`` whose rows their windows (``low`` to ``high``) may want.

    ``at_first`` only for the ``FIRST`` runs of groups with the highest bounds, else only for the others.
    """
    low, high = (np.array([r[c] for r in ranges], np.float64) for c in ("low", "high"))
    firsts, lasts = ([r[c] for r in ranges] for c in ("min_group", "max_group"))
    low_label, high_label, low_norm, high_norm = (
        np.array([r[c] for r in ranges]) for c in ("min_label", "max_label", "min_norm", "max_norm")
    )

    def compute(batch: pa.RecordBatch) -> list:
        labels = batch.column("label").to_numpy()[:, None]
        own = batch.column("angles").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
        least, most = angle_ranges(own, low, high)
        floor, ceiling = score_bounds(least, most, batch.column("norm").to_numpy()[:, None], low_norm, high_norm)
        fits = (low_label <= labels) & (labels <= high_label) if same_label else (low_label != labels) | (high_label != labels)
        order = np.argsort(np.where(fits, -ceiling, math.inf), axis=1, kind="stable")
        early = np.zeros(fits.shape, bool)
        np.put_along_axis(early, order[:, :FIRST], True, axis=1)
        begins = np.array([min(v, default=LONG_MAX) for v in batch.column("low").to_pylist()], np.float64)[:, None]
        ends = np.array([max(v, default=LONG_MIN) for v in batch.column("high").to_pylist()], np.float64)[:, None]
        meets = fits & (early == at_first) & (ceiling >= begins) & (floor <= ends)
        return [[[g for i in np.flatnonzero(m) for g in range(firsts[i], lasts[i] + 1)] for m in meets]]

    spread = add_columns(anchors.drop("group"), compute, "groups array<int>", sized_by=None)
    return spread.withColumn("group", F.explode("groups")).drop("groups")


def mined(laid: DataFrame, sent: DataFrame, dim: int, k: int, same_label: bool) -> DataFrame:
    """From each group the k best rows of each window of each anchor: ``anchor``, ``window``, ``score``, ``vec_id``, ``row``."""
    columns = ["group", "kind", "label", "row", "vec_id", "v", "norm", "angles", "low", "high"]
    none = F.lit(None).cast("array<long>")
    sent = materialize(sent)
    asked = laid.join(sent.select("group").distinct(), "group", "left_semi")
    stream = (
        asked.withColumn("low", none).withColumn("high", none).withColumn("kind", F.lit(0)).select(columns)
        .union(sent.withColumn("kind", F.lit(1)).select(columns))
        .repartition("group").sortWithinPartitions("group", "kind", "label", "row")
    )

    def judged(group: Group, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        anchors = Group([batch], dim)
        low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
        windows = max(map(len, low))
        large = any(2**53 < abs(v) < LONG_MAX for w in (*low, *high) for v in w)
        starts, ends = (
            np.array([[*(-fill if v == open_ else v for v in x), *[fill] * (windows - len(x))] for x in w], object if large else np.float64)
            for w, fill, open_ in ((low, math.inf, LONG_MIN), (high, -math.inf, LONG_MAX))
        )
        found = best_in_windows(group, anchors, starts, ends, k, same_label)
        if found is None:
            return None
        slots, scores, unnamed, ids, rows = found
        clipped = [min(max(int(s), LONG_MIN), LONG_MAX) for s in scores.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(anchors.rows[slots // starts.shape[1]]), pa.array((slots % starts.shape[1]).astype(np.int32)), pa.array(clipped, pa.int64()),
             pa.array(ids, mask=unnamed), pa.array(rows)],
            names=["anchor", "window", "score", "vec_id", "row"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, number = None, None
        for batch in batches:
            groups, kinds = (batch.column(c).to_numpy() for c in ("group", "kind"))
            edges = [0, *(np.flatnonzero(np.diff(groups) | np.diff(kinds)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                if groups[begin] != number:
                    held, group, number = [], None, groups[begin]
                part = batch.slice(begin, end - begin)
                if kinds[begin] == 0:
                    held.append(part)
                    continue
                if not held:  # a group without rows within a run of groups
                    continue
                group = group or Group(held, dim)
                for at in range(0, part.num_rows, BATCH_ANCHORS):
                    made = judged(group, part.slice(at, BATCH_ANCHORS))
                    if made is not None:
                        yield made

    return stream.mapInArrow(run, "anchor long, window int, score long, vec_id long, row long")


def first_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each slot over all groups, with their ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(laid: DataFrame, anchors: DataFrame, ranges: list, dim: int, k: int, same_label: bool) -> DataFrame:
    """The k best rows of each window (``low`` to ``high``) of each anchor, with their ``rank``."""
    slot = ["anchor", "window"]
    early = materialize(first_rows(mined(laid, sent_to_groups(anchors, ranges, same_label, True), dim, k, same_label), slot, k))
    reached = early.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    raised = anchors.join(reached, anchors["row"] == reached["anchor"], "left").drop("anchor").withColumn(
        "low", F.transform("low", lambda x, i: F.coalesce(F.try_element_at("reached", i), x))
    ).drop("reached")
    late = mined(laid, sent_to_groups(raised, ranges, same_label, False), dim, k, same_label)
    return first_rows(early.drop("rank").unionByName(late), slot, k)


def mine_hard_negatives(
    embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95
) -> DataFrame:
    """Per anchor and positive, its best negatives with ``low_percent`` to ``high_percent`` of the positive's score."""
    placed, groups, dim, directions = laid_out(usable_rows(embeddings))
    laid = materialize(placed)
    ranges = ranges_of(laid, groups, directions)
    anchors = laid.where(F.coalesce(is_anchor, F.lit(False)))
    everything = anchors.withColumns({"low": F.array(F.lit(LONG_MIN)), "high": F.array(F.lit(LONG_MAX))})
    near = materialize(best_rows(laid, everything, ranges, dim, positives, True))
    exact = F.col("score").cast("decimal(38)")
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.ceil(exact * low_percent / 100).cast("long").alias("low"), F.floor(exact * high_percent / 100).cast("long").alias("high")
    ))).alias("w"))
    asking = materialize(anchors.join(windows, anchors["row"] == windows["anchor"]).where(F.exists("w", lambda w: w["low"] <= w["high"])).select(
        *anchors.columns, F.col("w.low").alias("low"), F.col("w.high").alias("high")
    ))
    far = best_rows(laid, asking, ranges, dim, negatives, False)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(chosen, ["anchor", "window"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(embeddings.withColumn("label", label), F.col("vec_id") % 50 == 0)


SQL = {
    "op12_hard_negatives": """
with usable as (
    select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.r as a, a.vec_id as anchor_id, b.r as b, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
    from usable a join usable b on a.r <> b.r where a.vec_id % 50 = 0
), positives as (
    select * from scored where same
    qualify row_number() over (partition by a order by score desc, vec_id nulls last, b) <= 5
), ranked as (
    select p.anchor_id, p.vec_id as positive_id,
        row_number() over (partition by p.a, p.b order by n.score desc, n.vec_id nulls last, n.b)::int as rank,
        n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
    from positives p join scored n on n.a = p.a and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
)
select * from ranked where rank <= 3
"""
}
