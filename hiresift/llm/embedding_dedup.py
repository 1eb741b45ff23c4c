"""Embedding near-dedup: all pairs over a cosine threshold, by dual traversal of a cover tree.

On unit vectors a cosine is a distance, so a node of the tree (a centre and a covering radius)
bounds all its members: a pair of nodes is dropped if its centres are farther apart than both
radii and the threshold distance together, and taken whole if centres and radii stay below it.

The upper levels are built by Spark: a node with too many members is split among pivots drawn
from it and its farthest member, each member going to the nearest, until every node fits a task.
A node whose members differ by rounding only, such as multiples of one vector, is split by a hash
and its parts keep its centre and radius.  Node pairs are
expanded level by level as joins on the parent.  Below, each leaf gets nested levels of halving
radii (1/2, 1/4, ... ``LEVELS`` of them), every level's centres being members of the parent node;
one task traverses the trees of two leaves at once, level by level, in numpy.  Leaves are dealt
into as many groups as the root of their number (more if a group had over ``HELD`` leaves); a task
holds the leaves of one group and streams those of another past them, so a vector is sent once
per group and not once per leaf that it may meet.  Radii are always measured, not assumed.  The last level's members are compared one by one, in double precision;
cosines next to the threshold are summed exactly.

Equal vectors are one member with a weight.  A task reports, per member, the number of vectors
linked, and links enough to connect what is connected; pairs are never put out.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing.  Vectors of different lengths link with nothing of another length.  Rows with one
vec_id are rows of their own.  A null vec_id counts as larger than all others.  Vectors are
named by a 64-bit hash.  An empty table gives an empty one.  Extra columns stay, those with a
result's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm.graph import components
from hiresift.sources.tables import materialize

COSINE = 0.9
LEAF = 4096
LEVELS = 3
SALTS = 8
LAST = (1 << 63) - 1
SLACK = 1e-9
TIGHT = 1e-7  # a node of this radius holds one direction, up to rounding
HELD = 16
POINT = "nid long, vec array<double>, weight long"


def threshold_distance(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


# --- vectors ------------------------------------------------------------------------------
def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vec, lambda x: x == 0)
    return F.coalesce((F.size(vec) > 0) & ~bad & ~zero, F.lit(False))


def distance(a: str, b: str) -> Column:
    """Between unit vectors, in the JVM."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(squares)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column, of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _runs(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by], axis=1)
    edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
    for begin, end in zip(edges, edges[1:], strict=False):
        if begin < end:
            yield tuple(keys[begin]), batch.slice(begin, end - begin)


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Whole groups of rows that come sorted; for groups of bounded size."""
    key, held = None, []
    for batch in batches:
        for k, part in _runs(batch, by):
            if k != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = k
            held.append(part)
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


# --- upper levels -------------------------------------------------------------------------
def _nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, salt, pivots first): every member goes to the nearest pivot of its node."""
    at, pivots, ids = None, [], []
    for batch in batches:
        for key, part in _runs(batch, ["node", "salt"]):
            if key != at:
                at, pivots, ids = key, [], []
            lead = int(part.column("is_pivot").to_numpy(zero_copy_only=False).sum())
            if lead:
                pivots.append(_matrix(part.slice(0, lead).column("vec")))
                ids.append(part.slice(0, lead).column("nid").to_numpy())
                part = part.slice(lead)
            if not len(part):
                continue
            nid, node = part.column("nid"), part.column("node")
            if pivots:
                x, p, names = _matrix(part.column("vec")), np.concatenate(pivots), np.concatenate(ids)
                best = np.concatenate([(x[i : i + 4096] @ p.T).argmax(axis=1) for i in range(0, len(x), 4096)])
                child = names[best]
                away = np.sqrt(((x - p[best]) ** 2).sum(axis=1))
            else:
                child, away = node.to_numpy(), np.full(len(part), np.nan)
            yield pa.RecordBatch.from_arrays(
                [nid, part.column("vec"), part.column("weight"), node, pa.array(child), pa.array(away, from_pandas=True)],
                names=["nid", "vec", "weight", "parent", "node", "away"],
            )


def build_upper(points: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their leaf (node), and per level the nodes: node, parent, centre, radius."""
    levels: list[DataFrame] = []
    centres = None
    depth = 0
    points = points.withColumn("away", F.lit(None).cast("double"))
    while True:
        sizes = points.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max_by("nid", "away").alias("far"))
        if centres is not None:
            sizes = sizes.join(centres.select("node", "radius"), "node")
        else:
            sizes = sizes.withColumn("radius", F.lit(2.0))
        large = materialize(sizes.where(F.col("n") > leaf))
        if large.isEmpty():
            return points.drop("away"), levels
        depth += 1
        parts = 1 << 40
        points = points.select("nid", "vec", "weight", "node")
        tight = large.where(F.col("radius") <= TIGHT).select("node", F.ceil(2.0 * F.col("n") / leaf).alias("k"))
        split_by_hash = points.join(tight, "node").select(
            "nid", "vec", "weight", F.col("node").alias("parent"),
            F.xxhash64("node", F.pmod(F.xxhash64(F.lit("part"), "nid"), "k")).alias("node"), F.lit(None).cast("double").alias("away"),
        )
        # Twice as many pivots as leaves are needed, but few enough for a task to hold.
        wanted = F.least(F.lit(512.0), F.greatest(F.lit(16.0), 2.0 * F.col("n") / leaf))
        drawn = F.pmod(F.xxhash64(F.lit(depth), "nid"), F.lit(parts)) < wanted / F.col("n") * parts
        wide = large.where(F.col("radius") > TIGHT)
        pivots = materialize(points.join(wide, "node").where(drawn | F.col("nid").eqNullSafe(F.col("far"))).select("nid", "vec", "weight", "node"))
        salted = points.join(tight, "node", "left_anti").select("nid", "vec", "weight", "node").withColumns(
            {"salt": F.pmod(F.xxhash64("nid"), F.lit(SALTS)), "is_pivot": F.lit(False)}
        )
        copies = pivots.withColumns({"salt": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))), "is_pivot": F.lit(True)})
        stream = salted.unionByName(copies).repartition("node", "salt")
        stream = stream.sortWithinPartitions("node", "salt", F.col("is_pivot").desc())
        placed = stream.mapInArrow(_nearest_pivot, f"{POINT}, parent long, node long, away double")
        placed = materialize(placed.unionByName(split_by_hash))
        found = placed.groupBy("node").agg(F.first("parent").alias("parent"), F.max("away").alias("radius"))
        split = found.where("radius is not null").join(
            pivots.select(F.col("nid").alias("node"), F.col("vec").alias("centre")), "node"
        )
        # Nodes that stay, and parts of tight ones, lie where their node lay.
        same = found.where("radius is null").drop("radius")
        if centres is None:
            same = same.withColumns({"radius": F.lit(2.0), "centre": F.lit(None).cast("array<double>")})
        else:
            same = same.join(centres.select(F.col("node").alias("parent"), "radius", "centre"), "parent")
        centres = materialize(split.unionByName(same))
        levels.append(centres)
        points = placed.select("nid", "vec", "weight", "node", "away")


def leaf_pairs(roots: DataFrame, levels: list[DataFrame], tau: float) -> DataFrame:
    """(p, q, whole): pairs of leaves, p <= q, that may hold links; whole: every pair in it is one."""
    pairs = roots.select(F.col("node").alias("p"), F.col("node").alias("q"), F.lit(False).alias("whole"))
    for nodes in levels:
        left = nodes.select(F.col("parent").alias("p"), F.col("node").alias("p2"), F.col("centre").alias("pc"), F.col("radius").alias("pr"))
        right = nodes.select(F.col("parent").alias("q"), F.col("node").alias("q2"), F.col("centre").alias("qc"), F.col("radius").alias("qr"))
        apart = F.coalesce(distance("pc", "qc"), F.lit(0.0))
        reach = F.col("pr") + F.col("qr")
        grown = pairs.join(left, "p").join(right, "q").where((F.col("p") != F.col("q")) | (F.col("p2") <= F.col("q2")))
        known = F.col("pc").isNotNull() & F.col("qc").isNotNull()
        pairs = materialize(
            grown.where(apart <= reach + tau + SLACK).select(
                F.least("p2", "q2").alias("p"), F.greatest("p2", "q2").alias("q"),
                (known & (apart + reach <= tau - SLACK)).alias("whole"),
            )
        )
    return pairs


# --- lower levels -------------------------------------------------------------------------
def nested_centres(x: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """(levels, n): the centre of each member at radii 1/2, 1/4, ...; a node's own centre is tried first.

    Nodes are found from one matrix of inner products; their rounding is harmless, as radii are measured later.
    """
    n = len(x)
    out = np.tile(np.arange(n), (levels, 1))
    single = x.astype(np.float32)
    inner = single @ single.T
    parent = np.zeros(n, np.int64)
    for level in range(levels):
        close = 1 - 0.125 * 4.0**-level  # the inner product at that distance
        members = np.argsort(parent, kind="stable")
        tops, begin, size = np.unique(parent[members], return_index=True, return_counts=True)
        for top, b, k in zip(tops[size > 1].tolist(), begin[size > 1].tolist(), size[size > 1].tolist()):
            left = members[b : b + k]
            left = np.r_[top, left[left != top]]
            while len(left):
                near = inner[left[0], left] >= close
                near[0] = True
                out[level, left[near]] = left[0]
                left = left[~near]
        parent = out[level]
    return out


def plant(points: DataFrame) -> DataFrame:
    """Leaves with the nested levels: column ``tree`` holds the place of each member's centres in the leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ["node"]):
            x = _matrix(rows.column("vec").combine_chunks())
            tree = nested_centres(x).T.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c).combine_chunks() for c in ("nid", "vec", "weight", "node")),
                    pa.array(np.arange(len(x), dtype=np.int32)), pa.array(tree.tolist(), pa.list_(pa.int32())),
                ],
                names=["nid", "vec", "weight", "node", "place", "tree"],
            )

    return points.repartition("node").sortWithinPartitions("node", "nid").mapInArrow(
        run, f"{POINT}, node long, place int, tree array<int>"
    )


class Levels:
    """The nested nodes of one leaf, coarse to fine, the members themselves last."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, tree: np.ndarray):
        self.x, self.weight = x, weight
        self.centre, self.radius, self.total, self.children, self.members = [], [], [], [], []
        label = np.zeros(len(x), np.int64)
        tops = [*tree.T, np.arange(len(x))]
        for column in tops:
            centre, inverse = np.unique(column, return_inverse=True)
            away = np.sqrt(((x - x[column]) ** 2).sum(axis=1))
            radius = np.zeros(len(centre))
            np.maximum.at(radius, inverse, away)
            above = label[centre]
            order = np.argsort(above, kind="stable")
            count = np.bincount(above, minlength=label.max() + 1)
            self.children.append((order, np.cumsum(count) - count, count))
            self.centre.append(centre)
            self.radius.append(radius)
            self.total.append(np.bincount(inverse, weight, len(centre)).astype(np.int64))
            by_node = np.argsort(inverse, kind="stable")
            n = np.bincount(inverse, minlength=len(centre))
            self.members.append((by_node, np.cumsum(n) - n, n))
            label = inverse


def _spread(table: tuple, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each node in a (values, begin, count) table, and which node they belong to."""
    values, begin, count = table
    sizes = count[nodes]
    owner = np.repeat(np.arange(len(nodes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return values[begin[nodes][owner] + place], owner


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    dot = math.fsum((a * b).tolist())
    return dot / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


def traverse(a: Levels, b: Levels, cosine: float, same: bool, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, list]:
    """Links of the members of ``a`` and of ``b`` into the other leaf, as weights, and pairs that connect them."""
    tau = threshold_distance(cosine)
    links_a, links_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    joined: list[tuple[np.ndarray, np.ndarray]] = []
    work = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]  # level, and node pairs above it to expand
    last = len(a.centre) - 1
    while work:
        level, p, q = work.pop()
        sizes = a.children[level][2][p] * b.children[level][2][q]
        if len(p) > 1 and sizes.sum() > chunk:
            half = len(p) // 2
            work += [(level, p[:half], q[:half]), (level, p[half:], q[half:])]
            continue
        for i, j, d in _expanded(a, b, level, p, q, tau, chunk):
            reach = a.radius[level][i] + b.radius[level][j]
            stay = d <= reach + tau + SLACK
            i, j, d, reach = i[stay], j[stay], d[stay], reach[stay]
            if level == last:
                cos = 1 - d * d / 2
                for k in np.flatnonzero(np.abs(cos - cosine) < SLACK):
                    cos[k] = _exact(a.x[i[k]], b.x[j[k]])
                hit = cos >= cosine
                if same:
                    hit &= i != j
                i, j = i[hit], j[hit]
                np.add.at(links_a, i, b.weight[j])
                np.add.at(links_b, j, a.weight[i])
                joined.append((i, j))
                continue
            whole = d + reach <= tau - SLACK
            _take_whole(a, b, level, i[whole], j[whole], links_a, links_b, joined)
            if (~whole).any():
                work.append((level + 1, i[~whole], j[~whole]))
    if same:
        links_a -= np.where(_self_taken(a, tau), a.weight, 0)
    return links_a, links_b, joined


def _expanded(
    a: Levels, b: Levels, level: int, p: np.ndarray, q: np.ndarray, tau: float, chunk: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Child pairs of node pairs, those that may hold links, with the distance of their centres."""
    xa, xb = a.x[a.centre[level]], b.x[b.centre[level]]

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", xa[i], xb[j]), 0))

    if len(p) == 1:  # one pair with many children: by products of matrices, in single precision with room for it
        left, right = _spread(a.children[level], p)[0], _spread(b.children[level], q)[0]
        for one in _by_radius(left, a.radius[level], tau):
            for two in _by_radius(right, b.radius[level], tau):
                if not len(one) or not len(two):
                    continue
                reach = a.radius[level][one].max() + b.radius[level][two].max() + tau
                least = np.float32(1 - reach * reach / 2 - 1e-4)
                low, high = xa[one].astype(np.float32), xb[two].astype(np.float32).T
                step = max(1, 4 * chunk // len(two))
                for begin in range(0, len(one), step):
                    i, j = np.nonzero(low[begin : begin + step] @ high >= least)
                    i, j = one[begin : begin + step][i], two[j]
                    yield i, j, apart(i, j)
        return
    one, owner = _spread(a.children[level], p)
    j, back = _spread(b.children[level], q[owner])
    i = one[back]
    yield i, j, apart(i, j)


def _by_radius(nodes: np.ndarray, radius: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Narrow and wide nodes, so that a few wide ones don't loosen the bound of all."""
    narrow = radius[nodes] <= tau / 8
    return nodes[narrow], nodes[~narrow]


def _take_whole(a, b, level, i, j, links_a, links_b, joined) -> None:
    """Node pairs all of whose members link."""
    for side, other, mine, theirs, links in ((a, b, i, j, links_a), (b, a, j, i, links_b)):
        member, owner = _spread(side.members[level], mine)
        np.add.at(links, member, other.total[level][theirs][owner])
        centre = other.centre[level][theirs][owner]
        joined.append((member, centre) if side is a else (centre, member))


def _self_taken(a: Levels, tau: float) -> np.ndarray:
    """Members that a node paired with itself has counted as linked to themselves."""
    taken = np.zeros(len(a.x), bool)
    for level in range(len(a.centre) - 1):
        member, _ = _spread(a.members[level], np.flatnonzero(2 * a.radius[level] <= tau - SLACK))
        taken[member] = True
    return taken


def connecting(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group of 0..n-1 that the pairs connect: (member, smallest member)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    member = np.flatnonzero(low != np.arange(n))
    return member, low[member]


def dealt(planted: DataFrame, pairs: DataFrame, held: int = HELD) -> DataFrame:
    """Rows of leaves for each task (a, b): those of group a that are held, side 0, and those of b that stream past, side 1.

    The first row of a streamed leaf names the held leaves it is compared with.
    """
    leaves = planted.select("node").distinct().count()
    groups = max(1, math.ceil(math.sqrt(leaves)), math.ceil(leaves / held))

    def group(node: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("group"), node), F.lit(groups)).cast("int")

    turned = F.col("gp") > F.col("gq")
    tasks = pairs.select("p", "q", group("p").alias("gp"), group("q").alias("gq")).select(
        F.least("gp", "gq").alias("a"), F.greatest("gp", "gq").alias("b"),
        F.when(turned, F.col("q")).otherwise(F.col("p")).alias("one"), F.when(turned, F.col("p")).otherwise(F.col("q")).alias("two"),
    )
    first = tasks.select("a", "b", F.col("one").alias("node")).distinct().withColumns(
        {"side": F.lit(0), "partners": F.lit(None).cast("array<long>")}
    )
    second = tasks.groupBy("a", "b", F.col("two").alias("node")).agg(F.collect_list("one").alias("partners")).withColumn("side", F.lit(1))
    rows = planted.join(first.unionByName(second), "node")
    return rows.withColumn("partners", F.when(F.col("place") == 0, F.col("partners")))


def compare_leaves(planted: DataFrame, pairs: DataFrame, cosine: float, held: int = HELD) -> DataFrame:
    """Rows (nid, links, null) and (nid, null, other): counts, and links that connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaves = None, {}
        for (a, b, side, node), rows in _groups(batches, ["a", "b", "side", "node"]):
            if (a, b) != at:
                at, leaves = (a, b), {}
            x, weight = _matrix(rows.column("vec").combine_chunks()), rows.column("weight").to_numpy()
            tree, nid = _matrix(rows.column("tree").combine_chunks()).astype(np.int64), rows.column("nid").to_numpy()
            here = Levels(x, weight, tree)
            if side == 0:
                leaves[node] = (here, nid)
                continue
            for partner in rows.column("partners")[0].as_py():
                same = partner == node
                there, others = leaves[partner]
                links_there, links_here, joined = traverse(there, there if same else here, cosine, same)
                names = nid if same else np.r_[others, nid]
                none = np.zeros(0, np.int64)
                i = np.concatenate([none, *(one for one, _ in joined)])
                j = np.concatenate([none, *(two for _, two in joined)]) + (0 if same else len(others))
                counts = links_there if same else np.r_[links_there, links_here]
                u, v = connecting(i, j, len(names))
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[names[some], names[u]]),
                        pa.array([*counts[some].tolist(), *[None] * len(u)], pa.int64()),
                        pa.array([*[None] * len(some), *names[v].tolist()], pa.int64()),
                    ],
                    names=["nid", "links", "other"],
                )

    by = ["a", "b"]
    stream = dealt(planted, pairs, held).repartition(*by).sortWithinPartitions(*by, "side", "node", "place")
    return stream.mapInArrow(run, "nid long, links long, other long")


def whole_leaves(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same rows for pairs of leaves that link whole."""
    leaves = points.groupBy("node").agg(F.sum("weight").alias("total"), F.min("nid").alias("low"))
    one = pairs.select(F.col("p").alias("node"), F.col("q").alias("to"))
    both = one.union(one.where("node != to").select(F.col("to").alias("node"), F.col("node").alias("to")))
    reach = both.join(leaves.select(F.col("node").alias("to"), "total", "low"), "to")
    gained = reach.groupBy("node").agg(
        F.sum("total").alias("gain"), F.min("low").alias("low"), F.max(F.col("to") == F.col("node")).alias("itself")
    )
    own = F.when(F.col("itself"), F.col("weight")).otherwise(0)
    members = points.join(gained, "node").withColumn("links", F.col("gain") - own)
    # One leaf of those reached suffices for each member; leaves are tied by their smallest members.
    star = members.select("nid", F.lit(None).cast("long").alias("links"), F.col("low").alias("other"))
    tie = reach.join(leaves.select("node", F.col("low").alias("mine")), "node").select(
        F.col("mine").alias("nid"), F.lit(None).cast("long").alias("links"), F.col("low").alias("other")
    )
    return members.select("nid", "links", F.lit(None).cast("long").alias("other")).union(star).union(tie)


def link_embeddings(
    vectors: DataFrame, column: str = "embedding", cosine: float = COSINE, leaf: int = LEAF
) -> DataFrame:
    """``vectors`` with n_links, component_id and kept."""
    vectors = vectors.drop("n_links", "component_id", "kept")
    doubles = F.transform(column, lambda x: x.cast("double"))
    named = vectors.withColumn("_vec", F.when(usable(doubles), doubles)).withColumn(
        "_nid", F.when(F.col("_vec").isNotNull(), F.xxhash64("_vec"))
    )
    order = F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST))
    distinct = materialize(
        named.where("_vec is not null").groupBy("_nid").agg(
            F.first("_vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min(order).alias("low")
        )
    )

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec")
            lengths = vecs.value_lengths().to_numpy()
            made = np.empty(len(vecs.flatten()))
            ends = np.cumsum(lengths)
            for length in np.unique(lengths):  # vectors of one length together
                rows = np.flatnonzero(lengths == length)
                at = (ends - lengths)[rows][:, None] + np.arange(length)
                made[at] = unit(vecs.flatten().to_numpy()[at])
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(made))
            yield pa.RecordBatch.from_arrays([batch.column("_nid"), column, batch.column("weight")], names=["nid", "vec", "weight"])

    points = materialize(distinct.select("_nid", "vec", "weight").mapInArrow(units, POINT).withColumn("node", F.size("vec").cast("long")))
    roots = points.select("node").distinct()
    leaves, levels = build_upper(points, leaf)
    pairs = leaf_pairs(roots, levels, threshold_distance(cosine))
    planted = materialize(plant(leaves))
    found = compare_leaves(planted, pairs.where("not whole"), cosine)
    if levels:
        found = found.union(whole_leaves(leaves, pairs.where("whole")))
    found = materialize(found)
    counts = found.where("links is not null").groupBy(F.col("nid").alias("_nid")).agg(F.sum("links").alias("_links"))
    groups = components(found.where("other is not null").select(F.col("nid").alias("u"), F.col("other").alias("v")))
    placed = (
        distinct.select("_nid", "weight", "low")
        .join(groups.withColumnRenamed("node", "_nid"), "_nid", "left")
        .withColumn("component", F.coalesce("component", "_nid"))
    )
    low = placed.groupBy("component").agg(F.min("low").alias("_component"))
    result = (
        placed.join(low, "component").join(counts, "_nid", "left")
        .select("_nid", "_component", (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    component = F.coalesce("_component", order)
    return (
        named.drop("_vec").join(result, "_nid", "left")
        .withColumns(
            {
                "n_links": F.coalesce("n_links", F.lit(0)).cast("long"),
                "component_id": F.when(component < LAST, component),
                "kept": component == order,
            }
        )
        .drop("_nid", "_component")
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return link_embeddings(vectors).select("vec_id", "n_links", "component_id", "kept")


SQL = {
    "op5_embedding_dedup": f"""
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
), n as (
  select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
), links as (
  select a.vec_id as u, b.vec_id as v from n a join n b
    on a.vec_id <> b.vec_id and a.norm > 0 and b.norm > 0
   and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}
), reach(id, other) as (
  select vec_id, vec_id from v union select r.id, l.v from reach r join links l on r.other = l.u
), low as (select id, min(other) as component_id from reach group by id)
select v.vec_id, count(l.v) as n_links, any_value(low.component_id) as component_id,
       v.vec_id = any_value(low.component_id) as kept
from v join low on low.id = v.vec_id left join links l on l.u = v.vec_id group by v.vec_id"""
}
