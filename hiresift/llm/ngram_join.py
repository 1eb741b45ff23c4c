"""N-gram Jaccard self-join, size aware: subsets for light sets, inverted lists for heavy ones.

A document's set are its distinct word shingles (``size`` words, four in op9), as 64-bit hashes.  Equal sets are one node
from the start, so copies cost nothing afterwards.

Light sets (at most ``boundary`` shingles).  Two of them link exactly if they share a subset
of a size that suffices for both, so every light set lists its subsets of those sizes, and
sets that list the same one meet.  Among the sets of a subset, all that link at all link to
the smallest; that star is the output.

Heavy sets, and light ones against heavy ones.  A set of n shingles can miss at most
t = n - ceil(s n) in a partner (s the share ``percent``, 85 in op9), so among any t + 1 of its shingles is one that the partner
has too.  The inverted lists hold, for a fixed quarter of all shingles, the t + 1 of each set
that are rarest in the corpus; sets in which the quarter falls short of t + 1 meet each other
in lists over all their shingles.  Shingles of one set alone open no list, so most sets are in
none.  First come stars: in the lists of its ``SPINE`` rarest shingles each set is compared with
the smallest set of its size, so a group of any number of near copies gives a few links per set
and is one component from then on.  After that a list is scanned for pairs of sets that are not
connected yet; one whose sets are all connected is skipped.  A list is scanned pair by pair only in memory, against parity bitmaps whose Hamming
distance never exceeds the symmetric difference: what they rule out can't link.  From the rest
come, per list, a spanning forest and the closest pairs; these are compared exactly by their
texts.  If a list held pairs back, it is scanned again for pairs of sets that are not connected
yet, with a larger limit, until no list holds back any.  So no link between two components is
lost, and a group of thousands of near copies gives a few links per set.

The boundary comes from the cost of both ways, by the number of sets of each size.

Defined cases: a null or empty text has an empty set and is a component of its own.  Rows
with one doc_id and different texts are compared apart and both bear that id.  A null doc_id
counts as larger than all others and gives a null component_id if nothing else is reached.
Sets are named by 64 bits of their 128-bit hash.  An empty table gives an empty one; texts of
any length are read whole, and compared by their bitmaps first.  Extra columns stay, those with
a result's name are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hiresift.llm.common import add_columns, gram_hashes, lower_ascii, mix, slices, word_hashes
from hiresift.llm.graph import components
from hiresift.operators.joins import ROWS_PER_SALT, salted_join
from hiresift.sources.tables import materialize

SHINGLE = 4
PERCENT = 85
LAST = (1 << 63) - 1
QUARTER = 4  # lists are kept for one shingle in so many
LIGHT_MOST = 19  # beyond this a set has over a thousand subsets
SUBSET_COST = 1.0  # of a subset row against a row of a list, sorting and scanning included
LIST_COST = 4.0
BLOCK = 4096  # sets of one list that a task compares with as many others
SAMPLED = 64
LISTED = "scope int, elem long, sid long"
SPINE = 2  # of a set's lists, the rarest, that take part in stars


# --- sets ---------------------------------------------------------------------------------
def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = [] if text is None else lower_ascii(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(gram_hashes(hashes, min(size, len(hashes))) + np.uint64(min(size, len(hashes))))


def may_miss(n, percent: int = PERCENT):
    """How many of n shingles a partner may lack."""
    return n - -(-percent * n // 100)


def needed(total, percent: int = PERCENT):
    """Least intersection of two sets with ``total`` shingles together."""
    return -(-percent * total // (100 + percent))


def parity(sets: np.ndarray) -> bytes:
    """Of each bit, whether an odd number of shingles falls on it; twice as many bits as shingles."""
    bits = max(256, 1 << (2 * len(sets) - 1).bit_length())
    at = (mix(sets) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def in_quarter(elems: np.ndarray) -> np.ndarray:
    return (elems >> np.uint64(40)) % np.uint64(QUARTER) == 0


def sets_of(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """_doc and _text (the row's name), sid, n_shingles, quarter, bitmap, and the set itself if it is light."""

    def compute(batch: pa.RecordBatch) -> list:
        made = [shingles(t, size) for t in batch.column("text").to_pylist()]
        return [
            [name_of(s) for s in made], [len(s) for s in made],
            [int(in_quarter(s).sum()) for s in made], [parity(s) if len(s) else b"" for s in made],
            [s.view(np.int64).tolist() if len(s) <= LIGHT_MOST else None for s in made],
        ]

    new = "sid long, n_shingles long, quarter long, bitmap binary, light array<long>"
    return add_columns(docs.select("_doc", "_text", "text"), compute, new, drop=["text"])


def name_of(elems: np.ndarray) -> int:
    return (xxhash.xxh3_128_intdigest(elems.tobytes()) & (1 << 64) - 1) - (1 << 63)


def in_no_quarter(n, quarter, percent: int = PERCENT):
    return quarter <= may_miss(n, percent)


# --- light sets ---------------------------------------------------------------------------
def subsets_of(n: int, percent: int = PERCENT) -> int:
    return sum(comb(n, k) for k in range(may_miss(n, percent) + 1))


def boundary_of(sizes: DataFrame, percent: int = PERCENT) -> int:
    """The largest size up to which listing subsets costs no more than keeping inverted lists."""
    rows = sizes.where(F.col("n_shingles").between(1, LIGHT_MOST)).groupBy("n_shingles").agg(F.count(F.lit(1)).alias("sets"))
    count = {r["n_shingles"]: r["sets"] for r in rows.collect()}  # at most LIGHT_MOST rows
    best, lists, subsets = 0, 0.0, 0.0
    for n in range(1, LIGHT_MOST + 1):
        subsets += SUBSET_COST * count.get(n, 0) * subsets_of(n, percent)
        lists += LIST_COST * count.get(n, 0) * n
        if subsets <= lists:
            best = n
    return best


def light_subsets(classes: DataFrame, boundary: int, percent: int = PERCENT) -> DataFrame:
    """key, share (its size), n and sid of every subset that suffices for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for light, sid in zip(batch.column("light").to_pylist(), batch.column("sid").to_pylist(), strict=True):
                elems = mix(np.array(light, np.int64).view(np.uint64)).tolist()
                n, total = len(elems), sum(elems)
                for k in range(may_miss(n, percent) + 1):
                    for out in itertools.combinations(elems, k):
                        rest = (total - sum(out)) % (1 << 64) - (1 << 63)
                        rows.append((rest, n - k, n, sid))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "share", "n", "sid"]
                )

    few = classes.where((F.col("n_shingles") >= 1) & (F.col("n_shingles") <= boundary))
    return few.select("sid", "light").mapInArrow(run, "key long, share long, n long, sid long")


def common_subsets(classes: DataFrame, boundary: int, rows_per_salt: int, percent: int = PERCENT) -> DataFrame:
    """Subsets estimated to be in more than rows_per_salt sets; decides only how they are processed."""
    every = min(SAMPLED, max(1, rows_per_salt // 4))
    part = light_subsets(classes.where(F.pmod(F.xxhash64("sid"), F.lit(every)) == 0), boundary, percent)
    n = part.groupBy("key", "share").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") * every > rows_per_salt).select("key", "share")


def light_links(subsets: DataFrame, percent: int = PERCENT, hot: DataFrame | None = None, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Links (u, v) of light sets: to the smallest set that has the same subset; ``hot`` ones by a salted join."""
    by = ["key", "share"]
    smallest = F.min(F.struct("n", "sid"))
    if hot is None:
        met = subsets.withColumn("hub", smallest.over(W.partitionBy(*by)))
    else:
        cold = subsets.join(F.broadcast(hot), by, "left_anti").withColumn("hub", smallest.over(W.partitionBy(*by)))
        common = subsets.join(F.broadcast(hot), by, "left_semi")
        hubs = common.groupBy(*by).agg(smallest.alias("hub"), F.count(F.lit(1)).alias("_rows"))
        met = cold.unionByName(salted_join(common, hubs, by, "sid", sizes="_rows", rows_per_salt=rows_per_salt))
    fits = 100 * F.col("share") >= percent * (F.col("n") + F.col("hub.n") - F.col("share"))
    return met.where(fits & (F.col("sid") != F.col("hub.sid"))).select(
        F.col("sid").alias("u"), F.col("hub.sid").alias("v")
    )


# --- inverted lists -----------------------------------------------------------------------
def postings(docs: DataFrame, least: int, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """scope 1: the quarter's shingles of every set of at least ``least``; scope 0: all, where the quarter is too small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made, seen = [], set()
                for text in part.column("text").to_pylist():
                    elems = shingles(text, size)
                    sid = name_of(elems)
                    if len(elems) < least or sid in seen:
                        continue
                    seen.add(sid)
                    some = elems[in_quarter(elems)]
                    made.append((1, some, sid))
                    if in_no_quarter(len(elems), len(some), percent):
                        made.append((0, elems, sid))
                if made:
                    sizes = [len(e) for _, e, _ in made]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([s for s, _, _ in made], sizes).astype(np.int32)),
                            pa.array(np.concatenate([e for _, e, _ in made]).view(np.int64)),
                            pa.array(np.repeat(np.array([i for _, _, i in made], np.int64), sizes)),
                        ],
                        names=["scope", "elem", "sid"],
                    )

    return docs.select("text").mapInArrow(run, LISTED)


def shared_postings(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Postings of shingles that several sets have, with the shingle's number of rows."""
    here = W.partitionBy("scope", "elem")
    low, high, n = F.min("sid"), F.max("sid"), F.count(F.lit(1))
    cold = rows if hot is None else rows.join(F.broadcast(hot), "elem", "left_anti")
    found = cold.withColumns({"lo": low.over(here), "hi": high.over(here), "df": n.over(here)}).where("lo < hi")
    found = found.select("scope", "elem", "sid", "df")
    if hot is None:
        return found
    common = rows.join(F.broadcast(hot), "elem", "left_semi")
    counted = common.groupBy("scope", "elem").agg(low.alias("lo"), high.alias("hi"), n.alias("df")).where("lo < hi")
    counted = F.broadcast(counted.select("scope", "elem", "df"))  # no more rows than twice those of hot
    return found.unionByName(common.join(counted, ["scope", "elem"]).select("scope", "elem", "sid", "df"))


def common_shingles(docs: DataFrame, least: int, rows_per_salt: int, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Shingles estimated to be in more than rows_per_salt rows; decides only how they are processed."""
    every = min(SAMPLED, max(1, rows_per_salt // 4))
    part = docs.where(F.pmod(F.xxhash64("_doc"), F.lit(every)) == 0)
    n = postings(part, least, size, percent).groupBy("elem").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") * every > rows_per_salt).select("elem")


def prefixes(shared: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """scope, elem, sid, rank (0: the rarest): the rarest shingles of each set, as many as a partner can't miss all of."""
    n, quarter = F.col("n_shingles"), F.col("quarter")
    posted = F.when(F.col("scope") == 0, n).otherwise(quarter)
    missing = n - F.ceil(percent * n / 100)
    per_set = shared.groupBy("scope", "sid").agg(F.collect_set(F.struct("df", "elem")).alias("own"))
    take = missing + 1 - (posted - F.size("own"))
    return (
        per_set.join(classes.select("sid", "n_shingles", "quarter"), "sid")
        .withColumn("take", F.least(take, F.size("own")).cast("int"))
        .where("take > 0")
        .select("scope", "sid", F.posexplode(F.slice(F.array_sort("own"), 1, F.col("take"))).alias("rank", "x"))
        .select("scope", F.col("x.elem").alias("elem"), "sid", "rank")
    )


# --- scanning lists -----------------------------------------------------------------------
def _folded(bitmaps: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, larger ones halved onto themselves; the parity stays true."""
    out = np.zeros((len(bitmaps), bits // 64), np.uint64)
    for i, b in enumerate(bitmaps):
        words = np.frombuffer(b, np.uint64)
        out[i] = np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)
    return out


def close_pairs(n: np.ndarray, bitmaps: list[bytes], group: np.ndarray, side: np.ndarray | None, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """Pairs i < j (sets sorted by size) that the bitmaps and sizes allow, of different groups; and their distance.

    With ``side`` only pairs from one side to the other are of interest.
    """
    bits = np.array([8 * len(b) for b in bitmaps])
    found = []
    for level in np.unique(bits):
        rows = np.flatnonzero(bits == level)
        begin, end = rows[0], int(np.searchsorted(n, n[rows[-1]] * 100 // percent, side="right"))
        words = _folded(bitmaps[begin:end], int(level))
        chunk = max(1, (1 << 24) // max(1, words.nbytes))
        for at in range(0, len(rows), chunk):
            some = rows[at : at + chunk]
            distance = np.bitwise_count(words[some - begin][:, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64)
            other = np.arange(begin, end)
            total = n[some][:, None] + n[other][None, :]
            ok = (other[None, :] > some[:, None]) & (100 * n[some][:, None] >= percent * n[other][None, :])
            ok &= (distance <= total - 2 * needed(total, percent)) & (group[some][:, None] != group[other][None, :])
            if side is not None:
                ok &= side[some][:, None] != side[other][None, :]
            i, j = np.nonzero(ok)
            found.append((some[i], other[j], distance[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def chosen(i: np.ndarray, j: np.ndarray, distance: np.ndarray, group: np.ndarray, n: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs to compare now: a forest of closest pairs that spans the groups, and the closest ones."""
    order = np.argsort(distance / (n[i] + n[j]), kind="stable")
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    take = np.zeros(len(i), bool)
    take[order[:limit]] = True
    for k in order.tolist():
        a, b = root(int(group[i[k]])), root(int(group[j[k]]))
        if a != b:
            parent[a] = b
            take[k] = True
    return take


def may_link(n_i: np.ndarray, n_j: np.ndarray, left: list[bytes], right: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Whether the bitmaps of pairs of sets allow a link."""
    bits = [np.fromiter((8 * len(b) for b in side), np.int64, len(side)) for side in (left, right)]
    low = np.minimum(*bits)
    keep = np.zeros(len(low), bool)
    for level in np.unique(low).tolist():
        here = np.flatnonzero(low == level)
        chunk = max(1, (1 << 24) // max(1, level))
        for begin in range(0, len(here), chunk):
            some = here[begin : begin + chunk]
            a, b = (_folded([side[x] for x in some], level) for side in (left, right))
            distance = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            keep[some] = distance <= n_i[some] + n_j[some] - 2 * needed(n_i[some] + n_j[some], percent)
    return keep


def small_pairs(n: np.ndarray, bitmaps: list[bytes], group: np.ndarray, side: np.ndarray, begin: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """``close_pairs`` of many short lists at once, each from ``begin`` on ``size`` rows long."""
    first, second = [], []
    for k in np.unique(size):
        a, b = np.triu_indices(int(k), 1)
        at = begin[size == k]
        first.append((at[:, None] + a).ravel())
        second.append((at[:, None] + b).ravel())
    i, j = np.concatenate(first), np.concatenate(second)
    ok = (100 * n[i] >= percent * n[j]) & (group[i] != group[j]) & (side[i] != side[j])
    i, j = i[ok], j[ok]
    keep = may_link(n[i], n[j], [bitmaps[x] for x in i], [bitmaps[x] for x in j], percent)
    return i[keep], j[keep]


BY = ["scope", "elem", "bi", "bj"]
FOUND = "u long, v long, scope int, elem long, bi int, bj int"
SHORT_LIST = 9  # such a list has at most four pairs a set, so it never holds any back


def candidates(listed: DataFrame, wave: int, percent: int = PERCENT) -> DataFrame:
    """(u, v) to compare; and the keys of lists that held pairs back, without u and v."""

    def result(u: np.ndarray, v: np.ndarray, cut: list[tuple]) -> pa.RecordBatch:
        none = [None] * len(u)
        keys = [[*none, *(int(k[c]) for k in cut)] for c in range(4)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*u.tolist(), *[None] * len(cut)], pa.int64()), pa.array([*v.tolist(), *[None] * len(cut)], pa.int64()),
                *(pa.array(k, kind) for k, kind in zip(keys, kinds, strict=True)),
            ],
            names=["u", "v", *BY],
        )

    def scan(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole lists, each sorted by the size of its sets."""
        keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in BY], axis=1)
        begin = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]
        size = np.diff(np.r_[begin, len(keys)])
        n, sid, group = (rows.column(c).to_numpy() for c in ("n", "sid", "component"))
        # In a list of two blocks pairs go from one to the other; in others every row is a side of its own.
        two = keys[:, 2] != keys[:, 3]
        side = np.where(two, rows.column("block").to_numpy(), -1 - np.arange(len(keys)))
        bitmaps = rows.column("bitmap").to_pylist()
        few = (size > 1) & (size <= SHORT_LIST)
        u, v, cut = [], [], []
        if few.any():
            i, j = small_pairs(n, bitmaps, group, side, begin[few], size[few], percent)
            u.append(sid[i]), v.append(sid[j])
        for b, k in zip(begin[size > SHORT_LIST].tolist(), size[size > SHORT_LIST].tolist(), strict=True):
            own = slice(b, b + k)
            if (group[own] == group[b]).all():
                continue
            i, j, distance = close_pairs(n[own], bitmaps[own], group[own], side[own] if two[b] else None, percent)
            limit = 4 * k * 4**wave
            if len(i) > limit:
                take = chosen(i, j, distance, group[own], n[own], limit)
                i, j = i[take], j[take]
                cut.append(tuple(keys[b]))
            u.append(sid[own][i]), v.append(sid[own][j])
        if sum(map(len, u)) or cut:
            pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
            yield result(pairs[0], pairs[1], cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last list of a batch may go on in the next
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in BY], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if held and (keys[0] != [held[-1].column(c)[0].as_py() for c in BY]).any():
                yield from scan(pa.concat_batches(held))
                held = []
            if len(edges):
                yield from scan(pa.concat_batches([*held, batch.slice(0, int(edges[-1]))]))
                held = [batch.slice(int(edges[-1]))]
            else:
                held.append(batch)
        if held:
            yield from scan(pa.concat_batches(held))

    return listed.repartition(*BY).sortWithinPartitions(*BY, "n", "sid").mapInArrow(run, FOUND)


def blocked(lists: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Postings with size and bitmap; a list beyond ``block`` sets as pairs of blocks."""
    sizes = lists.groupBy("scope", "elem").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    mine = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    return (
        lists.join(sizes, ["scope", "elem"])
        .join(classes.select("sid", F.col("n_shingles").alias("n"), "bitmap"), "sid")
        .withColumns({"block": mine, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        .withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
        .drop("_n", "other")
    )


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs whose texts' sets reach the threshold; exact."""

    def compute(batch: pa.RecordBatch) -> list:
        out = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = shingles(a, size), shingles(b, size)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return [out]

    named = pairs.join(texts.select(F.col("sid").alias("u"), F.col("text").alias("a")), "u")
    named = named.join(texts.select(F.col("sid").alias("v"), F.col("text").alias("b")), "v")
    return add_columns(named, compute, "linked boolean", sized_by="a", drop=["a", "b"]).where("linked").select("u", "v")


def star_pairs(lists: DataFrame, classes: DataFrame, rows_per_salt: int, percent: int = PERCENT) -> DataFrame:
    """(u, v): each set with the smallest set about its size in the lists of its rarest shingles, if the bitmaps allow a link."""
    by = ["scope", "elem", "band"]
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent))) if percent < 100 else F.col("n")
    sets = classes.select("sid", F.col("n_shingles").alias("n"), "bitmap")
    rows = lists.where(F.col("rank") < SPINE).join(sets, "sid").withColumn("band", band.cast("long")).select(*by, "sid", "n", "bitmap")
    hubs = rows.groupBy(*by).agg(F.min(F.struct("n", "sid", "bitmap")).alias("hub"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    met = salted_join(rows, hubs, by, "sid", sizes="_rows", rows_per_salt=rows_per_salt).where("sid <> hub.sid")
    pairs = met.select(
        F.col("sid").alias("u"), F.col("hub.sid").alias("v"), "n", F.col("hub.n").alias("least"), "bitmap", F.col("hub.bitmap").alias("other")
    ).where(100 * F.col("least") >= percent * F.col("n"))

    def compute(batch: pa.RecordBatch) -> list:
        sizes = (batch.column(c).to_numpy() for c in ("n", "least"))
        maps = (batch.column(c).to_pylist() for c in ("bitmap", "other"))
        return [may_link(*sizes, *maps, percent)]

    judged = add_columns(pairs, compute, "near boolean", sized_by="bitmap", drop=["n", "least", "bitmap", "other"])
    return judged.where("near").select("u", "v").distinct()


def list_links(
    lists: DataFrame, classes: DataFrame, texts: DataFrame, links: DataFrame, block: int,
    size: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """All links that lists give, beyond those that follow from ``links`` and each other."""
    listed = materialize(blocked(lists, classes, block))
    wave = 0
    while True:
        if links.isEmpty():
            here = listed.withColumn("component", F.col("sid"))
        else:
            known = components(links).select(F.col("node").alias("sid"), "component")
            here = listed.join(known, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        found = materialize(candidates(here, wave, percent))
        new = verified(found.where("u is not null").select("u", "v").distinct(), texts, size, percent)
        links = materialize(links.unionByName(new))
        cut = found.where("u is null").select(*BY)
        if cut.isEmpty():
            return links
        listed = materialize(listed.join(cut, BY, "left_semi"))
        wave += 1


def join_ngrams(
    docs: DataFrame, rows_per_salt: int = ROWS_PER_SALT, block: int = BLOCK, size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``docs`` with n_shingles and component_id; sets of ``size``-word shingles link from ``percent`` on."""
    return _grouped(docs, rows_per_salt, block, size, percent).drop("_doc", "_text", "_low", "_rows")


def first_of_groups(
    docs: DataFrame, rows_per_salt: int = ROWS_PER_SALT, block: int = BLOCK, size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row of each group of linked documents: of the smallest id, and of that the smallest hash of a text.

    So of near copies without an id, or with one id, one stays too, and of equal rows one.
    Documents without words are linked with nothing and stay.
    """
    name = F.struct("_doc", "_text")
    grouped = _grouped(docs, rows_per_salt, block, size, percent)
    kept = grouped.where((F.col("n_shingles") == 0) | (F.col("_low") == name))
    again = (F.col("n_shingles") > 0) & (F.col("_rows") > 1)
    whole = kept.where(~again).unionByName(kept.where(again).dropDuplicates(["_doc", "_text"]))
    return whole.drop("n_shingles", "component_id", "_doc", "_text", "_low", "_rows")


def _grouped(docs: DataFrame, rows_per_salt: int, block: int, size: int, percent: int) -> DataFrame:
    """``docs`` with n_shingles, component_id, the rows' names, ``_low``, the first name of the component, and ``_rows`` of a name."""
    docs = docs.drop("n_shingles", "component_id").withColumns(
        {"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_text": F.xxhash64("text")}
    )
    members = materialize(sets_of(docs, size))
    classes = materialize(
        members.where("n_shingles > 0")
        .groupBy("sid")
        .agg(
            F.min(F.struct("_doc", "_text")).alias("rep"), F.first("n_shingles").alias("n_shingles"),
            F.first("quarter").alias("quarter"), F.first("bitmap").alias("bitmap"), F.first("light").alias("light"),
        )
    )
    boundary = boundary_of(classes, percent)
    least = -(-percent * (boundary + 1) // 100)  # a smaller light set has no heavy partner
    often = materialize(common_subsets(classes, boundary, rows_per_salt, percent))
    often = None if often.isEmpty() else often
    links = materialize(light_links(light_subsets(classes, boundary, percent), percent, often, rows_per_salt).distinct())
    hot = materialize(common_shingles(docs, least, rows_per_salt, size, percent))
    hot = None if hot.isEmpty() else hot
    lists = materialize(prefixes(shared_postings(postings(docs, least, size, percent), hot), classes, percent))
    in_lists = lists.groupBy("scope", "elem").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi")
    lists = materialize(lists.join(in_lists.select("scope", "elem"), ["scope", "elem"]))
    reps = lists.select("sid").distinct().join(classes.select("sid", "rep.*"), "sid")
    texts = materialize(docs.select("_doc", "_text", "text").join(reps, ["_doc", "_text"]).select("sid", "text").dropDuplicates(["sid"]))
    stars = verified(star_pairs(lists, classes, rows_per_salt, percent), texts, size, percent)
    links = materialize(links.unionByName(stars))
    links = list_links(lists.drop("rank"), classes, texts, links, block, size, percent)
    groups = components(links)
    first = (
        classes.select("sid", F.col("rep").alias("_low"))
        .join(groups.withColumnRenamed("node", "sid"), "sid", "left")
        .withColumn("component", F.coalesce("component", "sid"))
    )
    low = first.groupBy("component").agg(F.min("_low").alias("_low"))
    per_set = first.drop("_low").join(low, "component").select("sid", "_low")
    per_row = (
        members.groupBy("_doc", "_text").agg(F.first("sid").alias("sid"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("_rows"))
        .join(per_set, "sid", "left")
        .select("_doc", "_text", "n_shingles", "_low", "_rows", F.coalesce("_low._doc", "_doc").alias("component_id"))
    )
    return docs.join(per_row, ["_doc", "_text"], "left").withColumn(
        "component_id", F.when(F.col("component_id") < LAST, F.col("component_id"))
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_ngrams(docs, size=SHINGLE, percent=PERCENT).select("doc_id", "n_shingles", "component_id")


SQL = {
    "op9_ngram_join": f"""
with recursive split as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents
), shingled as (
  select doc_id, list_distinct(case when len(words) between 1 and {SHINGLE - 1} then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' ')) end) as shingles
  from split
), elems as (
  select doc_id, len(shingles) as n, unnest(shingles) as s from shingled
), links as (
  select a.doc_id as u, b.doc_id as v from elems a join elems b
    on a.s = b.s and a.doc_id <> b.doc_id and 100 * a.n >= {PERCENT} * b.n and 100 * b.n >= {PERCENT} * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), reach(id, other) as (
  select doc_id, doc_id from documents union select r.id, l.v from reach r join links l on r.other = l.u
)
select d.doc_id, len(d.shingles)::bigint as n_shingles, (select min(other) from reach where id = d.doc_id) as component_id from shingled d"""
}
