"""Line dedup that can be taken back: cuckoo filters per shard over an exact reference table.

State of the store, two tables:

* ``refs`` (shard, k1, k2, doc_id): which document holds which line key, one row each.  The
  reference count of a key is its number of rows; it is exact, and deleting a document
  deletes its rows.
* ``filters`` (shard, filter): per shard a cuckoo filter over the keys that at least
  ``min_docs`` documents hold.  A key enters when an insertion lifts its count to that
  number and leaves when a deletion takes it below; cuckoo filters, unlike Bloom filters,
  allow that.  They answer most probes; what they let through is confirmed by the counts.

Keys are 128-bit hashes of the stripped, lower-cased line, so no line text is moved.  The number
of shards is a power of two, kept in the store, and grows with the keys in the filters: when it
doubles, each shard splits in two and the filters are filled again from the exact table.

Defined cases: a null or empty text is one empty line.  Rows with one doc_id count as one
document and each row loses the same lines.  A null doc_id sorts after all others, so its
rows keep lines that are shared.  Keys shorter than ``min_chars`` code points always stay.
Extra columns are kept; the result's own names are replaced.  Texts of any length are split in
the row.  An empty table gives an empty one.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.operators.joins import salted_join
from hiresift.sources.tables import materialize

MIN_CHARS, MIN_DOCS, SHARDS, SALTS = 20, 3, 64, 8
KEYS_PER_SHARD = 1 << 20  # a filter of about 3 MB; beyond it the number of shards is doubled
BLANKS = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1  # stands for a null doc_id
KEYS = ["shard", "k1", "k2"]
CARRIED = ["doc_id", "text_hash", "line_no", *KEYS]
SLOTS, EMPTY, KICKS, MAX_LOAD = 4, 0, 500, 0.9


# --- the filter ---------------------------------------------------------------------------
class CuckooFilter:
    """16-bit fingerprints in buckets of four; what finds no place goes to an exact stash."""

    def __init__(self, buckets: int = 16):
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.stash: list[tuple[int, int]] = []

    @staticmethod
    def sized_for(keys: int) -> CuckooFilter:
        return CuckooFilter(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8))))))

    def _places(self, k1, k2):
        k1, k2 = np.asarray(k1, np.int64).view(np.uint64), np.asarray(k2, np.int64).view(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        mark = (k2 >> np.uint64(48)).astype(np.uint16)
        mark[mark == EMPTY] = 1
        first = k1 & mask
        return mark, first.astype(np.int64), (first ^ self._jump(mark)).astype(np.int64)

    def _jump(self, mark):
        return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(len(self.table) - 1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        marks, ones, twos = self._places(k1, k2)
        rest = np.arange(len(marks))
        for places in (ones, twos):  # what finds a free slot in its first or second bucket, all at once
            rest = rest[np.argsort(places[rest], kind="stable")]
            bucket = places[rest]
            new = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
            rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
            full = self.table[bucket] != EMPTY
            fits = rank < SLOTS - full.sum(axis=1)
            slot = np.argsort(full, axis=1, kind="stable")[np.arange(len(bucket)), np.minimum(rank, SLOTS - 1)]
            self.table[bucket[fits], slot[fits]] = marks[rest[fits]]
            rest = rest[~fits]
        for i in rest.tolist():
            if not self._place(int(marks[i]), int(ones[i]), int(twos[i])):
                self.stash.append((int(k1[i]), int(k2[i])))

    def _place(self, mark: int, one: int, two: int) -> bool:
        moved = []
        for step in range(KICKS):
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == EMPTY)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    return True
            slot = step % SLOTS
            moved.append((two, slot))
            mark, self.table[two, slot] = int(self.table[two, slot]), mark
            one, two = two, two ^ int(self._jump(np.array([mark], np.uint16))[0])
        for bucket, slot in reversed(moved):  # undo, so that no other key is lost
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for a, b, mark, one, two in zip(k1, k2, *(x.tolist() for x in self._places(k1, k2)), strict=True):
            if (int(a), int(b)) in self.stash:
                self.stash.remove((int(a), int(b)))
                continue
            for bucket in (one, two):
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = EMPTY
                    break

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(k1, k2)
        found = ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)
        for a, b in self.stash:
            found |= (np.asarray(k1) == a) & (np.asarray(k2) == b)
        return found

    def load(self) -> int:
        return int((self.table != EMPTY).sum()) + len(self.stash)

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, np.int64).reshape(-1, 2)
        return np.int64(len(self.table)).tobytes() + self.table.tobytes() + stash.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        buckets = int(np.frombuffer(data, np.int64, 1)[0])
        end = 8 + buckets * SLOTS * 2
        out = CuckooFilter(buckets)
        out.table = np.frombuffer(data[8:end], np.uint16).reshape(buckets, SLOTS).copy()
        out.stash = [(int(a), int(b)) for a, b in np.frombuffer(data[end:], np.int64).reshape(-1, 2)]
        return out


# --- keys ---------------------------------------------------------------------------------
def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int = SHARDS) -> DataFrame:
    """One row per long line: doc_id (null: LAST), the text's hash, line_no, shard, k1, k2."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    keys = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("line_no"), _key(line).alias("key"))),
        lambda x: F.char_length(x["key"]) >= min_chars,
    )
    hashed = docs.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.inline(keys)
    ).select(
        "doc_id", "text_hash", "line_no", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")
    )
    return hashed.withColumn("shard", _shard(shards))


def _shard(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int")


# --- the store ----------------------------------------------------------------------------
@dataclass
class LineStore:
    refs: DataFrame
    filters: DataFrame
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    shards: int = SHARDS


def empty_store(spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int = SHARDS) -> LineStore:
    refs = spark.createDataFrame([], "doc_id long, k1 long, k2 long, shard int")
    return LineStore(refs, spark.createDataFrame([], "shard int, filter binary"), min_docs, min_chars, shards)


def counts(refs: DataFrame) -> DataFrame:
    """Exact reference counts and the largest holder; merged in the tasks before the shuffle."""
    return refs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _updated(shard_filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """Filters after keys have entered (change 1) or left (-1); keys that stay (0) serve to grow a filter.

    Shards are dealt to as many tasks, which a shuffle of small keys wouldn't do by itself.
    """

    def update(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else new)["shard"].iloc[0])
        enter, leave, held = new[new["change"] > 0], new[new["change"] < 0], new[new["change"] >= 0]
        f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(0)
        if len(held) > f.table.size * MAX_LOAD:  # a larger one, filled from the exact table
            f, enter, leave = CuckooFilter.sized_for(len(held)), held, leave[:0]
        f.delete(leave["k1"].to_numpy(), leave["k2"].to_numpy())
        f.insert(enter["k1"].to_numpy(), enter["k2"].to_numpy())
        return pd.DataFrame({"shard": [shard], "filter": [f.to_bytes()]})

    return (
        shard_filters.repartition(shards, "shard").groupBy("shard")
        .cogroup(changes.repartition(shards, "shard").groupBy("shard"))
        .applyInPandas(update, "shard int, filter binary")
    )


def _crossings(before: DataFrame, after: DataFrame, min_docs: int) -> DataFrame:
    """Keys that ``min_docs`` documents hold or held: entering 1, leaving -1, staying 0."""
    b, a = before.select(*KEYS, F.col("n_docs").alias("b")), after.select(*KEYS, F.col("n_docs").alias("a"))
    is_in, was_in = F.coalesce("a", F.lit(0)) >= min_docs, F.coalesce("b", F.lit(0)) >= min_docs
    return (
        b.where(F.col("b") >= min_docs)
        .join(a.where(F.col("a") >= min_docs), KEYS, "full")
        .select(*KEYS, (is_in.cast("int") - was_in.cast("int")).alias("change"))
    )


def _grown(shards: int, changes: DataFrame) -> int:
    """The number of shards for the keys that the filters will hold; never fewer than before."""
    held = changes.where("change >= 0").count()
    while held > shards * KEYS_PER_SHARD:
        shards *= 2
    return shards


def insert(store: LineStore, docs: DataFrame) -> LineStore:
    """Add documents; a document that is there already keeps its old references too."""
    added = line_keys(docs, store.min_chars, store.shards).select(*store.refs.columns)
    refs = materialize(store.refs.unionByName(added).groupBy(*KEYS, "doc_id").agg(F.lit(1).alias("_one")).drop("_one"))
    changes = materialize(_crossings(counts(store.refs), counts(refs), store.min_docs))
    shards, filters = _grown(store.shards, changes), store.filters
    if shards > store.shards:  # every key of a filter enters one of the new ones
        split = _shard(shards)
        refs, filters = refs.withColumn("shard", split), filters.limit(0)
        changes = changes.where("change >= 0").withColumns({"shard": split, "change": F.lit(1)})
    return LineStore(refs, materialize(_updated(filters, changes, shards)), store.min_docs, store.min_chars, shards)


def delete(store: LineStore, doc_ids: DataFrame) -> LineStore:
    """Take documents out: ``delete(insert(s, d), ids of d)`` answers like ``s``."""
    gone = doc_ids.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id")).distinct()
    refs = materialize(store.refs.join(gone, "doc_id", "left_anti").select(*store.refs.columns))
    changes = _crossings(counts(store.refs), counts(refs), store.min_docs)
    return LineStore(refs, materialize(_updated(store.filters, changes, store.shards)), store.min_docs, store.min_chars, store.shards)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, salt, filter first); passes on the keys the filter may hold.

    Only one filter and one batch are in memory, however many lines a shard has.
    """
    at, held = None, None
    for batch in batches:
        where = np.stack([batch.column("shard").to_numpy(), batch.column("salt").to_numpy()], axis=1)
        edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
        for begin, end in zip(edges, edges[1:], strict=False):
            if begin == end:
                continue
            if at != tuple(where[begin]):
                at, held = tuple(where[begin]), None
            part = batch.slice(begin, end - begin)
            filters = part.column("filter")
            lead = len(filters) - filters.null_count
            if lead:
                held = CuckooFilter.from_bytes(filters[0].as_py())
                part = part.slice(lead)
            if held is None or not len(part):
                continue
            may = held.contains(part.column("k1").to_numpy(), part.column("k2").to_numpy())
            yield part.select(CARRIED).filter(pa.array(may))


def drops(store: LineStore, docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(doc_id, text_hash, line_no) of the lines to drop."""
    lines = line_keys(docs, store.min_chars, store.shards).withColumn("salt", F.pmod("doc_id", F.lit(salts)).cast("int"))
    filters = store.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    probes = lines.unionByName(filters, allowMissingColumns=True).repartition("shard", "salt")
    probes = probes.sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    maybe = probes.mapInArrow(_probe, "doc_id long, text_hash long, line_no int, shard int, k1 long, k2 long")
    shared = materialize(counts(store.refs).where(F.col("n_docs") >= store.min_docs))
    found = salted_join(maybe, shared, KEYS, "doc_id", sizes="n_docs")
    return found.where(F.col("doc_id") < F.col("last_doc")).select("doc_id", "text_hash", "line_no")


def dedup_lines(store: LineStore, docs: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and the text without the dropped lines."""
    per_doc = (
        drops(store, docs)
        .groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
        .agg(F.collect_set("line_no").alias("_drop"))  # at most the lines of one document
    )
    docs = docs.drop("n_lines", "n_dropped")
    same = (F.coalesce(docs["doc_id"], F.lit(LAST)) == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_drop")
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(F.transform(left, lambda i: F.get(lines, i)))
    return (
        docs.join(per_doc, same, "left")
        .withColumns({"n_lines": F.size(lines).cast("long"), "_kept": kept})
        .withColumns(
            {
                "n_dropped": F.col("n_lines") - F.size("_kept"),
                "text": F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")),
            }
        )
        .drop("_drop", "_doc", "_hash", "_kept")
    )


def dedup_whole(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Line dedup of a whole table: everything goes into an empty store and is then judged by it."""
    return dedup_lines(insert(empty_store(docs.sparkSession, min_docs, min_chars), docs), docs)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return dedup_whole(docs).select("doc_id", "n_lines", "n_dropped", sha)


SQL = {
    "op4_line_dedup": f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as line_no
  from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{string.ascii_uppercase}', '{string.ascii_lowercase}') as key
  from lines
), shared as (
  select key, max(doc_id) as last_doc from keyed where length(key) >= {MIN_CHARS}
  group by key having count(distinct doc_id) >= {MIN_DOCS}
), judged as (
  select k.*, s.key is not null and k.doc_id < s.last_doc as gone from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (where not gone), '')) as kept_sha256
from judged group by doc_id"""
}
