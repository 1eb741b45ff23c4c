"""Substring dedup by seed and extend.

Seeds.  Every window of ``WINDOW`` words has an anchor: of its word ``ANCHOR``-grams the one
with the smallest hash, the last among equals.  This winnowing depends on the window's words
only, so equal windows have equal anchors at equal places; consecutive windows mostly share
one.  A seed is an anchor with the run of windows that chose it.

Join and extend.  Seeds meet on the anchor's hash.  Extending a match as far as the run's
windows reach on both sides is comparing the runs' first and last windows (they overlap, so
they spell the whole run): seeds that agree there are one class, and all but the first of a
class have every window repeated.  Only where one anchor occurs in several classes, that is
at the ends of repeats, are the first seeds of the classes extended window by window, and
every window after the first with the same words is a repeat.  Overlapping windows merge to
the maximal repeated stretches of a document, whose words are removed.

No pairs are made: each step finds the first of a group.  Anchors that are estimated to occur
in more than ``rows_per_salt`` documents take a way of their own (aggregates, merged before the
shuffle, and a salted join); the others are sorted together.  Repeats inside one document
are found in the document, so only the first seed of a class in it is moved.  Words are
compared through 64-bit hashes, and windows by two of them; a row is named by its id and two
64-bit hashes of its text.

Defined cases: a null text has no words.  Texts under ``WINDOW`` words keep everything.  A
null doc_id counts as larger than all others.  Of rows with one doc_id, windows at the same
place are not earlier than each other, so equal rows keep their words alike.  The words come
out joined by one space; extra columns stay, those with a result's name are replaced.  Texts of
any length are read whole, each by itself.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hiresift.llm.common import add_columns, gram_hashes, mix, slices, word_hashes, words_of
from hiresift.operators.joins import ROWS_PER_SALT, salted_join
from hiresift.sources.tables import materialize

WINDOW, ANCHOR = 20, 5
LAST = (1 << 63) - 1
SAMPLED = 64  # one document in so many estimates which anchors are very common
ROW = ["_doc", "_text", "_text2"]  # what names a row: its id and 128 bits of hashes of its text
LOW = np.uint64((1 << 24) - 1)


# --- one document -------------------------------------------------------------------------
def anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, its place, first and last window of each run, for a text's word hashes."""
    grams = gram_hashes(hashes, anchor)
    n, width = len(hashes) - window + 1, window - anchor + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    # High bits of the hash, then the place counted downwards: the minimum is the last of the smallest.
    least = (grams & ~LOW) | (LOW - (np.arange(len(grams), dtype=np.uint64) & LOW))
    seen = 1
    while seen < width:
        step = min(seen, width - seen)
        least = np.minimum(least[:-step], least[step:])
        seen += step
    place = (LOW - (least & LOW)).astype(np.int64)
    place += (np.arange(n) - place + width - 1) >> 24 << 24  # texts beyond 2^24 words
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return grams[place[first]], place[first], first, np.r_[first[1:], n] - 1


def classes(windows: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A key of the words of each run and of where in it the anchor stands."""
    extent = ((place - first) << 8 | (last - first)).astype(np.uint64)
    return mix(windows[first] * np.uint64(0x9E3779B97F4A7C15) + mix(windows[last] + extent))


def repeated_inside(windows: np.ndarray) -> np.ndarray:
    """Starts of windows whose words start earlier in the same text too."""
    if not len(windows):
        return np.zeros(0, np.int64)
    _, first = np.unique(windows, return_index=True)
    again = np.ones(len(windows), bool)
    again[first] = False
    return np.flatnonzero(again)


def covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words the stretches cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, np.minimum(ends, n), -1)
    return np.cumsum(steps[:-1]) > 0


# --- all documents ------------------------------------------------------------------------
def named_rows(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_text": F.xxhash64("text"), "_text2": F.xxhash64(F.lit(1), "text")}
    )


def seeds(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """anchor, class, row name, and place, first and last of the run; one per class and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "class", *ROW, "place", "first", "last"]
        for batch in batches:
            for part in slices(batch, "text"):
                made = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    hashes = word_hashes(words_of(text))
                    if len(hashes) < window:
                        continue
                    key, place, first, last = anchors(hashes, window, anchor)
                    kind = classes(gram_hashes(hashes, window), place, first, last)
                    _, keep = np.unique(kind, return_index=True)
                    made.append((key[keep], kind[keep], np.full(len(keep), i), place[keep], first[keep], last[keep]))
                if not made:
                    continue
                key, kind, row, place, first, last = (np.concatenate(c) for c in zip(*made, strict=True))
                columns = [
                    pa.array(key.view(np.int64)), pa.array(kind.view(np.int64)),
                    *(part.column(c).take(pa.array(row)) for c in ROW),
                    *(pa.array(c.astype(np.int32)) for c in (place, first, last)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*ROW, "text").mapInArrow(
        run, "anchor long, class long, _doc long, _text long, _text2 long, place int, first int, last int"
    )


def common_anchors(docs: DataFrame, rows_per_salt: int, window: int, anchor: int) -> DataFrame:
    """Anchors estimated to occur in more than rows_per_salt rows: few, whatever the input.

    The estimate only decides how a group is processed; it has no part in the result.
    """
    every = min(SAMPLED, max(1, rows_per_salt // 4))
    part = docs.where(F.pmod(F.xxhash64("_doc"), F.lit(every)) == 0)
    n = seeds(part, window, anchor).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") * every > rows_per_salt).select("anchor")


def with_first(rows: DataFrame, keys: list[str], place: str, hot: DataFrame | None, rows_per_salt: int) -> DataFrame:
    """``rows`` with ``later``: whether a row with the same keys comes before in (_doc, place)."""
    order = W.partitionBy(*keys).orderBy("_doc", place)
    here = F.struct("_doc", place)
    if hot is None:
        return rows.withColumn("later", F.first(here).over(order) < here)
    cold = rows.join(F.broadcast(hot), "anchor", "left_anti").withColumn("later", F.first(here).over(order) < here)
    common = rows.join(F.broadcast(hot), "anchor", "left_semi")
    first = common.groupBy(*keys).agg(F.min(here).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    split = salted_join(common, first, keys, F.struct("_doc", place), sizes="_rows", rows_per_salt=rows_per_salt)
    return cold.unionByName(split.withColumn("later", F.col("_first") < here).drop("_first"))


def extended(found: DataFrame, hot: DataFrame | None, rows_per_salt: int) -> DataFrame:
    """Seeds with ``later``, and ``many``: whether their anchor has more than one class."""
    judged = with_first(found, ["anchor", "class"], "place", hot, rows_per_salt)
    low, high = F.min("class"), F.max("class")
    if hot is None:
        both = W.partitionBy("anchor")
        return judged.withColumn("many", low.over(both) < high.over(both))
    cold = judged.join(F.broadcast(hot), "anchor", "left_anti")
    both = W.partitionBy("anchor")
    common = judged.join(F.broadcast(hot), "anchor", "left_semi").withColumn("many", F.lit(True))
    return cold.withColumn("many", low.over(both) < high.over(both)).unionByName(common)


def seed_windows(docs: DataFrame, firsts: DataFrame, window: int = WINDOW) -> DataFrame:
    """anchor, words, row name and start of every window of the given seeds; reads the texts again."""
    per_row = firsts.groupBy(*ROW).agg(F.collect_list(F.struct("anchor", "first", "last")).alias("_seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = []
                lists = part.column("_seeds")
                values, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
                key, first, last = (pa.compute.struct_field(values, i).to_numpy() for i in range(3))
                for i, text in enumerate(part.column("text").to_pylist()):
                    windows = gram_hashes(word_hashes(words_of(text)), window)
                    own = slice(ends[i - 1] if i else 0, ends[i])
                    sizes = last[own] - first[own] + 1
                    start = np.repeat(first[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    made.append((np.repeat(key[own], sizes), windows[start], np.full(len(start), i), start))
                key, words, row, start = (np.concatenate(c) for c in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key), pa.array(words.view(np.int64)), *(part.column(c).take(pa.array(row)) for c in ROW),
                        pa.array(start.astype(np.int32)),
                    ],
                    names=["anchor", "words", *ROW, "start"],
                )

    joined = docs.select(*ROW, "text").join(per_row, ROW).select(*ROW, "text", "_seeds")
    return joined.mapInArrow(run, "anchor long, words long, _doc long, _text long, _text2 long, start int")


def repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Stretches [begin, end) of words, by row name, that also start in an earlier document."""
    hot = materialize(common_anchors(docs, rows_per_salt, window, anchor))
    hot = None if hot.isEmpty() else hot
    judged = extended(seeds(docs, window, anchor), hot, rows_per_salt)
    kept = materialize(judged.where("later or many").select("anchor", *ROW, "first", "last", "later"))
    whole = kept.where("later").select(*ROW, F.col("first").alias("begin"), (F.col("last") + window).alias("end"))
    edges = seed_windows(docs, kept.where("not later"), window)
    again = with_first(edges, ["anchor", "words"], "start", hot, rows_per_salt).where("later")
    return whole.unionByName(again.select(*ROW, F.col("start").alias("begin"), (F.col("start") + window).alias("end")))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text."""
    docs = named_rows(docs.drop("n_words", "n_removed", "kept_text"))
    per_row = (
        repeats(docs, window, anchor, rows_per_salt)
        .groupBy(*ROW)
        .agg(F.collect_list(F.struct("begin", "end")).alias("_repeats"))
    )

    def compute(batch: pa.RecordBatch) -> list:
        n_words, n_removed, kept = [], [], []
        for text, stretches in zip(batch.column("text").to_pylist(), batch.column("_repeats").to_pylist(), strict=True):
            words = words_of(text)
            inside = repeated_inside(gram_hashes(word_hashes(words), window))
            begins = np.array([s["begin"] for s in stretches or ()], np.int64)
            ends = np.array([s["end"] for s in stretches or ()], np.int64)
            gone = covered(len(words), np.r_[begins, inside], np.r_[ends, inside + window])
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
        return [n_words, n_removed, kept]

    joined = docs.join(per_row, ROW, "left")
    return add_columns(
        joined, compute, "n_words long, n_removed long, kept_text string", drop=[*ROW, "_repeats"]
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op1_substring_dedup": f"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from documents
), starts as (
  select doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) as s from d where len(words) >= {WINDOW}
), windows as (
  select doc_id, s, array_to_string(words[s:s + {WINDOW - 1}], ' ') as w from starts
), later as (
  select doc_id, s, row_number() over (partition by w order by doc_id, s) > 1 as again from windows
), gone as (
  select distinct doc_id, s + k as i from later, range({WINDOW}) r(k) where again
), placed as (
  select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from d
)
select d.doc_id, len(d.words) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join (
  select p.doc_id, count(g.i) as n_removed, string_agg(word, ' ' order by p.i) filter (where g.i is null) as kept
  from placed p left join gone g on p.doc_id = g.doc_id and p.i = g.i group by p.doc_id
) k on d.doc_id = k.doc_id"""
}
