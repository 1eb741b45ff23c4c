"""Language identification by prediction by partial matching.

For every language a context tree over bytes of order 0 to ``ORDER`` is learned and frozen.
A byte is coded in the longest context that the tree has; a byte not seen there costs an
escape and goes on in the next shorter context, without the bytes already ruled out, down
to equal shares of what is left.  The escape probability is distinct / (total + distinct).
A document's code length under each language is exact, and the shortest wins.

As the statistics are frozen, the code length of a byte depends on itself and ``ORDER``
bytes before it only.  Each worker tabulates it once: rows for the contexts in the trees and,
for all others, rows for shorter contexts; scoring a batch is then two table lookups per byte
for all languages together.

Learning reads the counts of byte 4-grams of a sample of labelled documents: at most about
``SAMPLE_BYTES`` bytes of text per language, in stretches of ``STRETCH`` bytes drawn by a hash of
the id and the stretch's number (the same ones at every run), so that a few very long documents
neither exceed the bound nor leave out the others.  Only these counts, whose number the sample bounds, come to the driver.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is
everything if nothing can be learned.  A null doc_id is neither held out nor learned from.
Ties go to the language first in the alphabet.  Repeated rows get equal results; extra
columns stay, those with a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm.common import add_columns, mix, slices, worker_cache
from hiresift.operators.joins import lookup_join

ORDER = 3
SAMPLE_BYTES = 4_000_000
HELD_OUT = 2  # of crc32(doc_id) mod 4
UNKNOWN = "und"
START = b"\n" * ORDER  # what stands before a document
SLICE = 1 << 20
STRETCH = 4096
SCORED = 1 << 18
SHARES = 1_000_000
PART = 1024


# --- counting -----------------------------------------------------------------------------
def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The gram (three bytes before, and the byte) at every byte of the texts; where each text begins."""
    return _grams_of([START + (t or "").encode() for t in texts])


def _grams_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes that each have the ``ORDER`` bytes before them in front."""
    sizes = np.array([len(p) - ORDER for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    if not len(raw):
        return np.zeros(0, np.uint32), sizes
    gram = raw.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= raw[:-k] << np.uint32(8 * k)
    own = np.ones(len(raw), bool)
    begins = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    for k in range(ORDER):
        own[begins + k] = False
    return gram[own], sizes


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def drawn_stretches(text: str, seed: int, share: float) -> list[bytes]:
    """The stretches of a text that are learned from, each with the bytes before it."""
    data = START + text.encode()
    number = np.arange(-(-(len(data) - ORDER) // STRETCH)).astype(np.uint64)
    drawn = mix(number * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 64))) % np.uint64(SHARES) < share * SHARES
    return [data[k * STRETCH : (k + 1) * STRETCH + ORDER] for k in np.flatnonzero(drawn).tolist()]


def gram_counts(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, gram, n) over the learning sample; counted per batch before the shuffle."""
    learn = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    per_lang = learn.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    share = per_lang.select("lang", F.least(F.lit(1.0), sample_bytes / F.greatest("bytes", F.lit(1))).alias("share"))
    drawn = lookup_join(learn, share, "lang", "doc_id").withColumn("seed", F.xxhash64(F.lit("language"), "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                pieces: dict[str, list[bytes]] = {}
                for lang, *row in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "seed", "share")), strict=True):
                    pieces.setdefault(lang, []).extend(drawn_stretches(*row))
                for lang in sorted(x for x in pieces if pieces[x]):
                    gram, _ = _grams_of(pieces[lang])
                    grams, n = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    counted = drawn.select("lang", "text", "seed", "share").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# --- the model ----------------------------------------------------------------------------
@dataclass
class Frozen:
    """Statistics of all languages: for each the grams seen and how often."""

    langs: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]

    def key(self) -> str:
        return hashlib.sha256(pickle.dumps((self.langs, self.grams, self.counts))).hexdigest()


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Frozen:
    rows = gram_counts(docs, sample_bytes).toPandas().sort_values(["lang", "gram"])
    langs = sorted(rows["lang"].unique())
    of = [rows[rows["lang"] == lang] for lang in langs]
    return Frozen(langs, [x["gram"].to_numpy(np.int64) for x in of], [x["n"].to_numpy(np.int64) for x in of])


def code_lengths(counts: list[np.ndarray], unseen: int) -> np.ndarray:
    """Bits of every symbol in each context, from its rows of counts, longest context first.

    The last column is one byte that was never seen; ``unseen`` such bytes exist.
    """
    p = np.zeros(counts[0].shape)
    escape = np.ones((len(p), 1))
    out = np.zeros(p.shape, bool)
    for row in counts:
        left = np.where(out, 0, row)
        total, distinct = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True)
        whole = np.maximum(total + distinct, 1)
        p = np.where(left > 0, escape * left / whole, p)
        escape = np.where(total > 0, escape * distinct / whole, escape)
        out |= left > 0
    rest = (~out[:, :-1]).sum(axis=1, keepdims=True) + unseen
    return -np.log2(np.where(out, p, escape / np.maximum(rest, 1)))


class Tables:
    """Code lengths of all languages by context and byte."""

    def __init__(self, frozen: Frozen):
        every = np.unique(np.concatenate(frozen.grams))
        seen = np.unique(np.concatenate([every >> s & 255 for s in (0, 8, 16, 24)]))
        a = len(seen) + 1  # the last symbol is any other byte
        self.symbol = np.full(256, a - 1, np.int32)
        self.symbol[seen] = np.arange(a - 1)
        self.a = a
        contexts = np.unique(self._context(every))
        self.row = np.zeros(a**3, np.int32)
        self.row[contexts] = np.arange(1, len(contexts) + 1)
        langs = len(frozen.langs)
        self.long = np.zeros((len(contexts) + 1, a, langs), np.float32)
        self.short = np.zeros((a * a, a, langs), np.float32)
        for i, (grams, n) in enumerate(zip(frozen.grams, frozen.counts, strict=True)):
            last = self.symbol[grams & 255]
            two = self.symbol[grams >> 16 & 255] * a + self.symbol[grams >> 8 & 255]
            one = self.symbol[grams >> 8 & 255]
            c3, c2, c1, c0 = (np.zeros((m, a), np.int32) for m in (len(contexts) + 1, a * a, a, 1))
            for table, at in ((c3, self.row[self._context(grams)]), (c2, two), (c1, one), (c0, 0)):
                np.add.at(table, (at, last), n.astype(np.int32))
            unseen = 256 - len(seen)
            for begin in range(0, a * a, PART):  # in parts, as a worker shares its memory
                pair = np.arange(begin, min(begin + PART, a * a))
                self.short[pair, :, i] = code_lengths([c2[pair], c1[pair % a], c0[0 * pair]], unseen)
            for begin in range(0, len(contexts), PART):
                row = np.arange(begin, min(begin + PART, len(contexts)))
                inner = contexts[row] % (a * a)
                counts = [c3[1 + row], c2[inner], c1[inner % a], c0[0 * row]]
                self.long[1 + row, :, i] = code_lengths(counts, unseen)

    def _context(self, grams: np.ndarray) -> np.ndarray:
        s, a = self.symbol, self.a
        return (s[grams >> 24 & 255].astype(np.int64) * a + s[grams >> 16 & 255]) * a + s[grams >> 8 & 255]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """(bytes, languages): the code length of every byte."""
        context, last = self._context(grams), self.symbol[grams & 255]
        row = self.row[context]
        out = self.long[row, last]
        other = np.flatnonzero(row == 0)
        out[other] = self.short[context[other] % (self.a * self.a), last[other]]
        return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def total_bits(tables: Tables, texts: list[str | None]) -> np.ndarray:
    """(texts, languages): code lengths of the texts, read in runs of about ``SCORED`` bytes."""
    out = np.zeros((len(texts), tables.long.shape[2]))
    pieces: list[bytes] = []
    owners: list[int] = []
    size = 0

    def score() -> None:
        grams, sizes = _grams_of(pieces)
        begins = np.cumsum(sizes) - sizes
        np.add.at(out, owners, np.add.reduceat(tables.bits(grams), begins, axis=0, dtype=np.float64))

    for i, text in enumerate(texts):
        data = START + (text or "").encode()
        for begin in range(0, len(data) - ORDER, SCORED):
            pieces.append(data[begin : begin + SCORED + ORDER])
            owners.append(i)
            size += len(pieces[-1])
            if size >= SCORED:
                score()
                pieces, owners, size = [], [], 0
    if pieces:
        score()
    return out


def identify(docs: DataFrame, frozen: Frozen) -> DataFrame:
    """``docs`` with lang_pred, score (its share of the languages' likelihoods) and bits_per_byte; no shuffle."""
    key = frozen.key()

    def compute(batch: pa.RecordBatch) -> list:
        texts = batch.column("text").to_pylist()
        if not frozen.langs:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)]
        tables = worker_cache(key, lambda: Tables(frozen))
        bits = total_bits(tables, texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        letters = [has_letter(t) for t in texts]
        return [
            [frozen.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)],
            np.where(letters, score, 0.0),
            [x / len(t.encode()) if t else None for x, t in zip(least.tolist(), texts, strict=True)],
        ]

    return add_columns(docs, compute, "lang_pred string, score double, bits_per_byte double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frozen = learn(docs)
    judged = identify(docs.select("doc_id", "text"), frozen)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
