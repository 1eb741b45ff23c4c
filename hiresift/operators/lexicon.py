"""Finding the terms of a lexicon that is a table, of any size, in texts.

``how="words"`` finds terms as whole words, by the rule of ``functions.skills``; ``how="anywhere"``
finds them inside words too.  Terms are compared in lower case with the lower-cased text.

A lexicon whose measured size is under a limit is broadcast, and each task builds an
Aho-Corasick automaton of it once: one pass over a text finds all terms, however many there
are and however they overlap.  A larger lexicon stays where it is.  Whole words: the text is cut
into pieces (runs of word characters and single others), and its distinct runs of as many
pieces as a term may have are joined with the terms, but for those that a filter of the terms'
hashes, of bounded size, already rules out.  Anywhere: the distinct beginnings of
terms that occur in the text are joined with the terms, and what meets is looked for in the
text.  Both joins split hot keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions.text import WORD_CLASS
from hiresift.operators.joins import BROADCAST_LIMIT_BYTES, ROWS_PER_SALT, measured_bytes, salted_join
from hiresift.sources.tables import materialize

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_BITS = 1 << 25  # of the filter that runs of pieces pass before they are shuffled; 4 MB however many terms there are
PREFIX = 4  # characters of a term's beginning that texts and terms meet on
_PIECE = f"[{WORD_CLASS}]+|[^{WORD_CLASS}]"


def distinct_terms(lexicon: DataFrame, term: str = "term") -> DataFrame:
    """``term`` in lower case, once each; null and empty ones name nothing."""
    return lexicon.select(F.lower(F.col(term)).alias("term")).where("term <> ''").distinct()


def find_terms(
    texts: DataFrame, lexicon: DataFrame, key: str, text: str, how: str = "words", strict: bool = True,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES, rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``(key, term)``, once for each term that occurs in the text of a key (unique; a null text has none)."""
    if how not in ("words", "anywhere"):
        raise ValueError(how)
    terms = distinct_terms(lexicon)
    low = texts.select(F.col(key), F.lower(F.col(text)).alias("_text")).where("_text is not null")
    if broadcast_limit > 0 and measured_bytes(terms) <= broadcast_limit:
        return _scanned(low, terms, key, how, strict)
    if how == "words":
        return _joined_words(low, terms, key, strict, rows_per_salt)
    return _joined_anywhere(low, terms, key, rows_per_salt)


# --- a lexicon that fits ---------------------------------------------------------------------
def _scanned(texts: DataFrame, terms: DataFrame, key: str, how: str, strict: bool) -> DataFrame:
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(sorted(r["term"] for r in terms.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import regex

        word = regex.compile(r"[\p{L}\p{N}_]").match
        automaton = ahocorasick.Automaton()
        for t in sent.value:
            automaton.add_word(t, t)
        if sent.value:
            automaton.make_automaton()

        def whole(text: str, end: int, term: str) -> bool:
            begin = end + 1 - len(term)
            if begin and word(text[begin - 1]):
                return False
            followed = end + 1 < len(text) and word(text[end + 1]) is not None
            return followed == (strict and not word(term[-1]))

        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                if sent.value:
                    hits = {t for end, t in automaton.iter(text) if how == "anywhere" or whole(text, end, t)}
                    at += [i] * len(hits)
                    found += hits
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=[key, "term"]
            )

    return texts.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, term string")


# --- one that doesn't ------------------------------------------------------------------------
def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def _hash_bits(terms: DataFrame) -> bytes:
    """A bit for each CRC-32 (lowest bits) that a term has: 16 bits a term, up to ``MOST_BITS`` in all."""
    size = min(max(1 << (16 * terms.count()).bit_length(), 64), MOST_BITS)
    slot = F.crc32("term").bitwiseAND(F.lit(size - 1))
    words = terms.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b")).toArrow()
    bits = np.zeros(size // 64, "<i8")
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    return bits.tobytes()


def _joined_words(texts: DataFrame, terms: DataFrame, key: str, strict: bool, rows_per_salt: int) -> DataFrame:
    sizes = sorted(r[0] for r in terms.select(F.size(_pieces(F.col("term"))).alias("n")).distinct().collect())
    if not sizes:
        return texts.select(key, F.lit("").alias("term")).limit(0)
    sent = texts.sparkSession.sparkContext.broadcast(_hash_bits(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct runs, of those that pass the filter, that begin at a word's border and end at one; an ending symbol decides what must follow."""
        import regex

        pieces, word = regex.compile(_PIECE).findall, regex.compile(f"[{WORD_CLASS}]").match
        bits, most = sent.value, 8 * len(sent.value) - 1
        begins = {}  # whether a character is one of words

        def runs(text: str) -> list[str]:
            cut = pieces(text)
            for c in {p[0] for p in cut} - begins.keys():
                begins[c] = word(c) is not None
            words = [begins[p[0]] for p in cut]
            words.append(False)  # nothing follows the last piece
            found = set()
            for n in sizes:
                for i in range(len(cut) - n + 1):
                    if i and words[i - 1]:
                        continue
                    if words[i + n] == (strict and not words[i + n - 1]):
                        found.add("".join(cut[i : i + n]))
            hashed = ((r, crc32(r.encode()) & most) for r in found)
            return [r for r, h in hashed if bits[h >> 3] >> (h & 7) & 1]

        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                batch = whole.slice(begin, 64)
                at, found = [], []
                for i, text in enumerate(batch.column("_text").to_pylist()):
                    own = runs(text)
                    at += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=[key, "term"]
                )

    spread = materialize(texts.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, term string"))  # the join reads it twice
    return salted_join(spread, terms, "term", key, rows_per_salt=rows_per_salt).select(key, "term")


def _joined_anywhere(texts: DataFrame, terms: DataFrame, key: str, rows_per_salt: int) -> DataFrame:
    prefixed = terms.select("term", F.left("term", F.lit(PREFIX)).alias("prefix"))
    sizes = sorted(r[0] for r in prefixed.select(F.char_length("prefix")).distinct().collect())
    if not sizes:
        return texts.select(key, F.lit("").alias("term")).limit(0)
    grouped = prefixed.groupBy("prefix").agg(F.collect_list("term").alias("terms"))
    begins = ", ".join(f"transform(sequence(1, greatest(char_length(_text) - {n - 1}, 1)), i -> substring(_text, i, {n}))" for n in sizes)
    spread = texts.select(key, F.explode(F.expr(f"array_distinct(concat({begins}))")).alias("prefix"))
    met = salted_join(spread, grouped, "prefix", key, rows_per_salt=rows_per_salt).select(key, F.explode("terms").alias("term"))
    return met.join(texts, key).where(F.contains("_text", "term")).select(key, "term")


def terms_in_order(found: DataFrame, lexicon: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, terms)``: the found terms of each key as a list, by column ``order`` of the lexicon (one row a term)."""
    places = lexicon.select(F.lower("term").alias("term"), F.col(order).alias("_order"), F.col("term").alias("_as_given"))
    placed = salted_join(found, places, "term", key)
    listed = F.sort_array(F.collect_list(F.struct("_order", "_as_given")))
    return placed.groupBy(key).agg(listed.alias("_l")).select(key, F.col("_l._as_given").alias("terms"))
