"""Reading order of pages whose text may stand in two columns.

One row is one document: ``pages ARRAY<STRUCT<height, words ARRAY<STRUCT<text, x0,
x1, top>>>>>``.  Spark stacks the pages and sorts the words inside the row.  Grouping
words into lines and lines into column blocks looks back at where the current line
or block began, which no window frame expresses; that part runs over Arrow batches
of rows (``mapInArrow``), so documents spread with the scan and nothing is shuffled.

``lines_of_words`` does the same for a table with one row a word: the words are sorted within
their document by a shuffle, and the same folds stream past them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hiresift.functions.fixed_values import COLUMN_GAP, LINE_TOLERANCE
from hiresift.functions.text import is_blank
from hiresift.operators.joins import salted_join

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 4096  # of a stream that are plain Python values at once

# Words of all pages on one continuous sheet, by height, then from left to right.
# The height of the pages before is summed once per page.
_SORTED_WORDS = """sort_array(flatten(transform(coalesce(pages, array()), (page, p) -> transform(
  array(aggregate(slice(pages, 1, p), 0D, (acc, before) -> acc + coalesce(before.height, 0D))),
  above -> transform(coalesce(page.words, array()), (w, i) -> struct(
    w.top + above as y, w.x0 as x0, p as page_no, i as word_no, w.x1 as x1, w.text as text)))[0])))"""

Word = tuple[float, float, float, str]  # y, x0, x1, text


def _unplaced(word: Column) -> Column:
    """Whether a word lacks its text or a part of its place; then the whole document can't be laid out."""
    return word["y"].isNull() | word["x0"].isNull() | word["x1"].isNull() | word["text"].isNull()


def _lines(words: list[Word]) -> Iterator[list[Word]]:
    """Words in lines, top to bottom; a line reaches a tolerance below its first word."""
    line: list[Word] = []
    for word in words:
        if line and word[0] - line[0][0] > LINE_TOLERANCE:
            yield sorted(line, key=lambda w: w[1])
            line = []
        line.append(word)
    if line:
        yield sorted(line, key=lambda w: w[1])


def _text(words: Iterable[Word]) -> str:
    return " ".join(w[3] for w in words)


def _in_order(lines: Iterable[list[Word]]) -> Iterator[str]:
    """Lines of text; those of a two-column block left column first."""
    left: list[str] = []
    right: list[str] = []
    middle = None
    for line in lines:
        gaps = [b[1] - a[2] for a, b in zip(line, line[1:])]
        cut = gaps.index(max(gaps)) if gaps else None
        if cut is not None and gaps[cut] > COLUMN_GAP:
            middle = (line[cut][2] + line[cut + 1][1]) / 2
            left.append(_text(line[: cut + 1]))
            right.append(_text(line[cut + 1 :]))
        elif middle is not None and line[-1][1] < middle:
            left.append(_text(line))
        elif middle is not None and line[0][1] > middle:
            right.append(_text(line))
        else:
            yield from left
            yield from right
            left, right, middle = [], [], None
            yield _text(line)
    yield from left
    yield from right


def _laid_out(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``text``; NULL for a document whose words can't be placed, without harm to others."""

    def one(words: tuple) -> str | None:
        return None if words[0] is None else "\n".join(_in_order(_lines(list(zip(*words)))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("y", "x0", "x1", "word")]
            texts = [one(words) for words in zip(*columns)]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    words = documents.select(*keep, F.expr(_SORTED_WORDS).alias("words")).select(
        *keep, F.when(~F.exists("words", _unplaced), F.col("words")).alias("words")
    )
    fields = {"y": "y", "x0": "x0", "x1": "x1", "text": "word"}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)
    return words.select(*keep, *[F.col(f"words.{c}").alias(n) for c, n in fields.items()]).mapInArrow(
        read, f"{schema}, text string"
    )


def _sheet(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Words with ``y``, their height on one continuous sheet, and ``lost``: without text or place."""
    earlier = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    heights = pages.groupBy("doc_id", "page_no").agg(F.max("height").alias("height"))
    above = heights.select("doc_id", "page_no", F.coalesce(F.sum("height").over(earlier), F.lit(0.0)).alias("above"))
    place = F.struct("doc_id", "page_no", "word_no")
    placed = salted_join(words, above, ["doc_id", "page_no"], place, "left").withColumn("y", F.col("top") + F.col("above"))
    return placed.withColumn("lost", F.col("y").isNull() | F.col("x0").isNull() | F.col("x1").isNull() | F.col("text").isNull())


def lines_of_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``(doc_id, line_no, text)`` in reading order from one row a word.

    ``words(doc_id, page_no, word_no, text, x0, x1, top)``, ``pages(doc_id, page_no, height)``.
    The words of a document are sorted by their place and streamed past: a task holds one line
    and the lines of one block, however long the document is.  A document with a word that has
    no text or place gives one line with a NULL text.
    """
    kind = dict(words.dtypes)["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                yield from zip(*(part.column(c).to_pylist() for c in ("doc_id", "lost", "y", "x0", "x1", "text")), strict=True)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc_id, of_one in groupby(rows(batches), key=lambda r: r[0]):
            first = next(of_one)
            if first[1]:  # lost words come first
                yield doc_id, 0, None
                continue
            for line_no, text in enumerate(_in_order(_lines(r[2:] for r in chain([first], of_one)))):
                yield doc_id, line_no, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lines(batches)
        while some := [*islice(made, ROWS)]:
            columns = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (id_kind, pa.int64(), pa.string()), strict=True)], ["doc_id", "line_no", "text"])

    id_kind = to_arrow_type(words.schema["doc_id"].dataType)
    sheet = _sheet(words, pages).select("doc_id", "lost", "y", "x0", "x1", "text", "page_no", "word_no")
    ordered = sheet.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("lost"), "y", "x0", "page_no", "word_no")
    return ordered.mapInArrow(run, f"doc_id {kind}, line_no bigint, text string")


def texts_of_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``(doc_id, text)``: like ``reading_order``, from one row a word; '' for a document that only has pages."""
    line = F.struct("line_no", "text")
    found = lines_of_words(words, pages).groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("_l"), F.count_if(F.col("text").isNull()).alias("_lost"))
    texts = found.select("doc_id", F.when(F.col("_lost") == 0, F.array_join("_l.text", "\n")).alias("_text"), F.lit(True).alias("_found"))
    every = pages.select("doc_id").union(words.select("doc_id")).distinct()
    return every.join(texts, "doc_id", "left").select("doc_id", F.when(F.col("_found"), F.col("_text")).otherwise("").alias("text"))


def reading_order(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` in reading order from ``(doc_id, pages)``; '' without words, NULL if unreadable."""
    return _laid_out(documents, ["doc_id"])


def extract_texts(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, pages, plain_text)``: by layout, else the plain text, else ''."""
    found = _laid_out(documents, ["doc_id", "plain_text"])
    return found.select("doc_id", text_or_fallback(F.col("text"), F.col("plain_text")).alias("text"))


def text_or_fallback(layout_text: Column, plain_text: Column) -> Column:
    """The text found by layout unless blank, else the plain one, else ''."""
    found = F.when(~is_blank(layout_text), layout_text)
    return F.coalesce(found, plain_text, F.lit(""))
