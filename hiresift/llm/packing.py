"""Harmonic packing of tokenized documents into sequences.

Class ``j`` holds pieces longer than ``capacity // (j + 1)`` and at most ``capacity // j``;
a bin of class ``j`` is closed when it has ``j`` pieces, so no bin is ever searched and
every worker fills its bins by itself, from one pass over its documents and without a
shuffle.  A document gives full sequences first; what is left goes to its class if it fills
its share to within 1/64, else a piece of exactly the next smaller class is cut off, and so on
with the rest.  At the end of a worker's documents, at most one open bin per class is left;
their pieces are laid end to end and cut at the capacity, and the last, short sequence is cut
into lengths that are powers of two, which need no padding.

A worker keeps one open bin per class, under 2 MB at a capacity of 4,096.  The result is a
function of each input partition, so a task that runs again gives the same sequences.

Defined cases: a null or empty text is the end token alone.  Rows with one doc_id are packed
one by one.  A null doc_id is carried along.  An empty table gives no sequences.  Of the
input, only doc_id and the text are read, so clashing names of other columns don't matter.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm.bpe import BEYOND_LATIN, CACHED, DIGITS, LETTERS, SPACES, byte_characters
from hiresift.llm.common import add_columns, release_memory, slices, worker_cache

CAPACITY = 4096
END = 2
SLACK = 64  # a piece may leave 1/SLACK of its share empty
# Fixed value: the public pattern of the word tokenizer, for texts of Latin-1 characters.
LATIN_PIECES = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+"
LATIN_CUT = re.compile(LATIN_PIECES)


class WordTokenizer:
    """Ids of the tokenizers library, with every distinct piece of text encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.normalizer, self.model = self.tokenizer.normalizer, self.tokenizer.model
        self.cutter, self.chars = self.tokenizer.pre_tokenizer, byte_characters()
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if BEYOND_LATIN.search(text):  # by the library, whose Unicode version decides what a letter is
            text = self.normalizer.normalize_str(text)
            return [text[begin:end] for _, (begin, end) in self.cutter.pre_tokenize_str(text)]
        return LATIN_CUT.findall(text.lower())  # composed already

    def encode(self, piece: str) -> bytes:
        if piece in self.special:
            return np.array([self.special[piece]], "<u4").tobytes()
        written = piece if piece.isascii() and piece.isprintable() else "".join([self.chars[b] for b in piece.encode()])
        return np.array([t.id for t in self.model.tokenize(written)], "<u4").tobytes()

    def encode_texts(self, texts: Iterable[str | None]) -> list[bytes]:
        cut = []
        for text in texts:
            found: list[str] = []
            for part in self.split.split(text or "") if self.special else [text or ""]:
                if part in self.special:
                    found.append(part)
                elif part:
                    found += self.pieces(part)
            cut.append(found)
        if len(self.cache) > CACHED:
            self.cache.clear()
        cache = self.cache
        cache.update((p, self.encode(p)) for p in set(itertools.chain.from_iterable(cut)) - cache.keys())
        return [b"".join([cache[p] for p in found]) for found in cut]


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer a worker, with the pieces it has seen, for all tasks."""
    return worker_cache(f"word tokenizer {path}", lambda: WordTokenizer(path))


def tokenize_documents(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id and the ids of the text with the end token, as little-endian unsigned 32-bit integers."""
    last = np.array([end], "<u4").tobytes()

    def compute(batch: pa.RecordBatch) -> list:
        return [[ids + last for ids in tokenizer_of(path).encode_texts(batch.column("text").to_pylist())]]

    return add_columns(docs.select("doc_id", "text"), compute, "ids binary", drop=["text"])


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, in order."""
    made = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n:
        j = capacity // n
        share = capacity // j
        if share - n <= share // SLACK:
            made.append((n, j))
            break
        smaller = capacity // (j + 1)
        made.append((smaller, j + 1))
        n -= smaller
    return made


class Packer:
    """The bins of one worker."""

    def __init__(self, capacity: int = CAPACITY, first_sequence: int = 0):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        total = sum(len(p[2]) // 4 for p in pieces)
        padded = total if total & (total - 1) == 0 else self.capacity
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            size = len(ids) // 4
            yield doc_id, start, size, ids, doc_tokens, self.next, at, padded
            at += size
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        """Place a document; gives the rows of all bins that this closes."""
        n, at = len(ids) // 4, 0
        for size, j in cut_lengths(n, self.capacity):
            bin_ = self.open.setdefault(j, [])
            bin_.append((doc_id, at, ids[4 * at : 4 * (at + size)], n))
            at += size
            if len(bin_) == j:
                yield from self._sequence(self.open.pop(j))

    def finish(self) -> Iterator[tuple]:
        """The open bins: end to end, cut at the capacity, the rest at powers of two."""
        left = [p for _, pieces in sorted(self.open.items()) for p in pieces]
        self.open = {}
        total = sum(len(p[2]) // 4 for p in left)
        room = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        room += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        piece, taken = 0, 0
        for size in room:
            here = []
            while size:
                doc_id, start, ids, n = left[piece]
                part = min(size, len(ids) // 4 - taken)
                here.append((doc_id, start + taken, ids[4 * taken : 4 * (taken + part)], n))
                size, taken = size - part, taken + part
                if taken == len(ids) // 4:
                    piece, taken = piece + 1, 0
            yield from self._sequence(here)


PIECE_COLUMNS = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"
)


def _packed(rows: DataFrame, ids_of: Callable[[pa.RecordBatch], Iterable[tuple]], capacity: int) -> DataFrame:
    """Pieces of the (doc_id, ids) that ``ids_of`` makes of each batch, with their places in sequences."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"]
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        id_kind = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [id_kind, *kinds], strict=True)], names=names
            )

        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            rows = []
            for doc_id, ids in ids_of(batch):
                rows += packer.add(doc_id, ids)
                if len(rows) > 2000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)
        rows = list(packer.finish())
        if rows:
            yield made(rows)
        release_memory()

    return rows.mapInArrow(run, f"doc_id {kind}, {PIECE_COLUMNS}")


def pack(tokenized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``tokenized`` (doc_id, ids) with their places in sequences."""

    def ids_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        return ((d, ids.as_py() or b"") for d, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True))

    return _packed(tokenized.select("doc_id", "ids"), ids_of, capacity)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``pack`` of ``tokenize_documents``, in one worker a task."""
    last = np.array([end], "<u4").tobytes()

    def ids_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for part in slices(batch, "text"):
            ids = tokenizer_of(path).encode_texts(part.column("text").to_pylist())
            yield from zip(part.column("doc_id").to_pylist(), (i + last for i in ids), strict=True)

    return _packed(docs.select("doc_id", "text"), ids_of, capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length"
    )
