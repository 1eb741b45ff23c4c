"""Byte-level BPE over a rank file by monoid tree reduction, and decoding up the same tree.

The encodings of byte strings form a monoid under ``join``: the encoding of a concatenation
follows from those of its parts.  A piece (one match of the pattern) is halved down to leaves
of a few bytes; leaves are merged rank by rank, and neighbours are joined on the way up.  A
join encodes again a window of the last tokens of the left and the first tokens of the right
part, and doubles it on a side whose outermost token changed.

Why an unchanged outermost token is enough: merges of a string that never cross a boundary
are an interleaving, by rank and place, of the merges of the two sides, so each side looks as
if it were alone.  A first merge across a boundary involves only the two tokens beside it and
would also happen in the concatenation of those two alone.  Hence a token sequence is the
encoding of its bytes if every two neighbours are, and neighbours within one encoding are.  In
the joined sequence all neighbours lie within the left part, the window or the right part,
except the pairs at the window's ends; with an unchanged outermost token, these are pairs of
the left or right part as well.

A piece that is a token as a whole is that token, as in the tiktoken library.  Text and pieces
are concatenated without joining, because merges never cross a match of the pattern.  Decoding
concatenates the tokens' bytes pairwise up a tree of halves.

Defined cases: a null text is encoded as an empty one: no ids, and decodes to no bytes.  Equal
texts give equal results, whatever their doc_id, which is only carried along; an empty table
gives an empty one.  Extra columns stay, and those with a result's name are replaced.  Very
long texts are cut and encoded in runs of pieces, and a very long piece takes O(n log^2 n).
Ids outside the file decode to nothing, null ids to null.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm.bpe import PIECES, cut_pieces
from hiresift.llm.common import add_columns, worker_cache

LEAF = 8
SCANNED = 64  # windows of at most so many bytes are merged by scanning, longer ones with a heap
CACHED, CACHED_LENGTH = 400_000, 64  # pieces kept in either half, and the most characters of one
SHARED, SHARED_LENGTH = 200_000, 12  # the same for parts and windows, as many pieces share them, and bytes
LONG_TEXT, RUN = 1 << 20, 100_000
NONE = 1 << 62


class _Recent(dict):
    """What ``make`` gives for the keys met lately, in two halves; ``limits`` gives a half's size and a key's length.

    A full half becomes the older one, and what is met again there comes back: only keys that are
    not met while a half fills are made anew.
    """

    def __init__(self, make: Callable, limits: Callable[[], tuple[int, int]]):
        self.make, self.limits, self.older = make, limits, {}

    def __missing__(self, key: str | bytes) -> bytes | list[bytes]:
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        half, length = self.limits()
        if len(key) <= length:
            if len(self) >= half:
                self.older = self.copy()
                self.clear()
            self[key] = made
        return made


class TreeBpe:
    """The codec of one rank file (base64 of a token's bytes, its rank) and one pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.cut = cut_pieces if pattern == PIECES else self.pattern.findall
        self.cache = _Recent(lambda piece: self.piece_ids(piece.encode()), lambda: (CACHED, CACHED_LENGTH))
        self.shared = _Recent(self._merged_by_scan, lambda: (SHARED, SHARED_LENGTH))

    # --- merges of a leaf or a window -----------------------------------------------------
    def merged(self, raw: bytes) -> list[bytes]:
        if len(raw) <= SHARED_LENGTH:
            return self.shared[raw]
        return self._merged_by_scan(raw) if len(raw) <= SCANNED else self._merged_by_heap(raw)

    def _merged_by_scan(self, raw: bytes) -> list[bytes]:
        rank, tokens = self.ranks.get, self.tokens  # the tokens' own objects, as parts are kept
        parts = [raw[i : i + 1] for i in range(len(raw))]
        found = [rank(raw[i : i + 2], NONE) for i in range(len(raw) - 1)]
        while found:
            lowest = min(found)
            if lowest == NONE:
                break
            at = found.index(lowest)
            parts[at] = new = tokens[lowest]
            del parts[at + 1], found[at]
            if at < len(found):
                found[at] = rank(new + parts[at + 1], NONE)
            if at:
                found[at - 1] = rank(parts[at - 1] + new, NONE)
        return parts

    def _merged_by_heap(self, raw: bytes) -> list[bytes]:
        rank, n = self.ranks.get, len(raw)
        end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # the part that begins at i is raw[i:end[i]]
        current = [rank(raw[i : i + 2], NONE) for i in range(n - 1)] + [NONE]
        heap = [(r, i) for i, r in enumerate(current) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, at = heapq.heappop(heap)
            if current[at] != r:
                continue
            gone = end[at]
            current[gone] = NONE
            end[at] = following = end[gone]
            if following < n:
                before[following] = at
            for begin in (before[at], at):
                if begin >= 0:
                    middle = end[begin]
                    r = rank(raw[begin : end[middle]], NONE) if middle < n else NONE
                    current[begin] = r
                    if r != NONE:
                        heapq.heappush(heap, (r, begin))
        parts, at = [], 0
        while at < n:
            parts.append(raw[at : end[at]])
            at = end[at]
        return parts

    # --- the tree -------------------------------------------------------------------------
    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two neighbours, from a window that grows until its ends are stable."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            window = self.merged(b"".join(left[-a:]) + b"".join(right[:b]))
            left_stable = a >= len(left) or window[0] == left[-a]
            right_stable = b >= len(right) or window[-1] == right[b - 1]
            if left_stable and right_stable:
                return left[:-a] + window + right[b:]
            if not left_stable:
                a *= 2
            if not right_stable:
                b *= 2

    def reduced(self, raw: bytes) -> list[bytes]:
        """Tokens of a piece by the rank-wise merges, joined up the tree of its halves."""
        if len(raw) <= LEAF:
            return self.merged(raw)
        half = 1 << (len(raw) - 1).bit_length() - 1  # a power of two, so that periodic pieces fall alike into both parts
        return self.join(self.reduced(raw[:half]), self.reduced(raw[half:]))

    def piece_ids(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)
        ids = [self.ranks[t] for t in self.reduced(piece)] if whole is None else [whole]
        return struct.pack(f"<{len(ids)}I", *ids)

    # --- texts ----------------------------------------------------------------------------
    def _runs(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.cut(text)
            return
        pieces = (m.group() for m in self.pattern.finditer(text))
        while run := [*itertools.islice(pieces, RUN)]:
            yield run

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        cache = self.cache
        return b"".join([b"".join([cache[p] for p in run]) for run in self._runs(text or "")])

    def encode_texts(self, texts: Iterable[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids' tokens, concatenated up a tree of halves."""
        return self._concatenated(np.frombuffer(ids, "<u4"))

    def _concatenated(self, ids: np.ndarray) -> bytes:
        if len(ids) <= RUN:
            tokens, n = self.tokens, len(self.tokens)
            return b"".join([tokens[i] for i in ids.tolist() if i < n])
        half = len(ids) // 2
        return self._concatenated(ids[:half]) + self._concatenated(ids[half:])


def codec_of(path: str, pattern: str) -> TreeBpe:
    """One codec a worker, with the pieces it has seen, for all tasks."""
    return worker_cache(f"tree codec {path} {pattern}", lambda: TreeBpe(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the text's ids as little-endian unsigned 32-bit integers."""

    def compute(batch: pa.RecordBatch) -> list:
        return [codec_of(path, pattern).encode_texts(batch.column(text).to_pylist())]

    return add_columns(docs, compute, "ids binary", sized_by=text)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids``."""

    def compute(batch: pa.RecordBatch) -> list:
        codec = codec_of(path, pattern)
        return [[None if b is None else codec.decode(b) for b in batch.column("ids").to_pylist()]]

    return add_columns(encoded, compute, "decoded binary", sized_by="ids")


def round_trip_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and what they decode to, ``decoded``: a worker does both, so half as many hold a codec."""

    def compute(batch: pa.RecordBatch) -> list:
        codec = codec_of(path, pattern)
        ids = codec.encode_texts(batch.column(text).to_pylist())
        return [ids, [codec.decode(b) for b in ids]]

    return add_columns(docs, compute, "ids binary, decoded binary", sized_by=text)


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip_documents(docs, path, pattern).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
