"""Byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

A text is cut into pieces by the tokenizer's own pattern; a piece is encoded by itself.
Leaf ``i`` of a piece's segment tree holds ``rank * size + i`` for the pair that begins at
symbol ``i`` (infinity if it can't merge), so the root's minimum is the lowest rank and,
among equals, the leftmost pair.  A merge changes three leaves, each with a walk to the
root, until the root is infinite.  Many short pieces are encoded together: their trees are
the rows of one numpy array.  A long piece has a tree of its own in plain lists.  Pieces
seen before in the task come from a bounded cache.

Defined cases: a null text is encoded as an empty one: no ids, and decodes to an empty text.
Special tokens in a text get their id, as the tokenizers library does by default.  Rows are
encoded one by one, so repeated rows give equal results; extra columns stay, and those with
a result's name are replaced.  Ids that are not in the vocabulary decode to nothing, null
ids to null, and bytes that are no valid UTF-8 to U+FFFD.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm.common import add_columns

CACHED = 400_000
SHORT = 64
INF = np.iinfo(np.int64).max
# The public pattern of byte-level pre-tokenizing.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# The same for texts of Latin-1 characters, whose classes can be written out; this runs several times faster.
LETTERS, DIGITS, SPACES = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
LATIN_PIECES = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
ANY_CUT, LATIN_CUT = regex.compile(PIECES), re.compile(LATIN_PIECES)
BEYOND_LATIN = re.compile("[^\\x00-\\xff]")


def cut_pieces(text: str) -> list[str]:
    return (ANY_CUT if BEYOND_LATIN.search(text) else LATIN_CUT).findall(text)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class ByteBpe:
    """A vocabulary file of the tokenizers library with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        chars = byte_characters()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in vocab.items()}
        tokens |= {i: t.encode() for t, i in self.special.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.first = np.array([vocab[c] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.by_key = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.first_ranks = self.rank_of(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, np.ndarray] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    # --- trees --------------------------------------------------------------------------
    def _encode_short(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of at most ``size`` bytes, a power of two; one row of the arrays each."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        column = np.arange(size)
        symbol = np.full((n, size + 2), -1, np.int64)  # the last columns take what points outside
        symbol[:, :size] = np.where(column < lengths[:, None], self.first[raw], -1)
        after = np.tile(np.append(column + 1, [size, size]), (n, 1))
        after[:, :size][column + 1 >= lengths[:, None]] = size
        before = np.tile(np.append(column - 1, [size + 1, size + 1]), (n, 1))
        before[:, 0] = size + 1
        tree = np.full((n, 2 * size), INF, np.int64)
        rank = self.first_ranks[raw[:, :-1], raw[:, 1:]]
        usable = (rank >= 0) & (column[1:] < lengths[:, None])
        tree[:, size : 2 * size - 1] = np.where(usable, rank * size + column[:-1], INF)
        level = size >> 1
        while level:
            below = tree[:, 2 * level : 4 * level]
            tree[:, level : 2 * level] = np.minimum(below[:, ::2], below[:, 1::2])
            level >>= 1
        rows = np.flatnonzero(tree[:, 1] != INF)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], size)
            gone = after[rows, at]
            new, following = self.merged[rank], after[rows, gone]
            symbol[rows, at], symbol[rows, gone] = new, -1
            after[rows, at] = following
            before[rows, following] = at
            leading = before[rows, at]
            self._set(tree, rows, size, gone, np.full(len(rows), -1))
            self._set(tree, rows, size, at, self.rank_of(new, symbol[rows, following]))  # -1 after the end
            inside = leading < size
            some, leading = rows[inside], leading[inside]
            self._set(tree, some, size, leading, self.rank_of(symbol[some, leading], new[inside]))
            rows = rows[tree[rows, 1] != INF]
        flat = symbol[:, :size]
        kept = flat >= 0
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        ids = flat[kept].astype("<u4").tobytes()
        return [ids[begin:end] for begin, end in zip([0, *ends], ends, strict=False)]

    def _set(self, tree: np.ndarray, rows: np.ndarray, size: int, leaf: np.ndarray, rank: np.ndarray) -> None:
        """Point update of one leaf in each row, with the minima above it."""
        node = leaf + size
        tree[rows, node] = np.where(rank >= 0, rank * size + leaf, INF)
        node = node >> 1
        for _ in range(size.bit_length() - 1):
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def _encode_long(self, piece: bytes) -> bytes:
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        symbol = self.first[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        none = 1 << 62
        tree = [none] * (2 * size)
        find = self.by_key.get

        def rank(a: int, b: int, at: int) -> int:
            r = find(a << 32 | b)
            return none if r is None else r * size + at

        for i in range(n - 1):
            tree[size + i] = rank(symbol[i], symbol[i + 1], i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + size
            tree[node] = value
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while tree[1] < none:
            r, at = divmod(tree[1], size)
            gone = after[at]
            symbol[at], symbol[gone] = int(self.merged[r]), -1
            after[at] = following = after[gone]
            put(gone, none)
            if following < n:
                before[following] = at
                put(at, rank(symbol[at], symbol[following], at))
            else:
                put(at, none)
            leading = before[at]
            if leading >= 0:
                put(leading, rank(symbol[leading], symbol[at], leading))
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for size, members in by_size.items():
            for begin in range(0, len(members), 20_000):
                some = members[begin : begin + 20_000]
                made = (
                    self._encode_short([pieces[i] for i in some], size)
                    if size <= SHORT
                    else [self._encode_long(pieces[i]) for i in some]
                )
                for i, ids in zip(some, made, strict=True):
                    out[i] = ids
        return out

    # --- texts --------------------------------------------------------------------------
    def encode_texts(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = []
        for text in texts:
            pieces: list[str] = []
            for part in self.split.split(text or "") if self.split else [text or ""]:
                if part in self.special:
                    pieces.append(part)
                elif part:
                    pieces += cut_pieces(part)
            cut.append(pieces)
        if len(self.cache) > CACHED:
            self.cache.clear()
        cache = self.cache
        for token, i in self.special.items():  # no other piece can equal one: the pattern cuts them
            cache[token] = np.array([i], "<u4").tobytes()
        unknown = list(set(itertools.chain.from_iterable(cut)) - cache.keys())
        cache.update(zip(unknown, self.encode_pieces([p.encode() for p in unknown]), strict=True))
        return [b"".join([cache[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        tokens, n = self.tokens, len(self.tokens)
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the text's ids as little-endian unsigned 32-bit integers."""
    loaded: list[ByteBpe] = []

    def compute(batch: pa.RecordBatch) -> list:
        if not loaded:
            loaded.append(ByteBpe(path))
        return [loaded[0].encode_texts(batch.column(text).to_pylist())]

    return add_columns(docs, compute, "ids binary", sized_by=text)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``."""
    loaded: list[ByteBpe] = []

    def compute(batch: pa.RecordBatch) -> list:
        if not loaded:
            loaded.append(ByteBpe(path))
        column = batch.column("ids").to_pylist()
        return [[None if b is None else loaded[0].decode(b) for b in column]]

    return add_columns(encoded, compute, "decoded string", sized_by="ids")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode_documents(docs, path).select(
        "doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")
    )
    return decode_documents(encoded, path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
