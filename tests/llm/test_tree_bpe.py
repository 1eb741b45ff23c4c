"""The monoid-tree codec against the tiktoken library."""

import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hiresift.llm import tree_bpe
from tests.llm.test_text_operators import odd_texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return tree_bpe.TreeBpe(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(b):
    return np.frombuffer(b, "<u4").tolist()


def long_pieces():
    r = random.Random(7)
    return ["a" * 5000, "ab" * 3001, "the" * 2000, " " * 4000 + "x", "é" * 999, "=-" * 3333, "\n" * 2049, "".join(r.choice("abtehin") for _ in range(9000))]


def test_ids_equal_the_library_and_decode(own, library):
    for text in [*odd_texts(11), *long_pieces()]:
        ids = own.encode(text)
        assert ids_of(ids) == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_every_character_is_cut_like_the_library(own, library):
    for begin in range(1, 0x30000, 64):
        text = "".join(f"a{c}1{c} {c}{c}." for c in map(chr, range(begin, begin + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert ids_of(own.encode(text)) == library.encode_ordinary(text)


def test_tree_equals_plain_merging(own):
    r = random.Random(5)
    tokens = [t for t in own.ranks if len(t) < 20]
    for k in range(4000):
        raw = b"".join(r.choice(tokens) for _ in range(r.randrange(1, 12))) if k % 2 else bytes(r.choice(b"abct ehn\xc3\xa9") for _ in range(r.randrange(1, 90)))
        plain = own._merged_by_scan(raw)
        assert own.reduced(raw) == plain == own._merged_by_heap(raw)
        cut = r.randrange(len(raw) + 1)
        assert own.join(own._merged_by_scan(raw[:cut]), own._merged_by_scan(raw[cut:])) == plain


def test_any_rank_file(tmp_path):
    """Few merges that overlap, so that windows must grow."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"ba", b"aba", b"abab", b"bab", b"aa", b"aaa", b"aaab"]
    file = tmp_path / "ranks"
    file.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = tree_bpe.TreeBpe(str(file), r"\S+|\s+")
    library = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("aab ") for _ in range(r.randrange(120)))
        assert ids_of(own.encode(text)) == library.encode_ordinary(text)


def test_long_texts_and_full_caches(own, library, monkeypatch):
    monkeypatch.setattr(tree_bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(tree_bpe, "RUN", 7)
    monkeypatch.setattr(tree_bpe, "CACHED", 5)
    monkeypatch.setattr(tree_bpe, "SHARED", 5)
    text = " ".join(odd_texts(3, 60))
    assert ids_of(own.encode(text)) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_pieces_in_use_are_encoded_once_though_caches_fill(library, monkeypatch):
    monkeypatch.setattr(tree_bpe, "CACHED", 40)
    monkeypatch.setattr(tree_bpe, "SHARED", 40)
    own, made = tree_bpe.TreeBpe(PATH, PATTERN), Counter()
    encoded = own.piece_ids
    monkeypatch.setattr(own, "piece_ids", lambda piece: made.update([piece]) or encoded(piece))
    word = lambda k: "".join("bdfghklmnprstvwz"[k >> s & 15] for s in (8, 4, 0))
    common = [f" {word(k)}ounenti" for k in range(10)]
    for line in range(100):
        rare = [f" {word(100 + line * 10 + k)}erhaing" for k in range(10)]
        text = "".join(c + r for c, r in zip(common, rare, strict=True))
        assert ids_of(own.encode(text)) == library.encode_ordinary(text)
    assert len(made) == 1010 and set(made.values()) == {1}
    assert all(len(half) <= 40 for cache in (own.cache, own.shared) for half in (cache, cache.older))


def test_codec_on_tables(spark, documents, odd_rows, library):
    docs = documents(odd_rows).withColumn("ids", F.lit("clash"))
    rows = tree_bpe.decode_documents(tree_bpe.encode_documents(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(rows) == len(odd_rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() and ids_of(r.ids) == library.encode_ordinary(r.text or "") for r in rows)
    assert tree_bpe.encode_documents(documents([]), PATH, PATTERN).count() == 0
    broken = spark.createDataFrame([(bytearray(np.array([255, 70_000], "<u4").tobytes()),), (None,)], "ids binary")
    decoded = [r.decoded for r in tree_bpe.decode_documents(broken, PATH, PATTERN).collect()]
    assert decoded[1] is None and bytes(decoded[0]) == library.decode_bytes([255])


def test_round_trip_equals_both_ways(documents, odd_rows):
    docs = documents(odd_rows).withColumn("decoded", F.lit("clash"))
    both = tree_bpe.decode_documents(tree_bpe.encode_documents(docs, PATH, PATTERN), PATH, PATTERN)
    once = tree_bpe.round_trip_documents(docs, PATH, PATTERN)
    assert sorted(map(str, once.select(both.columns).collect())) == sorted(map(str, both.collect()))
    assert once.dtypes == both.dtypes
    assert tree_bpe.round_trip_documents(documents([]), PATH, PATTERN).count() == 0


def test_query_equals_the_library(spark, tmp_path, documents, odd_rows, library):
    import hashlib

    documents(odd_rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text in odd_rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        want.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in tree_bpe.op13_tree_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
