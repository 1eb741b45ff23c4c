"""Packing, language ID, the byte-pair codec, quality rules, secret scan, against brute force."""

import base64
import binascii
import gzip
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hiresift.llm import bpe, language_id, packing, quality, secret_scan

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [chr(c) for c in range(1, 0x3000, 7)] + ["İ", "Σ", "ǅ", "é", "<|endoftext|>", "<|startoftext|>", "  ", "'ll", "࢏", "\U0001f600"]


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    return t


def odd_texts(seed, n=400):
    r = random.Random(seed)
    plain = [chr(c) for c in range(32, 256)]
    return [
        *("".join(r.choice(plain if i % 2 else ODD) for _ in range(r.randrange(80))) for i in range(n)),
        "", "a", "ab" * 700, " " * 300 + "x", "x" * 64, "y" * 65, "z" * 2000,
    ]


# --- packing ------------------------------------------------------------------------------
def test_word_ids_equal_the_library():
    texts = odd_texts(1)
    want = [e.ids for e in tokenizer(WORD).encode_batch(texts, add_special_tokens=False)]
    got = packing.WordTokenizer(WORD).encode_texts(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == want


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 100, 4095, 4096, 4097, 20_000])
def test_cut_lengths_cover_and_fit(n):
    cut = packing.cut_lengths(n)
    assert sum(size for size, _ in cut) == n
    assert all(0 < size * j <= 4096 and size * (j + 1) >= 4096 - j for size, j in cut)


def test_packing_is_whole_and_tight(spark, documents, odd_rows):
    docs = documents([*odd_rows, *((100 + i, "word " * (i * 7 % 900)) for i in range(300))])
    rows = packing.pack_documents(docs, WORD).collect()
    t = tokenizer(WORD)
    want = Counter(
        (d.doc_id, np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d in docs.collect()
    )
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length, r.padded_length))
        assert len(r.ids) == 4 * r.length
    assert sum(r.length for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    for (doc_id, ids), n in want.items():
        pieces = sorted(set(by_doc[doc_id, len(ids) // 4]))
        if n == 1 and doc_id not in (2, None):
            assert b"".join(p for _, p in pieces) == ids
    used = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and pieces[0][2] in (at, 4096) and (pieces[0][2] == 4096 or at & (at - 1) == 0)
        used, padded = used + at, padded + pieces[0][2]
    assert used / padded > 0.97


def test_packing_of_nothing(spark, documents):
    assert packing.pack_documents(documents([]), WORD).count() == 0


# --- byte-pair codec ----------------------------------------------------------------------
def test_byte_ids_equal_the_library_and_decode():
    texts = odd_texts(2)
    t, own = tokenizer(BYTE), bpe.ByteBpe(BYTE)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = own.encode_texts(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == want
    assert [own.decode(b) for b in got] == [t.decode(w, skip_special_tokens=False) for w in want] == texts


def test_tree_takes_the_leftmost_lowest_rank():
    own = bpe.ByteBpe(BYTE)
    r = random.Random(4)
    for _ in range(200):
        piece = bytes(r.choice(b"abteh in") for _ in range(r.randrange(1, 90)))
        ids = own.first[np.frombuffer(piece, np.uint8)].tolist()
        while True:
            ranks = [own.by_key.get(a << 32 | b, math.inf) for a, b in zip(ids, ids[1:])]
            if not ranks or min(ranks) == math.inf:
                break
            at = ranks.index(min(ranks))
            ids[at : at + 2] = [int(own.merged[ranks[at]])]
        assert np.frombuffer(own.encode_pieces([piece])[0], "<u4").tolist() == ids
        assert np.frombuffer(own._encode_long(piece), "<u4").tolist() == ids


def test_codec_on_tables(spark, documents, odd_rows):
    docs = documents(odd_rows).withColumn("ids", F.lit("clash"))
    rows = bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE).collect()
    assert len(rows) == len(odd_rows) and all(r.decoded == (r.text or "") for r in rows)
    assert bpe.encode_documents(documents([]), BYTE).count() == 0
    broken = spark.createDataFrame([(bytearray(np.array([255, 70_000], "<u4").tobytes()),), (None,)], "ids binary")
    assert [r.decoded for r in bpe.decode_documents(broken, BYTE).collect()] == [bpe.ByteBpe(BYTE).decode(np.array([255], "<u4").tobytes()), None]


# --- language ID --------------------------------------------------------------------------
def brute_bits(frozen, language, text):
    seen = defaultdict(Counter)
    for gram, n in zip(frozen.grams[language].tolist(), frozen.counts[language].tolist()):
        b = gram.to_bytes(4, "big")
        for k in range(4):
            seen[b[3 - k : 3]][b[3]] += n
    data, bits = language_id.START + text.encode(), 0.0
    for i in range(3, len(data)):
        out, p = set(), 1.0
        for k in (3, 2, 1, 0):
            c = {s: n for s, n in seen.get(data[i - k : i], {}).items() if s not in out}
            total = sum(c.values()) + len(c)
            if data[i] in c:
                p *= c[data[i]] / total
                break
            if c:
                p, out = p * len(c) / total, out | set(c)
        else:
            p /= 256 - len(out)
        bits -= math.log2(p)
    return bits


LANGS = {"aa": ["baba", "gaga", "dada"], "bb": ["lolo", "mömö", "roro"], "cc": ["si", "ti", "ki"]}


def language_rows(n=200):
    r = random.Random(5)
    return [(i, " ".join(r.choice(LANGS[lang]) for _ in range(40)), lang) for i in range(n) for lang in [r.choice([*LANGS])]]


def test_code_lengths_are_exact(spark, documents):
    frozen = language_id.learn(documents(language_rows()))
    tables = language_id.Tables(frozen)
    for text in ["baba lolo", "über 12 \x00 你好", "x", "ti ti ti ki"]:
        got = language_id.total_bits(tables, [None, text, ""])
        assert np.allclose(got[1], [brute_bits(frozen, i, text) for i in range(3)], rtol=1e-5) and not got[[0, 2]].any()


def test_language_of_held_out_documents(spark, documents, odd_rows):
    rows = language_rows() + [(r[0], r[1]) for r in odd_rows] + [(500, "12 34 !", "aa")]
    docs = documents(rows).withColumn("score", F.lit("clash"))
    got = language_id.identify(docs, language_id.learn(docs)).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.lang:
            assert r.lang_pred == r.lang


def test_learning_ignores_held_out_rows_and_may_find_nothing(spark, documents):
    rows = language_rows()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert language_id.learn(documents(held)).langs == []
    got = language_id.identify(documents(rows[:5]), language_id.learn(documents([]))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    few = language_id.gram_counts(documents(rows), sample_bytes=2000).agg(F.sum("n")).first()[0]
    assert few < 0.5 * language_id.gram_counts(documents(rows)).agg(F.sum("n")).first()[0]


def test_a_long_document_does_not_thin_out_its_language(spark, documents):
    short = [(4 * i, f"kurz {i} " * 100, "aa") for i in range(40)]
    rows = [*short, (1000, "lang und laenger " * 400_000, "aa"), (1001, "andere " * 2000, "bb")]
    rows = [r for r in rows if binascii.crc32(str(r[0]).encode()) % 4 != language_id.HELD_OUT] + [(7777, "z", "cc"), (7778, "z", "cc"), (7779, "z", "cc")]
    bound = 400_000
    n = {r["lang"]: r["n"] for r in language_id.gram_counts(documents(rows), bound).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    sizes = {}
    for _, t, lang in rows:
        sizes[lang] = sizes.get(lang, 0) + len(t)
    assert sizes["aa"] > 10 * bound and 0.5 * bound < n["aa"] < 1.5 * bound and n["bb"] == sizes["bb"]
    assert "cc" in n
    whole = language_id._grams_of(language_id.drawn_stretches("äb c" * 3000, 5, 1.0))[0]
    assert (whole == language_id.grams_of(["äb c" * 3000])[0]).all()


# --- quality rules ------------------------------------------------------------------------
def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_statistics_equal_brute_force(odd_rows):
    texts = [r[1] for r in odd_rows if r[1] is None or len(r[1]) < 9000]
    texts += ["a b c d e f a b c d e", "x x x x x x", "# a\n# a\n\n|\n", "one\none \none"]
    for text in texts:
        assert quality.statistics(text)[0] == brute_counts(text)


def test_trees_learn_and_are_monotonic():
    r = np.random.default_rng(6)
    x = r.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] + 0.5 * x[:, 0] + 0.1 * r.normal(size=3000)) < 0.8).astype(float)
    falls = np.array([quality.MONOTONE.get(f, 0) for f in quality.FEATURES])
    model = quality.fit_trees(x, y, monotone=falls)
    assert ((model.probability(x) >= 0.5) == (y > 0.5)).mean() > 0.9
    for j in np.flatnonzero(falls):
        steps = np.repeat(x[:50], 20, axis=0)
        steps[:, j] = np.tile(np.linspace(0, 1, 20), 50)
        assert (np.diff(model.margin(steps).reshape(50, 20)) <= 1e-12).all()


def test_quality_of_tables(spark, documents, odd_rows):
    good = [(100 + i, " ".join(f"w{i * k % 97}" for k in range(60))) for i in range(100)]
    bad = [(300 + i, " ".join(f"W{i * k % 97}!!" for k in range(60))) for i in range(100)]
    docs = documents([*good, *bad, *odd_rows]).withColumn("kept", F.lit("clash"))
    labels = [(100 + i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (100, None, 0), (100, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(got) == 200 + len(odd_rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.kept == (not r.base_failed and r.doc_id < 300)
    empty = quality.judge_quality(docs, quality.fit_quality(docs, labels.limit(0)))
    assert empty.where("kept = base_failed").count() == 0
    assert quality.judge_quality(documents([]), quality.fit_quality(documents([]), labels)).count() == 0


# --- secret scan --------------------------------------------------------------------------
SECRET = "password=b7db7aa4a5fcc78305"
HIDDEN = {
    "url": urllib.parse.quote(SECRET, safe=""),
    "all url": "".join(f"%{b:02X}" for b in SECRET.encode()),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "base64": base64.b64encode(SECRET.encode()).decode(),
    "gzip": base64.b64encode(gzip.compress(SECRET.encode())).decode(),
    "url of base64 of zlib of unicode": urllib.parse.quote(
        base64.b64encode(zlib.compress(("\\u0070" + SECRET[1:]).encode())).decode(), safe=""
    ),
    "base64 three times": base64.b64encode(base64.b64encode(base64.b64encode(SECRET.encode()))).decode(),
}


@pytest.mark.parametrize("name", sorted(HIDDEN))
def test_hidden_secrets_are_mapped_to_their_place(name):
    text = f"é {HIDDEN[name]} ende"
    plain, found = secret_scan.find_secrets(text)
    assert plain == [] or name == "url"
    assert any(kind == 0 and start >= 2 and end <= 2 + len(HIDDEN[name]) for start, kind, end in found)
    start, end = min(s for s, _, _ in found), max(e for _, _, e in found)
    assert (start, end) == (2, 2 + len(HIDDEN[name])) or name.startswith("base64")
    assert secret_scan.MASK in secret_scan.masked(text, found)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  \t"])
def test_wrapped_base64_is_joined(end):
    r = random.Random(5)
    lead = "".join(r.choice("abcdefgh ,") for _ in range(100))
    for data in (f"{lead} {SECRET} {lead}".encode(), gzip.compress(f"{lead} {SECRET}".encode()), zlib.compress(f"{SECRET} {lead}".encode())):
        code = base64.b64encode(data).decode()
        for width in (8, 64, 76):
            wrapped = end.join(code[i : i + width] for i in range(0, len(code), width))
            text = f"é: {wrapped}\n\nend"
            found = secret_scan.find_secrets(text)[1]
            assert (0 in {k for _, k, _ in found}) and all(3 <= s < e <= 4 + len(wrapped) for s, _, e in found)
            if data[:2] == lead.encode()[:2]:
                plain = data.index(SECRET.encode())
                at = [j for j in range(3, len(text)) if not text[j].isspace()]
                assert (at[plain // 3 * 4], 0, at[(plain + len(SECRET) - 1) // 3 * 4 + 3] + 1) in found


@pytest.mark.parametrize("before", ["/v1/", "example/v1/", "key_", "a-", "ab", "abc"])
def test_glued_base64_is_decoded(before):
    for data in (SECRET.encode(), gzip.compress(SECRET.encode()), b"\xff\x00" + SECRET.encode() + b"\x01\xfe"):
        text = f"x {before}{base64.b64encode(data).decode()} y"
        found = secret_scan.find_secrets(text)[1]
        assert found and all(s >= len(before) + 2 - 3 and e <= len(text) - 2 for s, _, e in found)
        assert secret_scan.MASK in secret_scan.masked(text, found)


def test_all_members_of_large_compressed_data_are_searched():
    import bz2
    import lzma

    import zstandard

    # across the edge of a block, in a run without one, and behind what was the bound of a layer
    across = gzip.compress(b"lorem ipsum, " * 80_659 + SECRET.encode() + b" ipsum" * 200_000)
    run = gzip.compress(b"Q" * (3 << 20) + SECRET.encode())
    late = gzip.compress(bytes(1 << 26) + b"lorem ipsum, " + SECRET.encode(), 1)
    made = [across, run, late, gzip.compress(gzip.compress(late)), lzma.compress(SECRET.encode(), preset=9)]
    for compress in (gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        made.append(compress(b"first") + compress(b"second") + compress(SECRET.encode()) + b"rest")
    made.append(gzip.compress(b"\x00\xff binary \x01" + SECRET.encode()))
    for data in made:
        text = f"x {base64.b64encode(data).decode()} y"
        assert [f[1] for f in secret_scan.find_secrets(text)[1]] == [0]
    cut = base64.b64encode(gzip.compress(b"first") + gzip.compress(SECRET.encode())[:-9]).decode()
    assert secret_scan.find_secrets(cut)[1] == []


def test_plain_secrets_equal_the_stated_patterns():
    r = random.Random(7)
    parts = ["password", "PassWD", "secret", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abc", "abcdef", "ſecret", "AKIA", "0A" * 8, "0a" * 12, "é", "\n"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(20)))
        want = [
            (m.start(), 0, m.end())
            for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text)
            if len(m[2]) >= 6
        ]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secret_scan.find_plain(text) == sorted(want)


def test_secret_scan_of_tables(spark, documents, odd_rows):
    docs = documents(odd_rows).withColumn("spans", F.lit("clash"))
    got = secret_scan.scan_secrets(docs).collect()
    assert len(got) == len(odd_rows)
    assert all(r.masked_text == r.text for r in got if r.doc_id != 13)
    assert [s.kind for r in got if r.doc_id == 13 for s in r.spans] == ["assign", "access", "hex"]
    assert secret_scan.scan_secrets(documents([])).count() == 0
