"""The pipeline against its stages' rules, and the registration of the queries."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from hiresift.llm import language_id, secret_scan
from tests.llm.test_set_operators import brute_lines, brute_ngrams

SECRET = "password=b7db7aa4a5fcc78305"


def pipeline_rows():
    r = random.Random(9)
    langs = {"aa": ["baba", "gaga", "dada", "fafa"], "bb": ["lolo", "mömö", "roro", "nono"]}

    def sentence(lang, n=40):
        return " ".join(r.choice(langs[lang]) + str(r.randrange(30)) for _ in range(n))

    rows = [(i, sentence(lang), lang) for i in range(80) for lang in [r.choice([*langs])]]
    shared = "This line is in very many documents"
    rows += [(100 + i, f"{shared}\n{sentence('aa')}", "aa") for i in range(5)]
    near = sentence("bb", 200)
    rows += [(200 + i, f"{near} end{i}", "bb") for i in range(5)]
    rows += [(300, f"{sentence('aa')} {SECRET}", None), (301, "12 34 56", "aa"), (302, None, "aa"), (303, shared, "aa"), (304, "", None)]
    return rows


def test_stages_take_effect_in_order(spark, documents):
    rows = pipeline_rows()
    docs = documents(rows)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "secret_scan", "packing"]

    known = stages["language_id"](spark, docs, "").persist()
    frozen = language_id.learn(docs)
    assert known.columns == columns
    assert {r.doc_id for r in known.collect()} == {d for d, t, _ in rows if t and any(map(str.isalpha, t))}
    assert {r.lang for r in known.collect()} <= set(frozen.langs)

    lines = stages["line_dedup"](spark, known, "").persist()
    want = {d: t for d, _, gone, t in brute_lines([(r.doc_id, r.text) for r in known.collect()]) if t.strip() or not gone}
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    single = stages["ngram_join"](spark, lines, "").persist()
    kept = {d for d, _, c in brute_ngrams([(r.doc_id, r.text) for r in lines.collect()]) if d == c}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == kept
    assert kept & {200, 201, 202, 203, 204} == {200}

    safe = stages["secret_scan"](spark, single, "").persist()
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert safe.columns == columns and set(texts) == kept
    assert SECRET not in texts[300] and secret_scan.MASK in texts[300]
    assert all(texts[r.doc_id] == r.text for r in single.collect() if r.doc_id != 300)

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    pieces = {}
    for r in stages["packing"](spark, safe, "").collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for doc_id, text in texts.items():
        ids = np.frombuffer(b"".join(p for _, p in sorted(pieces[doc_id])), "<u4").tolist()
        assert ids == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_language_stage_drops_only_what_language_id_rejects(spark, documents):
    encoded = "".join(f"%{b:02X}" for b in SECRET.encode())
    clean = ["Это чистый русский текст", "Καλημέρα κόσμε", "你好世界", "xq", "Zaß", f"baba {encoded}", "baba 你好 gaga мир"]
    rows = [*pipeline_rows()[:80], *((400 + i, t, None) for i, t in enumerate(clean)), (500, "12 + 34", None)]
    kept = {r.doc_id for r in corpus_pipeline.by_language(spark, documents(rows), "").collect()}
    assert kept == {d for d, _, _ in rows if d != 500}


def test_near_copies_from_five_words_and_four_fifths(spark, documents):
    words = [f"w{i}" for i in range(84)]  # 80 shingles of five words
    longer = {n: " ".join([*words, *(f"z{n}x{i}" for i in range(n))]) for n in (20, 21)}
    few = [f"v{i}" for i in range(8)]  # light sets: 4 shingles against 5 and 6
    rows = [
        (1, " ".join(words)), (2, longer[20]),  # 80 of 100: linked
        (3, " ".join(w.upper() + "q" for w in words)), (4, " ".join([*(w.upper() + "q" for w in words), *map(str, range(21))])),
        (5, " ".join(few)), (6, " ".join([*few, "a"])), (7, " ".join(f"u{x}" for x in few)), (8, " ".join([*(f"u{x}" for x in few), "a", "b"])),
    ]
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, documents(rows), "").collect()}
    assert kept == {1, 3, 4, 5, 7, 8}


def test_one_row_of_near_copies_whatever_their_ids(spark, documents):
    base = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [
        (1, f"{base} a"), (2, f"{base} b"), (2, f"{base} c"),  # near copies, two of one id
        (None, f"{other} a"), (None, f"{other} b"), (None, f"{other} b"),  # without ids, two of them equal
        (7, "only one here"), (7, "only one here"), (8, "one id"), (8, "and another text"), (9, None), (9, None), (10, ""),
    ]
    kept = corpus_pipeline.one_of_near_copies(spark, documents(rows), "").collect()
    got = sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept)
    assert got == [(0, "v0 "), (1, "w0 "), (7, "onl"), (8, "and"), (8, "one"), (9, ""), (9, ""), (10, "")]


def test_stages_of_nothing(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_registered_once_with_their_sql():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_points.queries()
    assert {n for n in entry_points.oracle_sql() if n.startswith("op")} == {
        "op1_substring_dedup", "op4_line_dedup", "op5_embedding_dedup", "op9_ngram_join", "op10_url_filter", "op11_conversation_repair", "op12_hard_negatives",
    }
