"""Substring dedup, line dedup, n-gram join, embedding dedup, URL filter, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiresift.llm import embedding_dedup, graph, line_dedup, ngram_join, substring_dedup, url_filter

LAST = (1 << 63) - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def smallest_reachable(n, pairs):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def edited(r, base, vocabulary):
    out = list(base)
    for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
        k = r.randrange(len(out))
        out[k : k + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
    return out or ["x"]


# --- components ---------------------------------------------------------------------------
@pytest.mark.parametrize("seed,n,m", [(0, 30, 25), (1, 200, 150), (2, 120, 0)])
def test_components(spark, seed, n, m):
    r = random.Random(seed)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] or [(i, i + 1) for i in range(n - 1)]
    want = smallest_reachable(n, pairs)
    got = graph.components(spark.createDataFrame(pairs, "u long, v long"), rows_per_salt=5).collect()
    assert {r.node: r.component for r in got} == {x: want[x] for p in pairs for x in p}


# --- substring dedup ----------------------------------------------------------------------
def brute_repeats(rows, window):
    first, out = {}, []
    for doc_id, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1):
            key, here = tuple(w[s : s + window]), (LAST if doc_id is None else doc_id, s)
            first[key] = min(first.get(key, here), here)
    for doc_id, text in rows:
        w, gone = words(text), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (LAST if doc_id is None else doc_id, s):
                gone |= set(range(s, s + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def substring_rows(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [[r.choice(vocabulary) for _ in range(r.randrange(10, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randrange(1, 5)):
            w += r.choice([r.choice(passages), [r.choice(vocabulary)] * 25, [r.choice(vocabulary) for _ in range(15)]])
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows_per_salt", [1_000_000, 6])
def test_substring_dedup_equals_brute_force(documents, odd_rows, rows_per_salt):
    rows = substring_rows(1) + [((None if i is None else 1000 + i), t) for i, t in odd_rows]
    docs = documents(rows).withColumn("n_words", F.lit("clash")).withColumn("_doc", F.lit("clash"))
    got = substring_dedup.remove_repeats(docs, rows_per_salt=rows_per_salt).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_repeats(rows, 20)


def test_rows_with_equal_ids_and_short_hashes(spark, documents):
    """Rows of one id, null or not, whose texts agree in 32 bits of hash are still rows of their own."""
    numbered = spark.range(200_000).select(F.concat(F.lit("t "), F.col("id").cast("string")).alias("head"))
    tails = [" ".join(f"a{i}" for i in range(24)), " ".join(f"b{i}" for i in range(70)) + " " + " ".join(f"a{i}" for i in range(24))]
    texts = [F.concat("head", F.lit(" " + t)) for t in tails]
    both = numbered.select(texts[0].alias("text")).union(numbered.select(texts[1].alias("text")))
    same = both.groupBy(F.hash("text").alias("h")).agg(F.min("text").alias("x"), F.max("text").alias("y")).where("length(y) - length(x) > 100 or length(x) - length(y) > 100")
    x, y = same.limit(1).select("x", "y").first()
    assert len(words(x)) != len(words(y)) and x != y
    for doc_id in (None, 5):
        rows = [(doc_id, x), (doc_id, y), (doc_id, tails[1]), (9, f"{tails[0]} {tails[1]}")]
        got = substring_dedup.remove_repeats(documents(rows)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_repeats(rows, 20)


def test_substring_dedup_of_nothing(documents):
    assert substring_dedup.remove_repeats(documents([])).count() == 0
    assert substring_dedup.remove_repeats(documents([(1, None)])).first().kept_text == ""


# --- line dedup ---------------------------------------------------------------------------
def line_key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 20:
                holders.setdefault(line_key(line), set()).add(LAST if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        here = LAST if doc_id is None else doc_id
        kept = [x for x in lines if not (len(h := holders.get(line_key(x), ())) >= 3 and here < max(h))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(seed):
    r = random.Random(seed)
    lines = [f"  Line number {i} with some more words " for i in range(25)] + ["short", "", " \t"]
    return [(i, "\n".join(r.choice(lines) + r.choice(["", " ", f" {r.random()}"]) for _ in range(r.randrange(8)))) for i in range(200)]


def judged(store, docs):
    got = line_dedup.dedup_lines(store, docs).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got), key=str)


def test_line_dedup_equals_brute_force(documents, odd_rows):
    rows = line_rows(2) + [((None if i is None else 1000 + i), t) for i, t in odd_rows]
    docs = documents(rows).withColumn("n_lines", F.lit("clash")).withColumn("shard", F.lit("kept"))
    got = line_dedup.dedup_whole(docs)
    assert {"shard", "lang"} <= set(got.columns)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == brute_lines(rows)
    assert line_dedup.dedup_whole(documents([])).count() == 0


def test_insertions_and_deletions_are_reversible(spark, documents):
    old, new = line_rows(3), [(i + 500, t) for i, t in line_rows(4)]
    docs_old, docs_new, both = documents(old), documents(new), documents(old + new)
    start = line_dedup.insert(line_dedup.empty_store(spark, shards=4), docs_old)
    grown = line_dedup.insert(start, docs_new)
    assert judged(grown, both) == brute_lines(old + new)
    back = line_dedup.delete(grown, docs_new.select("doc_id"))
    assert judged(back, docs_old) == judged(start, docs_old) == brute_lines(old)
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, start.refs.collect()))


def test_shards_double_with_their_keys(spark, documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 3)
    old, new = line_rows(3), [(i + 500, t + "\n" + "\n".join(f"another shared line, number {k}" for k in range(40))) for i, t in line_rows(4)[:20]]
    start = line_dedup.insert(line_dedup.empty_store(spark, shards=2), documents(old))
    grown = line_dedup.insert(start, documents(new))
    assert start.shards < grown.shards and grown.shards & (grown.shards - 1) == 0
    assert {r.shard for r in grown.filters.collect()} <= set(range(grown.shards))
    assert judged(grown, documents(old + new)) == brute_lines(old + new)
    back = line_dedup.delete(grown, documents(new).select("doc_id"))
    assert back.shards == grown.shards and judged(back, documents(old)) == brute_lines(old)


def test_cuckoo_filter_has_no_false_negatives():
    r = np.random.default_rng(5)
    k1, k2 = r.integers(-(1 << 63), LAST, (2, 6000))
    held = line_dedup.CuckooFilter.sized_for(3000)
    held.insert(k1[:2000], k2[:2000])
    held.insert(k1[2000:4000], k2[2000:4000])  # beyond its size, so the stash is used
    assert held.contains(k1[:4000], k2[:4000]).all() and held.load() == 4000
    held.delete(k1[:1500], k2[:1500])
    again = line_dedup.CuckooFilter.from_bytes(held.to_bytes())
    assert again.contains(k1[1500:4000], k2[1500:4000]).all() and again.load() == 2500
    assert again.contains(k1[4000:], k2[4000:]).mean() < 0.01


# --- n-gram join --------------------------------------------------------------------------
def brute_ngrams(rows):
    order = [LAST if i is None else i for i, _ in rows]
    sets = []
    for _, text in rows:
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(4, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    pairs = [
        (a, b)
        for b in range(len(rows)) for a in range(b)
        if sets[a] and 100 * (o := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - o)
    ]
    groups = smallest_reachable(len(rows), pairs)
    low = {}
    for g, i in zip(groups, order):
        low[g] = min(low.get(g, LAST), i)
    return sorted(((i, len(s), None if low[g] == LAST else low[g]) for (i, _), s, g in zip(rows, sets, groups)), key=str)


def ngram_rows(seed):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(n)] for n in (4, 8, 9, 12, 16, 22, 30, 60, 120, 300) for _ in range(2)]
    return [(i, " ".join(edited(r, r.choice(bases), vocabulary))) for i in range(400)]


@pytest.mark.parametrize("limits", [{}, {"rows_per_salt": 8, "block": 16}])
def test_ngram_join_equals_brute_force(documents, odd_rows, limits):
    rows = ngram_rows(6) + [((None if i is None else 1000 + i), t) for i, t in odd_rows] + [(2000, "A b"), (2001, "a B")]
    docs = documents(rows).withColumn("component_id", F.lit("clash")).withColumn("sid", F.lit("kept"))
    got = ngram_join.join_ngrams(docs, **limits).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_ngrams(rows)


def test_lists_that_hold_pairs_back_are_scanned_again():
    n = np.full(300, 100)
    group = np.arange(300)
    i, j = np.triu_indices(300, 1)
    distance = np.full(len(i), 20)
    take = ngram_join.chosen(i, j, distance, group, n, 50)
    assert 50 <= take.sum() <= 350
    assert len(set(smallest_reachable(300, list(zip(i[take].tolist(), j[take].tolist()))))) == 1


def test_a_group_of_near_copies_gives_few_pairs(documents, monkeypatch):
    """What is compared grows with the group, not with its square; afterwards its lists are skipped."""
    r = random.Random(2)
    base = [f"w{r.randrange(400)}" for _ in range(300)]
    compared = {}
    for g in (60, 240):
        rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i in range(g) for k in [r.randrange(300)]]
        seen = []
        plain, verified = ngram_join.candidates, ngram_join.verified
        monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a, **k: seen.append(pairs.count()) or verified(pairs, *a, **k))
        monkeypatch.setattr(ngram_join, "candidates", lambda listed, *a, **k: (lambda f: seen.append(f.count()) or f)(plain(listed, *a, **k)))
        got = ngram_join.join_ngrams(documents(rows)).collect()
        monkeypatch.undo()
        assert {x.component_id for x in got} == {0}
        compared[g] = sum(seen)
    assert compared[240] <= 6 * compared[60] and compared[240] <= 240 * 2 * ngram_join.SPINE


def test_ngram_join_of_nothing(documents):
    assert ngram_join.join_ngrams(documents([])).count() == 0


# --- embeddings ---------------------------------------------------------------------------
def brute_embeddings(rows, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    vec = [np.array(v, np.float32).astype(float) if o else None for (_, v), o in zip(rows, ok)]
    pairs = [
        (a, b)
        for b in range(len(rows)) for a in range(b)
        if ok[a] and ok[b] and len(vec[a]) == len(vec[b])
        and vec[a] @ vec[b] / np.sqrt((vec[a] @ vec[a]) * (vec[b] @ vec[b])) >= cosine
    ]
    groups, links = smallest_reachable(len(rows), pairs), np.zeros(len(rows), int)
    for a, b in pairs:
        links[[a, b]] += 1
    order = [LAST if i is None else i for i, _ in rows]
    low = {}
    for g, i in zip(groups, order):
        low[g] = min(low.get(g, LAST), i)
    return sorted(((i, int(n), None if low[g] == LAST else low[g], low[g] == o) for (i, _), n, g, o in zip(rows, links, groups, order)), key=str)


@pytest.mark.parametrize("leaf", [4096, 40])
def test_embedding_links_equal_brute_force(spark, leaf):
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 8))
    noise = r.choice([0.001, 0.05, 0.15, 0.3], 300)[:, None] * r.normal(size=(300, 8))
    x = np.concatenate([centres[r.integers(0, 12, 300)] + noise, r.normal(size=(60, 8))])
    x = np.concatenate([x, x[:30], 2.0 * x[:5]])
    rows = [(int(i), [float(np.float32(a)) for a in v]) for i, v in zip(r.permutation(len(x)), x)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8),
             (905, [float("inf")] + [1.0] * 7), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[0][1]), (rows[1][0], rows[1][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    got = embedding_dedup.link_embeddings(vectors, leaf=leaf).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute_embeddings(rows)


def test_multiples_of_one_vector_end(spark):
    """Far more points of one direction than a leaf holds, with some outliers between them."""
    r = np.random.default_rng(3)
    one, near = r.normal(size=6), r.normal(size=6)
    rows = [(i, [float(np.float32(x)) for x in (1 + i) * one]) for i in range(300)]
    rows += [(500 + i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(20)]
    rows += [(600 + i, [float(np.float32(x)) for x in near * 3.0**i]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embedding_dedup.link_embeddings(vectors, leaf=12).collect()
    assert sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in got), key=str) == brute_embeddings(rows)


def test_rows_sent_grow_with_the_root_of_the_leaves(spark):
    """Without structure every leaf meets every other; a vector is sent once per group of leaves."""
    r = np.random.default_rng(4)
    for n in (400, 1600):
        rows = [(i, [float(x) for x in r.normal(size=24)]) for i in range(n)]
        points = spark.createDataFrame([(i, v, 1, 24) for i, v in rows], "nid long, vec array<double>, weight long, node long")
        leaves, levels = embedding_dedup.build_upper(points, leaf=16)
        planted = embedding_dedup.materialize(embedding_dedup.plant(leaves))
        pairs = embedding_dedup.leaf_pairs(points.select("node").distinct(), levels, embedding_dedup.threshold_distance(0.9))
        count = planted.select("node").distinct().count()
        sent = embedding_dedup.dealt(planted, pairs.where("not whole"), held=count).count()
        assert sent <= n * (np.ceil(np.sqrt(count)) + 1) and sent < n * count / 2


def test_embedding_links_of_nothing(spark):
    assert embedding_dedup.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- url filter ---------------------------------------------------------------------------
def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [
        (len(h + p), len(h), h + p, action)
        for h, p, action in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_equal_brute_force(spark):
    r = random.Random(8)
    hosts = ["com", "Example.com", "www.example.com", "a.b.net", "net", "xnet", "ex.com:80", "u@example.com", "", "example.com.", "é.net"]
    paths = ["", "/", "/en/", "/EN/", "/en", "/en/x/y", "/es/1", "/fr/", "//en/", "/a b"]
    urls = [f"{r.choice(['http', 'https', '', 'x'])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=/en/', '#://a', '?'])}" for _ in range(500)]
    urls += [None, "", "example.com/en/", "http:/x", "://", "://com/", "http://a://b/c", "http://" + "a." * 500 + "net" + "/fr/" * 500]
    pages = spark.createDataFrame([(i % 400, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    more = [*url_filter.RULES, ("example.com", "/en", "allow"), ("EXAMPLE.com", "", "block"), ("a.b.net", "/e", "allow"), ("com", "/", "block")]
    for given in (url_filter.RULES, more):
        rules = spark.createDataFrame(given, "host string, path string, action string")
        known = {}
        for h, p, a in given:
            known[h.lower(), p] = max(a, known.get((h.lower(), p), "allow"))
        got = url_filter.judge_urls(pages, rules).collect()
        want = [(i % 400, u, *brute_url(u, [(h, p, a) for (h, p), a in known.items()])) for i, u in enumerate(urls)]
        assert sorted(((x.page_id, x.url, x.host, x.path, x.rule, x.verdict) for x in got), key=str) == sorted(want, key=str)
    none = url_filter.judge_urls(pages, spark.createDataFrame([], "host string, path string, action string"))
    assert {(x.rule, x.verdict) for x in none.collect()} == {(None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_rules_meet_urls_on_short_prefixes_of_digests(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    compiled = url_filter.compile_rules(rules).collect()
    assert {r.prefix for r in compiled} == {hashlib.sha256((h + p).encode()).hexdigest()[:8] for h, p, _ in url_filter.RULES}
