"""Quality rules: document statistics and gradient-boosted trees over them.

The statistics are computed per document in Arrow batches.  The trees are fitted in numpy
on at most about ``SAMPLE`` labelled documents (drawn by a hash of the id, so the same rows
at every run) and flattened into node arrays; scoring walks all trees for a whole batch at
once.  More repetition, symbols, shouting or repeated lines can never raise a score: the
model is constrained to fall with these features.

Defined cases: a null or empty text has zero words and fails the base rule.  Without any
label, or with labels of one kind only, the model keeps everything.  Repeated rows get
equal results; several labels of one document count as its smallest; extra columns stay,
those with a result's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm.common import add_columns, gram_hashes, word_hashes, words_of

SAMPLE = 20_000
THRESHOLD = 0.5
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
    "mark_share", "digit_share", "mean_line", "distinct_share", "long_word_share", "top_word_share",
]
#: -1: the score may only fall as the feature grows.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "mark_share": -1}


# --- statistics ---------------------------------------------------------------------------
def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur at least twice in the text."""
    grams = gram_hashes(hashes, window)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the features of FEATURES."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    hashes = word_hashes(words)
    repeats = repeated_words(hashes)
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
    marks = text.count("!") + text.count("?")
    sizes = np.fromiter(map(len, words), np.int64, n)
    _, times = np.unique(hashes, return_counts=True)
    return [n, chars, symbols, dup_lines, repeats], [
        float(np.log1p(n)), chars / n, symbols / chars, dup_lines / len(lines), repeats / n,
        float(upper / max(1, upper + lower)), marks / n, float(kinds[48:58].sum() / chars),
        n / len(lines), len(times) / n, float((sizes > 20).mean()), float(times.max() / n),
    ]


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the five counts, base_failed and the feature vector."""

    def compute(batch: pa.RecordBatch) -> list:
        made = [statistics(t) for t in batch.column("text").to_pylist()]
        counts = [[c[i] for c, _ in made] for i in range(len(COUNTS))]
        return [*counts, [base_failed(c) for c, _ in made], [f for _, f in made]]

    new = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, features array<double>"
    return add_columns(docs, compute, new)


# --- the model ----------------------------------------------------------------------------
@dataclass
class Trees:
    """All nodes of all trees: a leaf's children are itself, so walking it changes nothing."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32,
    smooth: float = 1.0, monotone: np.ndarray | None = None,
) -> Trees:
    """Histogram gradient boosting with log loss and monotonic constraints.

    A split on a constrained feature must order its two values; the mid of both then bounds
    everything below, so the whole tree, and with it the sum of trees, is monotonic.
    """
    n, width = x.shape
    monotone = np.zeros(width, int) if monotone is None else monotone
    share = float(np.clip(y.mean() if n else 1.0, 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(n, start)

        def grow(rows: np.ndarray, left: int, low: float, high: float) -> int:
            me = len(nodes)
            g, h = grad[rows], hess[rows]
            value = float(np.clip(-g.sum() / (h.sum() + smooth), low, high))
            nodes.append([0, np.inf, me, me, rate * value])
            best = (1e-6, None)
            for j in range(width) if left and len(rows) >= 40 else ():
                if not len(cuts[j]):
                    continue
                b = binned[rows, j]
                gs = np.cumsum(np.bincount(b, g, len(cuts[j]) + 1))
                hs = np.cumsum(np.bincount(b, h, len(cuts[j]) + 1))
                ns = np.cumsum(np.bincount(b, minlength=len(cuts[j]) + 1))
                gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                gr, hr, nr = gs[-1] - gl, hs[-1] - hl, ns[-1] - nl
                vl, vr = np.clip(-gl / (hl + smooth), low, high), np.clip(-gr / (hr + smooth), low, high)
                gain = -(gl * vl + (hl + smooth) * vl**2 / 2) - (gr * vr + (hr + smooth) * vr**2 / 2)
                gain += g.sum() * value + (h.sum() + smooth) * value**2 / 2
                fits = (nl >= 20) & (nr >= 20) & (monotone[j] * (vr - vl) >= 0)
                gain = np.where(fits, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, float(vl[k] + vr[k]) / 2))
            if best[1] is None:
                scores[rows] = rate * value
                return me
            j, k, mid = best[1]
            goes = binned[rows, j] <= k
            bounds = {0: ((low, high), (low, high)), -1: ((mid, high), (low, mid)), 1: ((low, mid), (mid, high))}
            for_left, for_right = bounds[int(monotone[j])]
            nodes[me][0], nodes[me][1] = j, float(cuts[j][k])
            nodes[me][2] = grow(rows[goes], left - 1, *for_left)
            nodes[me][3] = grow(rows[~goes], left - 1, *for_right)
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess, scores = p - y, p * (1 - p), np.zeros(n)
            roots.append(grow(np.arange(n), depth, -np.inf, np.inf))
            margin += scores
    if not nodes:
        nodes, roots = [[0, np.inf, 0, 0, 0.0]], [0]
    f, t, l, r, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(np.array(roots), f.astype(np.int64), t.astype(float), l.astype(np.int64), r.astype(np.int64), v.astype(float), depth, start)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` labelled documents, the same ones at every run: doc_id, text, quality."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    parts = 1_000_000
    kept = min(parts, parts * sample // max(1, labels.count()))
    drawn = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(parts)) < kept
    return docs.select("doc_id", "text").where(drawn).join(labels.where(drawn), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on the sample; only its feature rows (bounded by ``sample``) come to the driver."""
    rows = with_statistics(labelled_sample(docs, labels, sample)).select("doc_id", "features", "quality").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, rows["quality"].to_numpy(float), monotone=np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judge_quality(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with counts, base_failed, quality_score and kept."""

    def compute(batch: pa.RecordBatch) -> list:
        made = [statistics(t) for t in batch.column("text").to_pylist()]
        failed = np.array([base_failed(c) for c, _ in made], bool)
        x = np.array([f for _, f in made], float).reshape(-1, len(FEATURES))
        score = model.probability(x)
        counts = [[c[i] for c, _ in made] for i in range(len(COUNTS))]
        return [*counts, failed, score, ~failed & (score >= threshold)]

    new = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality_score double, kept boolean"
    return add_columns(docs, compute, new)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_quality(docs, model).select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")
