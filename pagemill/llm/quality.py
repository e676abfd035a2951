"""Quality rules: gradient-boosted trees over document statistics, as flat arrays, monotone in chosen features."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bounded_sample, by_bytes, map_texts, out_batch, slim, table

SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = b"!\"'()+,-./:;=?@[\\]^_`{|}~#*$%&<>"
#: Features, and for each whether quality may only rise (1) or fall (-1) with it, or either (0).
FEATURES = {
    "words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": 0, "digit_share": 0, "mark_share": 0, "words_a_line": 0, "top_word_share": -1,
}
#: At most about so many labelled rows of each label are used to fit the trees.
SAMPLE = 3000
#: Documents whose probability of good quality is under this are not kept.
VERDICT = 0.5
MIN_WORDS, MAX_REPEAT = 50, 50


def statistics(text: bytes) -> tuple[tuple[int, int, int, int, int], tuple[float, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of a text, in one pass over its words."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, bytes(range(0x80, 0xC0)) + SPACES))  # bytes that continue a code point don't count
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat, distinct, top = 0, 0, 0
    if n:
        numbers = defaultdict(itertools.count().__next__)
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
        distinct, top = len(numbers), int(np.bincount(ids).max())
        if n > 3:
            v = np.int64(distinct)
            pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1] if distinct > 2_000_000 else ids[:-1] * v + ids[1:]
            keys = pairs[:-1] * v + ids[2:]
            order = np.argsort(keys, kind="stable")
            same = keys[order[1:]] == keys[order[:-1]]
            marked = np.zeros(n + 2, bool)
            for side in (order[1:][same], order[:-1][same]):
                for k in range(3):
                    marked[side + k] = True
            repeat = int(marked.sum())
    size = max(1, len(text))
    share = lambda drop: (len(text) - len(text.translate(None, drop))) / size
    m = max(1, n)
    return (n, chars, symbols, dup, repeat), (n, chars / m, symbols / max(1, chars), dup / max(1, len(lines)), repeat / m, distinct / m, share(UPPER), share(DIGITS), share(MARKS), n / max(1, len(lines)), top / m)


class Trees:
    """Boosted trees in flat arrays: of each node its feature (-1: a leaf), threshold (left if not above), left child (the right
    one is next to it) and value; roots has the first node of each tree."""

    def __init__(self, roots, feature, threshold, left, value, base):
        self.roots, self.feature, self.threshold, self.left, self.value, self.base = roots, feature, threshold, left, value, base

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, for each row; all trees go down a level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            if (f < 0).all():
                break
            down = self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at])
            at = np.where(f < 0, at, down)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Gradient boosting for log loss on histograms. A split on a monotone feature that would order its sides' values the wrong
    way is refused, and the middle between them bounds all values below either side; so every tree, and their sum, is monotone."""
    rate_of = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    roots, feature, threshold, left, value = [], [], [], [], []
    if len(y) < 2 * least or len(np.unique(y)) < 2:
        roots, feature, threshold, left, value = [0], [-1], [0.0], [0], [0.0]
    else:
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        coded = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
        score = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)

            def grow(rows, node, low, high, level):
                G, H = g[rows].sum(), h[rows].sum()
                w = float(np.clip(-G / (H + ridge), low, high))
                best = (1e-3, None)
                if level < depth and len(rows) >= 2 * least:
                    for k, e in enumerate(edges):
                        if not len(e):
                            continue
                        c = coded[rows, k]
                        gl, hl, nl = (np.bincount(c, weights, len(e) + 1).cumsum()[:-1] for weights in (g[rows], h[rows], np.ones(len(rows))))
                        wl, wr = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (G - gl, H - hl)))
                        loss = lambda a, b, v: a * v + 0.5 * (b + ridge) * v * v
                        gain = loss(G, H, w) - loss(gl, hl, wl) - loss(G - gl, H - hl, wr)
                        gain[(nl < least) | (len(rows) - nl < least) | (monotone[k] * (wr - wl) < 0)] = -1
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (gain[j], (k, j, e[j], (wl[j] + wr[j]) / 2))
                if best[1] is None:
                    value[node] = rate * w
                    score[rows] += rate * w
                    return
                k, j, cut, middle = best[1]
                feature[node], threshold[node], left[node] = k, cut, len(feature)
                for a in (feature, threshold, left, value):
                    a += [-1 if a is feature else 0] * 2
                goes = coded[rows, k] <= j
                sides = ((low, middle), (middle, high)) if monotone[k] > 0 else ((middle, high), (low, middle)) if monotone[k] < 0 else ((low, high),) * 2
                for side, (part, bounds) in enumerate(zip((rows[goes], rows[~goes]), sides)):
                    grow(part, left[node] + side, *bounds, level + 1)

            roots.append(len(feature))
            for a in (feature, threshold, left, value):
                a.append(-1 if a is feature else 0)
            grow(np.arange(len(y)), roots[-1], -np.inf, np.inf, 0)
    return Trees(np.array(roots), np.array(feature), np.array(threshold, float), np.array(left), np.array(value, float), base)


def _described(docs: DataFrame, label: str) -> pa.Table:
    """The features of a bounded sample, on the driver, computed by the executors."""
    fields = [("label", pa.int64())] + [(f, pa.float64()) for f in FEATURES]

    def run(batches):
        for b, texts in by_bytes(batches, 1):
            rows = [statistics(t)[1] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.float64()) for c in zip(*rows))], schema=pa.schema(fields))

    return docs.select(F.col(label).cast("bigint").alias("label"), "text").mapInArrow(run, "label bigint, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted to labels (doc_id, quality) of docs (doc_id, text), on about `sample` rows of each label, weighed alike."""
    picked = F.broadcast(bounded_sample(slim(labels, "doc_id", "quality"), "quality", sample))
    t = _described(slim(docs, "doc_id", "text").join(picked, "doc_id"), "quality")
    x = np.column_stack([t.column(f).to_numpy() for f in FEATURES]) if t.num_rows else np.empty((0, len(FEATURES)))
    return fit(x, (t.column("label").to_numpy() > 0).astype(float) if t.num_rows else np.empty(0), list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, verdict: float = VERDICT, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept: a row for each of docs.

    base_failed: fewer than 50 words, or over half of them in repeated windows of three. quality: probability of a good label by
    the trees. kept: not base_failed, and quality >= verdict. Null or empty text: no words, so it fails. Without labels of both
    kinds the trees are a constant, that of the labels there are (or a half), so the base alone decides. Null doc_id: a row like
    others, but never labelled. Repeated rows are scored alike; repeated labels count as often as they are there.
    With carry, row has the columns of docs.
    """
    model = fit_quality(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("quality", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        trees = shared.value
        for b, texts in by_bytes(batches, 1):
            counts, features = zip(*(statistics(t) for t in texts))
            counts, good = np.array(counts, np.int64), trees.probability(np.array(features, float))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT * counts[:, 0])
            yield out_batch(b, schema, [b.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(good), pa.array(~failed & (good >= verdict))], carry)

    return map_texts(docs, run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, quality double, kept boolean", carry)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE: dict[str, str] = {}
