"""Toxicity by a bidirectional gated recurrent network with attention pooling, over characters and words of overlapping windows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, by_bytes, fold, hold, slim, table

#: At most about so many labelled texts of each label are learned from, of at most so many bytes each.
SAMPLE, LONGEST = 1500, 100_000
WINDOW, STRIDE = 32, 16
WORD_BUCKETS, GRAM_BUCKETS, GRAM = 1 << 14, 1 << 15, 4
#: Sizes of the embeddings (of each the first number is a log odds ratio to begin with) and of the states.
D, H = 6, 8
#: Rounds over the sample, and more if that makes fewer steps.
EPOCHS, STEPS, BATCH = 8, 400, 128
#: Words whose inputs a worker keeps.
CACHE = 300_000
PUNCTUATION = b".,;:!?\"'()[]{}|*#<>&$%"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' runs of four bytes, with marks at both ends, one word after the other; where each word's begin."""
    marked = [b"^" + w + b"$" * max(1, 3 - len(w)) for w in words]
    x = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    sizes = np.array([len(m) for m in marked])
    code = x[: len(x) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code = code * np.uint32(0x01000193) ^ x[k : len(x) - GRAM + 1 + k]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
    inside = np.ones(len(x), bool)
    ends = np.cumsum(sizes)
    for k in range(1, GRAM):
        inside[ends - k] = False
    return code[inside[: len(code)]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes - GRAM + 1)[:-1]])


def plain(word: bytes) -> bytes:
    return word.lower().strip(PUNCTUATION) or word


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """x(word) = embedding of the word, mean of those of its grams, largest log odds of a gram; a gated recurrent unit in either
    direction (gates z, r, n); attention pools the states; a logistic output."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = 2 * D + 1
        self.word, self.gram = rng.normal(0, 0.1, (WORD_BUCKETS, D)).astype(np.float32), rng.normal(0, 0.1, (GRAM_BUCKETS, D)).astype(np.float32)
        self.p = {
            "W": rng.normal(0, n**-0.5, (2, n, 3 * H)), "b": np.zeros((2, 1, 3 * H)), "U": rng.normal(0, H**-0.5, (2, H, 3 * H)),
            "v": rng.normal(0, 0.3, 2 * H), "o": rng.normal(0, 0.3, 2 * H), "c": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        code, starts = grams(words)
        sizes = np.diff(np.append(starts, len(code)))
        e = self.gram[code]
        w = np.array([zlib.crc32(x) % WORD_BUCKETS for x in words])
        return np.hstack([self.word[w], np.add.reduceat(e, starts) / sizes[:, None], np.maximum.reduceat(e[:, :1], starts)]).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of either direction; (2, words, 3 * H)."""
        return np.matmul(x[None], self.p["W"]) + self.p["b"]

    def states(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """States by time, (time, 2, windows, H), of windows of word numbers; the backward direction's in its own time."""
        n, h = len(ids), np.zeros((2, len(ids), H), np.float32)
        out, kept = np.empty((WINDOW, 2, n, H), np.float32), []
        U = self.p["U"]
        for t in range(WINDOW):
            g = np.stack([gates[0][ids[:, t]], gates[1][ids[:, WINDOW - 1 - t]]])
            u = np.matmul(h, U)
            zr = _sigmoid(g[..., : 2 * H] + u[..., : 2 * H])
            z, r = zr[..., :H], zr[..., H:]
            new = np.tanh(g[..., 2 * H :] + r * u[..., 2 * H :])
            if keep:
                kept.append((h, z, r, u[..., 2 * H :], new))
            h = new + z * (h - new)
            out[t] = h
        return out, kept

    def pooled(self, states, ids):
        """Attention's weights (time, windows), joined states (time, windows, 2 * H) and the output's log odds."""
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        e = both @ self.p["v"]
        e[ids.T == 0] = -1e4
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pool = np.einsum("tn,tnh->nh", a, both)
        return a, both, pool, pool @ self.p["o"] + self.p["c"][0]

    def logits(self, gates, ids) -> np.ndarray:
        out = np.empty(len(ids), np.float32)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            out[k : k + 2048] = self.pooled(self.states(gates, part)[0], part)[3]
        return out

    def gradients(self, x, ids, y):
        """Of the mean log loss of windows ids over words x (row 0 is padding): by parameter, and by row of x."""
        gates = padded(self.gates(x))
        states, kept = self.states(gates, ids, True)
        a, both, pool, logit = self.pooled(states, ids)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"o": pool.T @ d, "c": d.sum(keepdims=True)}
        dpool = d[:, None] * self.p["o"]
        da = np.einsum("nh,tnh->tn", dpool, both)
        de = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", de, both)
        dboth = a[..., None] * dpool + de[..., None] * self.p["v"]
        dstates = np.stack([dboth[..., :H], dboth[::-1, :, H:]], axis=1)
        dgates, gU, dh = np.zeros_like(gates), np.zeros_like(self.p["U"]), 0
        for t in range(WINDOW - 1, -1, -1):
            h, z, r, un, new = kept[t]
            dh = dh + dstates[t]
            dn = dh * (1 - z) * (1 - new**2)
            dg = np.concatenate([dh * (h - new) * z * (1 - z), dn * un * r * (1 - r), dn], axis=2)
            du = np.concatenate([dg[..., : 2 * H], dn * r], axis=2)
            gU += np.matmul(h.transpose(0, 2, 1), du)
            dh = dh * z + np.matmul(du, self.p["U"].transpose(0, 2, 1))
            np.add.at(dgates[0], ids[:, t], dg[0])
            np.add.at(dgates[1], ids[:, WINDOW - 1 - t], dg[1])
        dgates[:, 0] = 0
        g |= {"U": gU, "W": np.matmul(x.T[None], dgates), "b": dgates.sum(axis=1, keepdims=True)}
        return g, np.matmul(dgates, self.p["W"].transpose(0, 2, 1)).sum(axis=0)


def padded(gates: np.ndarray) -> np.ndarray:
    """Row 0 is padding: its gate z is shut, so that the state stays."""
    gates[:, 0] = 0
    gates[:, 0, :H] = 40
    return gates


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts (word numbers from 1; 0 pads the last), each of which begins STRIDE words after the one before,
    up to one that reaches the end; and where each text's begin. A text without words has one window of padding."""
    counts = np.array([1 + max(0, -(-(len(x) - WINDOW) // STRIDE)) for x in ids])
    spans = (counts - 1) * STRIDE + WINDOW
    flat = np.zeros(int(spans.sum()), np.int64)
    at = np.cumsum(spans) - spans
    for x, k in zip(ids, at):
        flat[k : k + len(x)] = x
    starts = np.cumsum(counts) - counts
    first = np.repeat(at, counts) + (np.arange(counts.sum()) - np.repeat(starts, counts)) * STRIDE
    return flat[first[:, None] + np.arange(WINDOW)], starts


def train(texts: list[bytes], y: np.ndarray, prior: float, seed: int = 1) -> Network:
    """By Adam on the windows that speak most for toxicity: of each text the one with the largest log odds of a gram at first,
    then the one that the network scores highest, and for texts of label 0 a second one by chance. The log odds are those of
    texts with a gram or word, by label. A fifth of the texts only serves to place the output, so that 0.3 is the threshold of
    the best F1 at the prior."""
    rng, net = np.random.default_rng(seed), Network(seed)
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(plain(w), len(number) + 1) for w in t.split()], np.int64) for t in texts]
    if len(set(y.tolist())) < 2:
        net.p = {k: v * 0 for k, v in net.p.items()}
        net.scale, net.shift = 0.0, 6.0 if len(y) and y[0] else -6.0
        return net
    words = [b"\0", *number]
    code, starts = grams(words)
    ends, w_bucket = np.append(starts[1:], len(code)), np.array([zlib.crc32(x) % WORD_BUCKETS for x in words])
    fits = rng.random(len(texts)) < 0.8
    for table_, of_word in ((net.gram, lambda u: np.concatenate([code[starts[k] : ends[k]] for k in u])), (net.word, lambda u: w_bucket[u])):
        seen = np.zeros((2, len(table_)))
        for x, label in zip((x for x, f in zip(ids, fits) if f), y[fits]):
            if len(x):
                seen[int(label), np.unique(of_word(np.unique(x)))] += 1
        n = [max(1, (y[fits] == k).sum()) for k in (0, 1)]
        table_[:, 0] = np.clip(np.log((seen[1] + 2) / (n[1] + 4)) - np.log((seen[0] + 2) / (n[0] + 4)), -4, 4) / 2

    def all_gates():
        return padded(net.gates(net.inputs(words)))

    every, first = windows(ids)
    last = np.append(first[1:], len(every))
    signal = net.inputs(words)[:, -1] + net.inputs(words)[:, 0]
    signal[0] = -9
    score = signal[every].max(axis=1)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, chosen_texts = 0, np.flatnonzero(fits)
    batches = -(-int(fits.sum() + (fits & (y == 0)).sum()) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // max(1, batches)))
    for epoch in range(epochs):
        if epoch and epoch % max(2, epochs // 4) == 0:
            some = np.concatenate([np.arange(first[k], last[k]) for k in chosen_texts])
            score[some] = net.logits(all_gates(), every[some])
        pick = [(first[k] + score[first[k] : last[k]].argmax(), y[k]) for k in chosen_texts]
        pick += [(rng.integers(first[k], last[k]), 0) for k in chosen_texts if not y[k]]
        pick = [pick[k] for k in rng.permutation(len(pick))]
        for at in range(0, len(pick), BATCH):
            part = every[[p[0] for p in pick[at : at + BATCH]]]
            used, local = np.unique(np.append(0, part), return_inverse=True)
            x = net.inputs([words[k] for k in used])
            g, dx = net.gradients(x, local[1:].reshape(part.shape), np.array([p[1] for p in pick[at : at + BATCH]], np.float32))
            step += 1
            for k, v in net.p.items():
                m[k][0] += 0.1 * (g[k] - m[k][0])
                m[k][1] += 0.001 * (g[k] ** 2 - m[k][1])
                v -= (0.01 * m[k][0] / (1 - 0.9**step) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
            np.add.at(net.word, w_bucket[used[1:]], -0.3 * dx[1:, :D])
            sizes = ends[used[1:]] - starts[used[1:]]
            np.add.at(net.gram, np.concatenate([code[starts[k] : ends[k]] for k in used[1:]]), np.repeat(-0.3 * dx[1:, D : 2 * D] / sizes[:, None], sizes, axis=0))
    held = np.flatnonzero(~fits) if 0 < y[~fits].sum() < (~fits).sum() else np.arange(len(y))
    gates = all_gates()
    logit = np.array([net.logits(gates, every[first[k] : last[k]]).max() for k in held])
    weight = np.where(y[held] == 1, prior / max(1, (y[held] == 1).sum()), (1 - prior) / max(1, (y[held] == 0).sum()))
    order = np.argsort(-logit)
    hit, miss = np.cumsum((weight * y[held])[order]), np.cumsum((weight * (1 - y[held]))[order])
    k = int((2 * hit / (prior + hit + miss)).argmax())
    cut = (logit[order][k] + logit[order][min(k + 1, len(order) - 1)]) / 2
    net.shift = float(np.log(0.3 / 0.7) - cut)
    return net


class Scorer:
    def __init__(self, net: Network):
        self.net, self.number = net, {}
        self.gates = np.zeros((2, 1, 3 * H), np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        cut = [t.split() for t in texts]
        if len(self.number) > CACHE:
            self.number, self.gates = {}, self.gates[:, :1]
        new = list(set().union(*cut).difference(self.number))
        parts = [self.gates]
        for at in range(0, len(new), 20_000):
            parts.append(self.net.gates(self.net.inputs([plain(w) for w in new[at : at + 20_000]])))
        self.number.update(zip(new, range(self.gates.shape[1], self.gates.shape[1] + len(new))))
        self.gates = padded(np.concatenate(parts, axis=1)) if new else padded(self.gates)
        get = self.number.__getitem__
        every, first = windows([np.fromiter(map(get, words), np.int64, len(words)) for words in cut])
        best = np.maximum.reduceat(self.net.logits(self.gates, every), first)
        return _sigmoid(np.clip((best.astype(float) if self.net.scale else best * 0.0) + self.net.shift, -30, 30))


_scorers: dict[bytes, Scorer] = {}


def _scorer(net: Network) -> Scorer:
    """The worker's scorer of this network, which keeps words from task to task."""
    hold("toxicity", _scorers.clear)
    key = hashlib.md5(b"".join(v.tobytes() for v in (net.word, net.gram, *net.p.values(), np.array([net.scale, net.shift])))).digest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(net)
    return _scorers[key]


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each of docs (doc_id, text): the score is that of the text's most toxic
    window, and every word is in one at least.

    Learned from labels (doc_id, toxic) of texts whose crc32(doc_id as text) mod `folds` isn't `held_out_fold`: about `sample`
    texts of each label. Null or empty text: a window of padding, scored like any other. Null doc_id: never labelled, crc32 of
    the empty text decides its fold. Repeated rows are scored alike. With labels of one kind only, every score is the same: low
    for 0, high for 1; without labels low.
    """
    known = slim(labels, "doc_id", "toxic").where(fold(F.col("doc_id"), folds) != held_out_fold)
    counts = dict(known.where("toxic IS NOT NULL").groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect())
    picked = F.broadcast(bounded_sample(known, "toxic", sample))
    rows = slim(docs, "doc_id", "text").where(F.octet_length("text") <= LONGEST).join(picked, "doc_id").select(F.col("toxic").cast("bigint").alias("toxic"), "text").toArrow()
    pairs = sorted(zip(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("toxic").to_pylist()))
    net = train([t for t, _ in pairs], np.array([int(v > 0) for _, v in pairs], np.float32), counts.get(1, 0) / max(1, sum(counts.values())))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        scorer = _scorer(shared.value)
        for b, texts in by_bytes(batches, 1, 1_000_000):
            score = scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    held = fold(F.col("doc_id"), folds) == held_out_fold
    return slim(docs, "doc_id", "text").withColumn("held_out", held).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
