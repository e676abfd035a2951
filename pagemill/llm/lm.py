"""Language-model scoring: a log-bilinear model over classes of words, trained with noise-contrastive estimation, and exact
smoothed unigrams of all words."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, fold, hold, slim, store, table

#: At most so many of the most frequent words, of at most so many bytes each, are sent to every worker with their counts; all others
#: meet theirs in a join.
HOT, HOT_BYTES = 262_144, 64
#: Classes: the most frequent words each have their own, all others share one with those that end in the same letters, by hash.
OWN, SHARED, SUFFIX = 384, 128, 3
CLASSES = OWN + SHARED
#: Words of context, sizes of the vectors, noise samples of a batch, positions in a batch.
CONTEXT, SIZE, NOISE, BATCH = 5, 24, 96, 1536
#: Training takes every text, with all its positions, in just one of so many rounds, and the tasks' parameters are averaged.
ROUNDS, RATE = 2, 0.5
MERGES = 64
#: Bytes of text after which a task's table of counts is sent, so that long words don't fill it.
FLUSH = 128_000_000


def _class_of(word: bytes) -> int:
    return OWN + zlib.crc32(word[-SUFFIX:]) % SHARED


def count_words(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """word (binary; empty for the end of a text), n: counts over all rows of texts (text). Tasks count in tables of at most
    `most` words, so that each sends a word once or a few times."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()
        size = 0

        def flush():
            words, n = list(counts), list(counts.values())
            counts.clear()
            for k in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.binary()), pa.array(n[k : k + 50_000], pa.int64())], schema=schema)

        for _, some in by_bytes(batches, 0):
            for t in some:
                counts.update(t.lower().split())
                size += len(t)
            counts[b""] += len(some)
            if len(counts) > most or size > FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """What every worker has: the frequent words with counts and classes, and for each class the logarithm of the divisor with
    which a word's share of it is smoothed (0 for classes of one word)."""

    def __init__(self, words: list[bytes], counts: np.ndarray, shared_n: np.ndarray, shared_v: np.ndarray, total: int, distinct: int):
        self.words, self.counts = words, counts
        self.classes = np.array([k if k < OWN else _class_of(w) for k, w in enumerate(words)], np.int64)
        self.log_all = math.log10(total + 0.5 * (distinct + 1))
        divisors = np.concatenate([np.ones(OWN), shared_n + 0.5 * (shared_v + 1)])
        self.log_class = np.log10(divisors)
        self.log_counts = np.log10(counts + 0.5)
        mass = np.zeros(CLASSES)
        mass[: min(OWN, len(words))] = counts[:OWN]
        mass[OWN:] = shared_n
        self.unigram = (mass + 0.5) / (mass + 0.5).sum()
        self.key = hashlib.md5(b"\n".join(words) + counts.tobytes()).digest()


class _Numbers(dict):
    def __missing__(self, word):
        return -1


_numbers: dict[bytes, _Numbers] = {}


def _lookup(words: Words) -> _Numbers:
    hold("lm", _numbers.clear)
    if words.key not in _numbers:
        _numbers.clear()
        _numbers[words.key] = _Numbers(zip(words.words, range(len(words.words))))
    return _numbers[words.key]


_places = np.arange((CLASSES + 1) * SIZE).reshape(CLASSES + 1, SIZE)


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the values of each of n rows."""
    return np.bincount(_places.take(rows, axis=0).ravel(), values.ravel(), n * SIZE).reshape(n, SIZE)


class Model:
    """Scores of the next class: (sum over the context of position's weights * vector of that class) . vector of the next + bias.
    One more context class stands for what is before the text. Texts come as one run of classes, each behind CONTEXT of that
    class, so that what is in the context of each position is found by shifting the run's vectors."""

    def __init__(self, unigram: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.1, (CLASSES + 1, SIZE)), np.ones((CONTEXT, SIZE)) / CONTEXT, rng.normal(0, 0.1, (CLASSES, SIZE)), np.log(unigram)]
        self.unigram = unigram

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.p:
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def contexts(self, vectors: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each position from CONTEXT on the weighted sum of the vectors before it."""
        n = len(vectors)
        h = vectors[CONTEXT - 1 : n - 1] * w[0]
        for j in range(1, CONTEXT):
            h += vectors[CONTEXT - 1 - j : n - 1 - j] * w[j]
        return h

    def gradients(self, run: np.ndarray, noise: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Of the noise-contrastive loss over all positions of a run of texts, which share the noise: by parameter, for the mean
        position; and the number of positions."""
        r, w, q, b = (x.astype(np.float32) for x in self.p)
        target = run[CONTEXT:]
        n, valid = len(run), target < CLASSES
        if not (positions := int(valid.sum())):
            return [], 0
        goal, valid = np.where(valid, target, 0), valid.astype(np.float32)
        offset = (self.p[3] - np.log(len(noise) * self.unigram)).astype(np.float32)
        vectors, wanted, drawn = r[run], q[goal], q[noise]
        h = self.contexts(vectors, w)
        true = (1 / (1 + np.exp(-(np.einsum("nd,nd->n", h, wanted) + offset[goal]))) - 1) * valid
        false = h @ drawn.T
        false += offset[noise]
        np.negative(false, out=false)
        np.exp(false, out=false)
        false += 1
        np.divide(valid[:, None], false, out=false)
        dh = (true[:, None] * wanted + false @ drawn) / np.float32(positions)
        dv, dw = np.zeros_like(vectors), np.empty_like(w)
        for j in range(CONTEXT):
            dv[CONTEXT - 1 - j : n - 1 - j] += dh * w[j]
            dw[j] = np.einsum("nd,nd->d", vectors[CONTEXT - 1 - j : n - 1 - j], dh)
        dq = _summed(goal, true[:, None] * h, CLASSES) + _summed(noise, false.T @ h, CLASSES)
        return [_summed(run, dv, CLASSES + 1), dw, dq / positions, (np.bincount(goal, true, CLASSES) + np.bincount(noise, false.sum(axis=0), CLASSES)) / positions], positions

    def train(self, run: np.ndarray, grown: list[np.ndarray], rng) -> int:
        """A step by Adagrad, with noise from the unigrams; the number of positions."""
        g, positions = self.gradients(run, rng.choice(CLASSES, NOISE, p=self.unigram))
        for x, d, s in zip(self.p, g, grown):
            s += d * d
            x -= RATE * d / (np.sqrt(s) + 1e-4)
        return positions

    def log10(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of flat[at] (at rises), by batched products with all classes' vectors."""
        r, w, q, b = (x.astype(np.float32) for x in self.p)
        qt = np.ascontiguousarray(np.vstack([q.T, b]))
        out = np.empty(len(at), np.float32)
        block = 1024
        held, products, ones = np.ones((block, SIZE + 1), np.float32), np.empty((block, CLASSES), np.float32), np.ones(CLASSES, np.float32)
        for k in range(0, len(at), block):
            pos = at[k : k + block]
            first = pos[0] - CONTEXT
            held[: len(pos), :-1] = self.contexts(r[flat[first : pos[-1] + 1]], w)[pos - pos[0]]
            logits = np.matmul(held[: len(pos)], qt, out=products[: len(pos)])
            true = logits[np.arange(len(pos)), flat[pos]]
            np.exp(logits, out=logits)
            out[k : k + block] = true - np.log(logits @ ones)
        return out / np.float32(math.log(10))


def _classes(words: Words, ids: np.ndarray, cut: list[bytes]) -> np.ndarray:
    out = words.classes[ids] if len(words.words) else np.zeros(len(ids), np.int64)
    for k in np.flatnonzero(ids < 0).tolist():
        out[k] = _class_of(cut[k])
    return out


def train_model(texts: DataFrame, shared, unigram: np.ndarray, rounds: int = ROUNDS) -> Model:
    """texts (text, turn): each round, every task goes on from the same parameters over its own texts of that turn, and the results
    are averaged by the number of positions: partial sums in MERGES tasks, then those on the driver. After the last round every
    position of every text was a target once."""
    spark, model = texts.sparkSession, Model(unigram)

    def learn(start: np.ndarray, turn: int):
        def run(batches):
            words = shared.value
            number, m = _lookup(words), Model(words.unigram)
            m.load(start)
            rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
            grown, n, held, size = [np.full_like(x, 1e-3) for x in m.p], 0, [], 0
            pad = np.full(CONTEXT, CLASSES)

            def steps(most: int):
                """Trains on runs of the held texts; what is left of the last one waits, but for most = 0."""
                nonlocal n, size
                flat = np.concatenate(held)
                starts = np.arange(CONTEXT, len(flat), BATCH)
                if most:
                    starts = starts[starts + BATCH <= len(flat)]
                for k in rng.permutation(starts):
                    n += m.train(flat[k - CONTEXT : k + BATCH], grown, rng)
                left = int(starts[-1]) + BATCH - CONTEXT if most else len(flat)
                held[:] = [flat[left:]]
                size = len(held[0])

            for _, some in by_bytes(batches, 0):
                for t in some:
                    cut = t.lower().split() + [b""]
                    ids = np.fromiter(map(number.__getitem__, cut), np.int64, len(cut))
                    held += [pad, _classes(words, ids, cut)]
                    size += CONTEXT + len(cut)
                    if size >= 16 * BATCH + CONTEXT:
                        steps(BATCH)
            if size:
                steps(0)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(m.flat() * n).tobytes()], pa.binary())], names=["n", "p"])

        return run

    def add(batches):
        n, total = 0, 0.0
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1)):
                n, total = n + k, total + np.frombuffer(p.as_buffer())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "p"])

    kind = "n bigint, p binary"
    for turn in range(rounds):
        found = texts.where(F.col("turn") == turn).select("text").mapInArrow(learn(model.flat(), turn), kind).repartition(MERGES).mapInArrow(add, kind).toArrow()
        if found.num_rows:
            model.load(sum(np.frombuffer(p.as_buffer()) for c in found.column("p").chunks for p in c) / sum(found.column("n").to_pylist()))
    return model


def score_texts(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each of docs (doc_id, text and any more).

    Texts are lower-cased (A-Z); tokens are words and then one end. Learned from the texts whose crc32(doc_id as text) mod
    `folds` isn't `held_out_fold`. base_score: log10 probability by add-half unigrams of the training tokens, one share for all
    unknown words. score: by the model, P(class | five words before) times the word's add-half share of its class, again with
    one share of each class for its unknown words. So both are proper distributions over the known words and the unknown.

    Counts are exact and of all training texts. The most frequent words (at most `hot`, of at most HOT_BYTES each) are broadcast;
    the others, each no more than a small share of all tokens, meet their counts in a shuffled join, so that the vocabulary may grow without bound.
    Null or empty text: the end alone. Null doc_id: its crc32 is that of the empty text. Repeated rows are scored alike and all
    returned. Without training texts N and V are 0 and the classes' model is what it begins with.
    """
    spark = docs.sparkSession
    rows = slim(docs, "doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), folds) == held_out_fold)
    training = rows.where("NOT held_out").select("text", F.pmod(F.xxhash64(F.lit("turn"), "doc_id", "text"), F.lit(ROUNDS)).alias("turn"))
    counts = store(count_words(training), "counts")
    level = F.floor(F.log2("n") * 16)
    short = F.octet_length("word") <= HOT_BYTES
    sums = counts.groupBy(level.alias("level")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).orderBy(F.desc("level")).collect()
    total, distinct, seen, lowest = sum(r["n"] for r in sums), sum(r["v"] for r in sums), 0, 1 << 60
    for r in sums:
        if (seen := seen + r["v"]) > hot:
            break
        lowest = r["level"]
    top = counts.where((level >= lowest) & short).toArrow()
    order = np.argsort(-top.column("n").to_numpy(), kind="stable")
    pairs = list(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))
    pairs = sorted((pairs[k] for k in order), key=lambda x: (-x[1], x[0]))
    shared_n, shared_v = np.zeros(SHARED), np.zeros(SHARED)
    for r in counts.groupBy((F.crc32(F.when(F.length("word") > SUFFIX, F.substring("word", -SUFFIX, SUFFIX)).otherwise(F.col("word"))) % SHARED).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        shared_n[r["c"]], shared_v[r["c"]] = r["n"], r["v"]
    for w, n in pairs[:OWN]:
        shared_n[_class_of(w) - OWN] -= n
        shared_v[_class_of(w) - OWN] -= 1
    words = Words([w for w, _ in pairs], np.array([n for _, n in pairs], float), shared_n, shared_v, total, distinct)
    shared = spark.sparkContext.broadcast(words)
    model = train_model(training, shared, words.unigram)
    scorer = spark.sparkContext.broadcast(model)
    names = ["word", "doc_id", "text_key", "held_out", "n", "tokens", "known", "base", "score"]
    schema = pa.schema(list(zip(names, [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])))

    def run(batches):
        words, model = shared.value, scorer.value
        number = _lookup(words)
        get = number.__getitem__
        for b, texts in by_bytes(batches, 1):
            flats, cuts, idss, sizes = [], [], [], []
            pad = np.full(CONTEXT, CLASSES)
            for t in texts:
                cut = t.lower().split() + [b""]
                ids = np.fromiter(map(get, cut), np.int64, len(cut))
                cuts.append(cut)
                idss.append(ids)
                flats += [pad, _classes(words, ids, cut)]
                sizes.append(len(cut))
            sizes = np.array(sizes)
            flat = np.concatenate(flats)
            ends = np.cumsum(sizes + CONTEXT)
            first = ends - sizes
            at = np.flatnonzero(np.repeat(np.tile([False, True], len(sizes)), np.column_stack([np.full(len(sizes), CONTEXT), sizes]).ravel()))
            logs = model.log10(flat, at)
            ids, cls = np.concatenate(idss), flat[at]
            known = ids >= 0
            count = np.where(known, words.log_counts[np.maximum(ids, 0)] if len(words.words) else 0, 0)
            base = np.where(known, count - words.log_all, 0)
            score = logs + np.where(known & (cls >= OWN), count - words.log_class[cls], 0)
            begin = np.cumsum(sizes) - sizes
            base, score, n_known = (np.add.reduceat(x, begin) for x in (base, score.astype(float), known.astype(np.int64)))
            out = []
            for k, (doc_id, key, held) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                out.append((b" %d %d" % (doc_id or 0, key), doc_id, key, held, 0, int(sizes[k]), int(n_known[k]), float(base[k]), float(score[k])))
                cut = cuts[k]
                for w, n in Counter(cut[j] for j in np.flatnonzero(idss[k] < 0).tolist()).items():
                    out.append((w, doc_id, key, held, n, 0, 0, -words.log_all, -words.log_class[_class_of(w)]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"), "held_out")
    parts = keyed.mapInArrow(run, "word binary, doc_id bigint, text_key bigint, held_out boolean, n bigint, tokens bigint, known bigint, base double, score double")
    rare = counts.where((level < lowest) | ~short).select("word", F.col("n").alias("c"))
    seen = parts.join(rare, "word", "left")
    is_text, log = F.col("tokens") > 0, F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    by_text = seen.groupBy("doc_id", "text_key", "held_out").agg(
        F.sum(is_text.cast("bigint")).alias("copies"),
        F.sum(F.when(is_text, F.col("tokens")).otherwise(0)).alias("n_tokens"),
        F.sum(F.when(is_text, F.col("known")).otherwise(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.when(is_text, F.col("base")).otherwise(F.col("n") * (log + F.col("base")))).alias("base_score"),
        F.sum(F.when(is_text, F.col("score")).otherwise(F.col("n") * (log + F.col("score")))).alias("score"),
    )
    each = by_text.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return each.select(
        "doc_id", "held_out", (F.col("n_tokens") / F.col("copies")).cast("bigint").alias("n_tokens"), (F.col("n_known") / F.col("copies")).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op1_lm_score": op1_lm_score}
ORACLE: dict[str, str] = {}
