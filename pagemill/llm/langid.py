"""Language identification by unigrams of pieces, with all segmentations of a word summed."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, by_bytes, fold, hold, map_texts, out_batch, table

#: At most about so many texts of each language are learned from; of a longer text than so many bytes, its beginning.
SAMPLE, LONGEST = 1200, 100_000
#: Of the sample's distinct words, so many of each language, the most frequent, go into the estimate.
WORDS = 30_000
#: Words of up to so many characters are summed as they are, where doubles reach; longer ones in logarithms, with the same result,
#: STRIP beginnings of a piece at a time.
SHORT, STRIP = 24, 200_000
#: Rounds of expectation and maximisation; pseudo-count of each piece; probability of a character that no piece has.
ROUNDS, PSEUDO, UNKNOWN = 3, 0.02, 1e-7
#: Words whose scores a worker keeps, with up to 8 languages; fewer with more.
CACHE = 700_000
UND = "und"
_vocabularies: dict[str, dict[str, int]] = {}
_beginnings: dict[int, tuple[dict[str, int], dict[str, int]]] = {}


def public_vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def block(languages: int) -> int:
    """Short words whose tables of prefixes are held at once: fewer, the more languages there are."""
    return max(64, 160_000 // max(8, languages))


def vocabulary(path: str) -> dict[str, int]:
    """All pieces of a public vocabulary, by number; 0 is for characters that no piece has."""
    if path not in _vocabularies:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
        _vocabularies[path] = {p: k for k, p in enumerate(sorted(set(pieces)), 1)}
    return _vocabularies[path]


def beginnings(pieces: dict[str, int]) -> dict[str, int]:
    """The pieces' numbers, and 0 for each beginning of a piece that isn't one."""
    if id(pieces) not in _beginnings:
        _beginnings.clear()
        _beginnings[id(pieces)] = pieces, {p[:n]: 0 for p in pieces for n in range(1, len(p))} | pieces
    return _beginnings[id(pieces)][1]


def lattice(words: list[str], pieces: dict[str, int], first: int = 0, last: int | None = None) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray]:
    """The places of all pieces that begin from `first` on and before `last` in the words: (end, n, rows, ids) by rising beginning,
    for the words that have there a piece of n characters, whatever n (for n = 1, 0 stands for an unknown character); and the
    words' lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    get = beginnings(pieces).get
    found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for r, w in enumerate(words):
        size = len(w)
        for start in range(first, size if last is None else min(size, last)):
            end = start + 1
            k = get(w[start])
            if not k:
                rows, ids = found.setdefault((start, 1), ([], []))
                rows.append(r)
                ids.append(0)
            while k is not None:
                if k:
                    rows, ids = found.setdefault((start, end - start), ([], []))
                    rows.append(r)
                    ids.append(k)
                end += 1
                if end > size:
                    break
                k = get(w[start:end])
    return [(start + n, n, np.array(found[start, n][0], np.int32), np.array(found[start, n][1], np.int32)) for start, n in sorted(found)], sizes


def forward(places: list, sizes: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word and language the log of the sum, over all segmentations into pieces, of the product of their probabilities;
    and the table of prefixes, alpha[end, word, language]. probability[0] is that of an unknown character, for a piece alone.
    Doubles reach: words have at most SHORT characters."""
    n = len(sizes)
    alpha = np.zeros((int(sizes.max(initial=1)) + 1, n, probability.shape[1]))
    alpha[0] = 1
    for end, k, rows, ids in places:
        alpha[end, rows] += alpha[end - k, rows] * probability[ids]
    return np.log(alpha[sizes, np.arange(n)]), alpha


def expected(places, sizes, probability, weights) -> np.ndarray:
    """Expected counts of the pieces by language over all segmentations (forward and backward); weights[word, language]."""
    n = len(sizes)
    _, alpha = forward(places, sizes, probability)
    beta = np.zeros_like(alpha)
    beta[sizes, np.arange(n)] = weights / alpha[sizes, np.arange(n)]
    counts = np.zeros_like(probability)
    for end, k, rows, ids in reversed(places):
        p = probability[ids] * beta[end, rows]
        np.add.at(counts, ids, alpha[end - k, rows] * p)
        beta[end - k, rows] += p
    return counts


def forward_logs(words: list[str], pieces: dict[str, int], logs: np.ndarray) -> np.ndarray:
    """What forward() gives, for words of any length: in logarithms, with only the last prefixes and one strip of places held."""
    sizes, turn = np.array([len(w) for w in words]), max(map(len, pieces), default=1) + 1
    table, out = np.full((turn, len(words), logs.shape[1]), -np.inf), np.zeros((len(words), logs.shape[1]))
    table[0] = 0
    ended = {n: np.flatnonzero(sizes == n) for n in set(sizes.tolist())}
    strip = max(64, STRIP // len(words))
    for first in range(0, int(sizes.max()), strip):
        places, _ = lattice(words, pieces, first, first + strip)
        for start, here in groupby(places, lambda x: x[0] - x[1]):
            before = table[start % turn]
            for end, _, rows, ids in here:
                at = table[end % turn]
                at[rows] = np.logaddexp(at[rows], before[rows] + logs[ids])
            before[:] = -np.inf
            if start + 1 in ended:
                out[ended[start + 1]] = table[(start + 1) % turn, ended[start + 1]]
    return out


def expected_logs(places, sizes, logs, weights) -> np.ndarray:
    """What expected() gives, for words of any length."""
    n = len(sizes)
    alpha = np.full((int(sizes.max(initial=1)) + 1, n, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for end, k, rows, ids in places:
        alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - k, rows] + logs[ids])
    beta = np.full_like(alpha, -np.inf)
    with np.errstate(divide="ignore"):
        beta[sizes, np.arange(n)] = np.log(weights) - alpha[sizes, np.arange(n)]
    counts = np.zeros_like(logs)
    for end, k, rows, ids in reversed(places):
        p = logs[ids] + beta[end, rows]
        np.add.at(counts, ids, np.exp(alpha[end - k, rows] + p))
        beta[end - k, rows] = np.logaddexp(beta[end - k, rows], p)
    return counts


def marked(word: str) -> str:
    """The word in lower case behind the mark of a word's beginning."""
    return "▁" + word.lower()


def runs(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of words, given their lengths by rising length: the longest of a range times their number is at most `most`, or the
    range is one word."""
    out, start = [], 0
    for k, n in enumerate(lengths):
        if k > start and (n + 1) * (k + 1 - start) > most:
            out.append((start, k))
            start = k
    return out + [(start, len(lengths))] * (start < len(lengths))


class Model:
    def __init__(self, languages: list[str], prior: np.ndarray, probability: np.ndarray):
        self.languages, self.prior, self.probability = languages, prior, probability


def learn(texts: list[tuple[str, str]], path: str, most: int = WORDS) -> Model | None:
    """From pairs (language, text), and of each language the `most` most frequent words. None without any text."""
    words: dict[str, Counter] = {}
    for lang, text in texts:
        words.setdefault(lang, Counter()).update(map(marked, text.split()))
    if not words:
        return None
    languages, pieces = sorted(words), vocabulary(path)
    kept = [dict(sorted(words[lang].items(), key=lambda x: (-x[1], x[0]))[:most]) for lang in languages]
    distinct = sorted(set().union(*kept), key=lambda w: (max(len(w), SHORT), w)) or ["▁"]
    short = sum(len(w) <= SHORT for w in distinct)
    number = {w: k for k, w in enumerate(distinct)}
    rows = np.array([number[w] for k in kept for w in k], np.int64)
    columns, values = np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.array([n for k in kept for n in k.values()], float)
    order = np.argsort(rows, kind="stable")
    rows, columns, values = rows[order], columns[order], values[order]
    size = block(len(languages))

    def weights(at: int, n: int) -> np.ndarray:
        out, (a, b) = np.zeros((n, len(languages))), np.searchsorted(rows, [at, at + n])
        out[rows[a:b] - at, columns[a:b]] = values[a:b]
        return out

    counts = np.ones((len(pieces) + 1, len(languages)))
    blocks = [(k, lattice(distinct[k : min(short, k + size)], pieces)) for k in range(0, short, size)]
    long = [(short + a, short + b) for a, b in runs([len(w) for w in distinct[short:]], size * (SHORT + 1))]
    for _ in range(ROUNDS):
        probability = (counts + PSEUDO) / (counts + PSEUDO).sum(axis=0)
        probability[0] = UNKNOWN
        counts = sum((expected(places, sizes, probability, weights(at, len(sizes))) for at, (places, sizes) in blocks), np.zeros_like(probability))
        for a, b in long:
            counts += expected_logs(*lattice(distinct[a:b], pieces), np.log(probability), weights(a, b - a))
        counts[0] = 0
    probability = (counts + PSEUDO) / (counts + PSEUDO).sum(axis=0)
    probability[0] = UNKNOWN
    prior = np.array([sum(1 for lang, _ in texts if lang == x) for x in languages], float)
    return Model(languages, np.log(prior / prior.sum()), probability)


class Scorer:
    """Scores of words by language, and whether they have a letter; keeps those of many words."""

    def __init__(self, model: Model, path: str, cache: int = CACHE):
        self.model, self.pieces, self.number = model, vocabulary(path), {}
        self.block, self.cache = block(len(model.languages)), cache * 8 // max(8, len(model.languages))
        self.table, self.logs, self.held = np.zeros((0, len(model.languages) + 1), np.float32), np.log(model.probability), 0

    def words(self, words: list[str]) -> np.ndarray:
        """For each word: its log probabilities by language, less the greatest, and whether it has a letter."""
        flat = [marked(w) for w in words]
        order = sorted(range(len(flat)), key=lambda k: len(flat[k]))
        short = sum(len(w) <= SHORT for w in flat)
        scores = np.zeros((len(flat), len(self.model.languages)))
        scores[order[:short]] = forward(*lattice([flat[k] for k in order[:short]], self.pieces), self.model.probability)[0]
        for a, b in runs([len(flat[k]) for k in order[short:]], min(STRIP, self.block * SHORT)):
            some = order[short + a : short + b]
            scores[some] = forward_logs([flat[k] for k in some], self.pieces, self.logs)
        return np.column_stack([scores - scores.max(axis=1, keepdims=True), [any(c.isalpha() for c in w) for w in words]])

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Sums over the words of each text of what words() gives."""
        cut = [t.split() for t in texts]
        if len(self.number) > self.cache or self.held > 64 * self.cache:
            self.number, self.table, self.held = {}, self.table[:0], 0
        new = list(set().union(*cut).difference(self.number))
        for at in range(0, len(new), self.block):
            some = new[at : at + self.block]
            rows = self.words([w.decode("utf-8", "replace") for w in some])
            self.number.update(zip(some, range(len(self.table), len(self.table) + len(some))))
            self.held += sum(map(len, some))
            self.table = np.concatenate([self.table, rows.astype(np.float32)])
        sizes = np.array([len(w) for w in cut])
        out = np.zeros((len(texts), self.table.shape[1]))
        if sizes.sum():
            ids = np.fromiter((k for words in cut for k in map(self.number.__getitem__, words)), np.int64, int(sizes.sum()))
            some = np.flatnonzero(sizes)
            out[some] = np.add.reduceat(self.table[ids].astype(float), (np.cumsum(sizes) - sizes)[some])
        return out


_scorers: dict[bytes, Scorer] = {}


def _scorer(model: Model, path: str, cache: int = CACHE) -> Scorer:
    """The worker's scorer of this model, which keeps words from task to task."""
    hold("langid", _scorers.clear)
    key = hashlib.md5(f"{path} {cache} {model.languages}".encode() + model.probability.tobytes()).digest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model, path, cache)
    return _scorers[key]


def identify_language(docs: DataFrame, path: str | None = None, sample: int = SAMPLE, words: int = WORDS, folds: int = 5, held_out_fold: int = 0, carry: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row for each of docs (doc_id, text, lang and any more).

    Learned from texts with a non-null lang whose crc32(doc_id as text) mod `folds` isn't `held_out_fold`: about `sample` texts of
    each language, however many languages there are, of texts over LONGEST bytes the first LONGEST / 4 characters; the `words` most
    frequent words of each language's sample go into the estimate. lang_pred is the language of most posterior probability, given
    all words of the text, of whatever length and over all their segmentations, and score is that probability; und and 0 for a null text, one without a letter, or if there is nothing to learn from. Null doc_id: crc32 of
    the empty text decides. Repeated rows are rows of their own. An empty table gives no rows. A
    worker keeps the scores of about `cache` words, and of no more than 64 bytes for each of them. With carry, row has the columns of docs.
    """
    path = path or public_vocabulary()
    apart = fold(F.col("doc_id"), folds) == held_out_fold
    known = docs.where(~apart & F.col("text").isNotNull()).select(
        "doc_id", F.when(F.octet_length("text") <= LONGEST, F.col("text")).otherwise(F.substring("text", 1, LONGEST // 4)).alias("text"), "lang"
    )
    model = learn(list(bounded_sample(known, "lang", sample).select("lang", "text").toArrow().to_pandas().sort_values(["lang", "text"]).itertuples(index=False, name=None)), path, words)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        m = shared.value
        scorer = None if m is None else _scorer(m, path, cache)
        for b, texts in by_bytes(batches, 1):
            if scorer is None:
                lang, score = [UND] * len(texts), [0.0] * len(texts)
            else:
                sums = scorer.texts(texts)
                logs = sums[:, :-1] + m.prior
                best = logs.argmax(axis=1)
                score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                score = np.where(sums[:, -1] > 0, score, 0.0)
                lang = [m.languages[k] if n > 0 else UND for k, n in zip(best, sums[:, -1])]
            yield out_batch(b, schema, [b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], carry)

    return map_texts(docs, run, "doc_id bigint, held_out boolean, lang_pred string, score double", carry, held_out=apart)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
