"""Best-fit packing of token sequences: a configuration linear program over the histogram of lengths, solved by multiplicative
weights with a knapsack for pricing, then rounded, and filled up by best fit."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold, slim, store, table, utf8

CAPACITY = 4096
END = (1).to_bytes(4, "little")
#: Pieces of one length are numbered within so many groups, dealt in turn, so that a length that a third of all have is spread.
GROUPS = 256
#: A worker keeps the ids of so many words, and of as many seen before those.
CACHE = 600_000
_encoders: dict = {}


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to little-endian 32-bit ids, as the tokenizer gives them without special tokens added. Its normaliser and its
    pre-tokeniser never join what white space separates, so words are encoded one by one, and a word's ids are kept; it always
    cuts between a letter and the punctuation after it, so these too are encoded apart."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.cache = cache
        self.tokenizer, self.new, self.old = Tokenizer.from_file(path), {}, {}

    def encode(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for word, got in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                self.new[word] = np.array(got.ids, "<u4").tobytes()

    def many(self, texts: list[bytes]) -> list[bytes]:
        cut = [(t if b"<|" in t else t.lower()).split() for t in texts]  # a special token's string has lower case only
        if len(self.new) > self.cache:
            self.new, self.old = {}, self.new
        new, old, unknown, joined = self.new, self.old, set(), []
        for word in set().union(*cut).difference(new):
            if word in old:
                new[word] = old[word]
                continue
            stem = word.rstrip(b".,;:!?")
            if len(stem) < len(word) and stem and stem.decode("utf-8", "replace")[-1].isalpha():
                joined.append((word, stem, word[len(stem) :]))
                for part in joined[-1][1:]:
                    if part not in new:
                        if part in old:
                            new[part] = old[part]
                        else:
                            unknown.add(part)
            else:
                unknown.add(word)
        self.encode(list(unknown))
        for word, stem, tail in joined:
            new[word] = new[stem] + new[tail]
        get = new.__getitem__
        return [b"".join(map(get, words)) for words in cut]


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One for each worker process, so that what it keeps lasts from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    hold("packing", _encoders.clear)
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("dealt", pa.int32())])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """docs (doc_id, text) tokenised and cut: pieces of `capacity` tokens, the last of a document shorter or equal. dealt is a
    running number in 0..GROUPS-1."""

    def run(batches):
        ids_of, dealt = encoder(path, cache).many, 37 * TaskContext.get().partitionId()
        for b in batches:
            at = 0
            while at < b.num_rows:
                n, size = at, 0
                texts = []
                while n < b.num_rows and (size == 0 or size < 2_000_000) and n - at < 512:
                    texts += utf8(b.column(1).slice(n, 1))
                    size += len(texts[-1])
                    n += 1
                rows = []
                for doc_id, ids in zip(b.column(0).slice(at, n - at).to_pylist(), ids_of(texts)):
                    ids += END
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        dealt += 1
                        rows.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part), dealt % GROUPS))
                at = n
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, dealt int")


def knapsack(values: np.ndarray, capacity: int) -> tuple[list[int], float]:
    """Of sizes 1..len(values) with these values, any number of each, the multiset of most value that fits: sizes and value."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, len(values))
        got = values[:m] + best[c - 1 :: -1][:m]
        k = int(got.argmax())
        if got[k] > best[c - 1]:
            best[c], take[c] = got[k], k + 1
        else:
            best[c], take[c] = best[c - 1], 0
    sizes, c = [], capacity
    while c:
        if take[c]:
            sizes.append(int(take[c]))
            c -= take[c]
        else:
            c -= 1
    return sizes, float(best[capacity])


def configuration_lp(counts: np.ndarray, capacity: int, rounds: int = 3000, step: float = 0.25) -> dict[tuple[int, ...], float]:
    """Bins by configuration (multiset of sizes) that cover counts[s-1] items of each size s, fractionally and nearly as few as
    can be. Multiplicative weights: each size has a price, higher while less of it is covered; the knapsack finds the
    configuration of most price, which is used until a fraction of what remains of one of its sizes is covered."""
    left, price, used = counts.astype(float).copy(), np.zeros(len(counts)), {}
    sizes = np.arange(1, len(counts) + 1)
    price[counts > 0] = sizes[counts > 0] / capacity
    for _ in range(rounds):
        live = left > 0.5
        if not live.any():
            break
        config, _ = knapsack(np.where(live, price, 0), capacity)
        if not config:
            break
        kind, n = np.unique(config, return_counts=True)
        bins = max(1.0, step * float((left[kind - 1] / n).min())) if (left[kind - 1] >= n).all() else float((left[kind - 1] / n).min())
        left[kind - 1] -= bins * n
        key = tuple(sorted(config, reverse=True))
        used[key] = used.get(key, 0) + bins
        price[kind - 1] *= np.exp(-0.1 * n / n.max())  # what is being covered gets cheaper
        price[live] = np.clip(price[live], 0.3 * sizes[live] / capacity, None)
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = 16) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces go, as runs (length, first, last, sequence, offset): the pieces of this length numbered first..last-1
    go to sequence, sequence+1, ... at this offset.

    The program works on lengths rounded up to `grain`. Its solution is rounded in a few ways, and the one that makes the fewest
    sequences is kept. The work depends on the number of different lengths, not of pieces.
    """
    counts = np.zeros(capacity // grain, np.int64)
    for length, n in histogram.items():
        counts[-(-length // grain) - 1] += n
    solved = sorted(configuration_lp(counts, len(counts)).items(), key=lambda x: (-x[1], x[0]))
    tried = (rounded(histogram, solved, capacity, grain, share, loose) for share in (1.0, 0.9, 0.5) for loose in (0, 1, 3))
    return min(tried, key=lambda found: max((r[3] + r[2] - r[1] for r in found), default=0))


def rounded(histogram: dict[int, int], solved, capacity: int, grain: int, share: float, loose: int) -> list[tuple[int, int, int, int, int]]:
    """`share` of the solution's bins, rounded down to whole ones, are filled with real lengths, the longest first, but for the
    `loose` smallest items of each, whose room then also holds what rounding lengths up had left free. What is left over goes,
    longest first, where it fits best, and into new bins if nowhere."""
    runs: dict[int, list[list[int]]] = {}  # by rounded size: [length, first, last], the longest at the end
    for length in sorted(histogram):
        runs.setdefault(-(-length // grain), []).append([length, 0, histogram[length]])
    units = capacity // grain
    counts = np.array([sum(r[2] - r[1] for r in runs.get(s, [])) for s in range(1, units + 1)])
    full = counts.copy()
    groups: list[tuple[int, list[tuple[int, int]], int]] = []  # bins, (length, first) of the items of the first bin, room

    def split(bins: int, items: list[tuple[int, int]], room: int, n: int):
        """The group's first n bins, and the rest."""
        return (n, items, room), (bins - n, [(length, first + n) for length, first in items], room)

    for config, bins in solved:
        bins = min([int(share * bins + 1e-9), *(int(full[s - 1] // config.count(s)) for s in set(config))])
        if bins <= 0:
            continue
        parts = [(bins, [], capacity)]
        for s in config[: max(1, len(config) - loose)]:
            full[s - 1] -= bins
            todo, parts = parts, []
            for part in todo:
                while part[0]:
                    run = runs[s][-1]
                    now, part = split(*part, min(part[0], run[2] - run[1]))
                    parts.append((now[0], now[1] + [(run[0], run[1])], now[2] - run[0]))
                    run[1] += now[0]
                    if run[1] == run[2]:
                        runs[s].pop()
        groups += parts

    open_: dict[int, list] = {}
    rooms: list[int] = []

    def put(group):
        if group[0]:
            if group[2] not in open_:
                open_[group[2]] = []
                insort(rooms, group[2])
            open_[group[2]].append(group)

    for g in groups:
        put(g)
    for length, first, last in sorted((r for rs in runs.values() for r in rs), reverse=True):
        while first < last:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                bins = max(1, (last - first) // each)
                n = min(each, last - first)
                put((bins, [(length, first + j * bins) for j in range(n)], capacity - n * length))
                first += n * bins
                continue
            room = rooms[k]
            group = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            now, rest = split(*group, min(group[0], last - first))
            put(rest)
            put((now[0], now[1] + [(length, first)], room - length))
            first += now[0]

    found, sequence = [], 0
    for room in rooms:
        for bins, items, _ in open_[room]:
            offset = 0
            for length, first in items:
                found.append((length, first, first + bins, sequence, offset))
                offset += length
            sequence += bins
    return sorted(found)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """docs (doc_id, text) as pieces in sequences of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    Null or empty text: the end token alone. Null doc_id: a document like any other; a repeated row is packed again. Texts of
    any length are tokenised whole. Without rows there are none. Texts are read once and never shuffled: the pieces are stored
    in the shared folder (a worker keeps the ids of about `cache` words), their histogram (at most `capacity` rows) goes to the driver, and each piece finds its place by its
    number among those of its length: a number within one of 256 groups, plus the sizes of the groups before.
    """
    spark = docs.sparkSession
    found = store(pieces(docs, path or public_vocabulary(), capacity, cache), "pieces")
    sums = found.groupBy("length", "dealt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    shift = max([1, *histogram.values()]) + 1
    keys = spark.sparkContext.broadcast((runs[:, 0] * shift + runs[:, 1], runs))

    def place(batches):
        key, table = keys.value
        for b in batches:
            length, number = (b.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(key, length * shift + number, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(table[at, 3] + number - table[at, 1]), pa.array(table[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "dealt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = found.withColumn("row", F.row_number().over(Window.partitionBy("length", "dealt").orderBy("doc_id", "piece", "ids_crc32"))).join(sums, ["length", "dealt"])
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("number")).mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pack": op4_pack}
ORACLE: dict[str, str] = {}
