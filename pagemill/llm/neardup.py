"""Near-duplicates: fast similarity sketches of word shingles, bands, exact verification, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, hold, named, slim, store, table

#: Coordinates of a band, and how likely a pair at the threshold may be to share none of the bands; they are as many as that takes.
ROWS, MISS = 7, 1e-6
#: Words whose hashes a worker keeps.
CACHE = 400_000
_mask = np.uint64(0xFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; with fewer words, of all of them as one; without words, none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def _digest(some: np.ndarray) -> int:
    """Of a set, as a signed number of 64 bits."""
    h = xxhash.xxh64_intdigest(some.tobytes())
    return h - (1 << 64) if h >> 63 else h


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The fast similarity sketch (Dahlgaard, Knudsen and Thorup, 2017) of each non-empty set: t coordinates, of which two sets
    agree in any with probability their Jaccard similarity, with the concentration of independent samples.

    In round i < t each element is thrown into a random coordinate, in round i >= t into coordinate i - t; each coordinate keeps
    the least (round, hash) that it got. A set stops after the first round at whose end it has no empty coordinate; that is
    after t * ln(t) / size rounds or so, and after 2 * t at most.
    """
    sizes = np.array([len(s) for s in sets])
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * t, empty)
    for i in range(2 * t):
        h = _mix(x + np.uint64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        where = owner * t + ((h >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if i < t else owner * t + (i - t)
        value = (h & _mask) | np.uint64(i << 32)
        if i:
            free = out[where] >= np.uint64(i << 32)
            where, value = where[free], value[free]
        np.minimum.at(out, where, value)
        open_ = (out.reshape(-1, t) == empty).any(axis=1)
        if not open_.any():
            break
        if i == 0 or i % 4 == 3:
            keep = open_[owner]
            x, owner = x[keep], owner[keep]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for j in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j])
    return key.view(np.int64)


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """So many bands that two sets of this similarity share none with probability (1 - similarity**rows)**bands <= miss."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1


def _trim() -> None:
    hold("neardup", _hashes.clear)
    if len(_hashes) > CACHE:
        _hashes.clear()


def _sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (a digest of the set) and bands; both null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b, texts in by_bytes(batches, 1):
            _trim()
            sets = [shingles(t, k) for t in texts]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(sketches(full, bands * rows), bands, rows)) if full else iter(())
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], schema=schema)

    return docs.select("*", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, bands array<bigint>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """node and its full set, as an array of sorted hashes."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for _, texts in by_bytes(batches, 1):
            _trim()
            sets = [s for s in (shingles(t, k) for t in texts) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], schema.field(1).type)], schema=schema)

    return docs.mapInArrow(run, "node bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, by their full sets. Each set meets the pairs of a busy node
    in 32 salted groups, so that a node in very many pairs makes no large task."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(32)).cast("int"))
    right = salted.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    both = F.size(F.array_intersect("left", "right"))
    return right.join(left, ["a", "salt"]).where(both * 100 >= (F.size("left") + F.size("right") - both) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame | None:
    """node, label of the nodes of edges (a, b): label is one node of the component. Each round, every node points to the least
    of itself and its neighbours, and the graph shrinks to what is pointed to; nodes are digests, so that their order is random
    and the rounds few. None without edges."""
    labels = None
    while True:
        edges = store(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
        both = edges.union(edges.select("b", "a"))
        up = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "up")
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            labels = store(labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        edges = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The labels after these further links."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    further = components(between)
    if further is None:
        return labels
    moved = labels.join(further.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return store(moved.union(further.join(labels, "node", "left_anti")), "labels")


def _star(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Of each bucket in members (band, node, n) one node, the centre, in a pair with each other one. The centre is the node that
    shares its bands with most others, since of copies of one text that was changed here and there, the least changed does; a
    pair whose sizes are too unequal for a link is left out."""
    popular = F.shiftleft(F.least(F.sum("n"), F.lit((1 << 42) - 1)), 20)
    ranked = members.groupBy("node").agg(popular.alias("rank")).withColumn("rank", F.col("rank") + F.pmod("node", F.lit(1 << 20))).join(sizes, "node")
    members = store(members.select("band", "node").join(ranked, "node"), "ranked")
    centres = members.groupBy("band").agg(F.max_by("node", "rank").alias("centre"), F.max_by("size", "rank").alias("its_size"))
    alike = (F.col("node") != F.col("centre")) & (F.least("size", "its_size") * 100 >= F.greatest("size", "its_size") * percent)
    return members.join(centres, "band").where(alike).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()


def _prefix_pairs(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes in labelled (node, label) with unequal labels that could be linked, by an exact prefix filter.

    Shingles are ordered by how many of the sets have them, the rarest first. Two sets whose similarity reaches t share a shingle
    among the first (1 - t) * n + 1 of the larger and the first (1 - 2t / (1 + t)) * m + 1 of the smaller, n and m their sizes; and
    what follows in either from that shingle on has to suffice for the link. Both are bounds, so no link is lost. Only shingles
    that several of the sets have are ordered; the others come before them and only move positions.
    """
    mine = sets.join(labelled, "node")
    each = store(mine.select("node", F.explode("shingles").alias("shingle")), "shingles")
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    of_node = Window.partitionBy("node")
    placed = each.join(common, "shingle").withColumn("own", F.count(F.lit(1)).over(of_node)).withColumn("k", F.row_number().over(of_node.orderBy("df", "shingle")))
    size = mine.select("node", "label", F.size("shingles").cast("bigint").alias("size"))
    placed = placed.join(size, "node").withColumn("rest", F.col("own") - F.col("k") + 1)
    # exact in integers: a set's shingles from a place on (rest) can suffice for a link with one no larger than percent of it allows
    probe, index = F.col("rest") * 100 >= F.col("size") * percent, F.col("rest") * (100 + percent) >= F.col("size") * (2 * percent)
    entries = store(placed.where(probe).select("shingle", "node", "label", "size", "rest", index.alias("looked_up")), "entries")
    other = entries.where("looked_up").select(*(F.col(c).alias(f"its_{c}") for c in ("shingle", "node", "label", "size", "rest")))
    smaller = (F.col("its_size") < F.col("size")) | ((F.col("its_size") == F.col("size")) & (F.col("its_node") < F.col("node")))
    enough = F.least("rest", "its_rest") * (100 + percent) >= (F.col("size") + F.col("its_size")) * percent
    return entries.join(other, (F.col("shingle") == F.col("its_shingle")) & (F.col("label") != F.col("its_label")) & smaller & enough).select(F.col("node").alias("a"), F.col("its_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """docs (doc_id, text) in groups of near-duplicates: doc_id, text_key (xxhash64 of the text), n_shingles, component_id, kept, a
    row for each row of docs.

    Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct shingles of `words` words, or with fewer
    words all of them as one. Documents are linked if the similarity of their sets is at least `percent` hundredths, and
    component_id is the smallest doc_id reachable by links. Null or empty text: no shingles, linked with nothing. Null doc_id:
    never the smallest; a component of such rows alone has a null component_id and all are kept. Equal rows, and rows of equal
    doc_id, are documents like others. kept: doc_id = component_id. An empty table gives no rows; further columns, whatever their
    names, aren't read.

    Plan: a sketch for each document; documents with equal sets become one node; nodes that share a key of a band may be
    linked. In each bucket one node, its centre, is compared with all others on full sets, and components are formed. Where a
    bucket then still holds several components, its nodes go on to an exact prefix filter on their rarest shingles, which lists
    those pairs of different components that could be linked, and they are compared on full sets too. So every pair of a bucket
    was compared, is in one component, or can't be linked, while the work is in proportion to the buckets and to the pairs
    that share rare shingles. Shingles, sets and bands are known by digests of 64 bits: of n different sets two are taken for
    one with a probability of n * n / 2**65. Sets are made only of nodes that share a bucket.
    """
    return grouped(docs, words, percent, rows, miss).drop("group")


def grouped(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """What near_duplicates() returns, and group: the same for the rows of a component whatever their ids, null only without shingles."""
    docs = slim(docs, "doc_id", "text")
    found = store(_sketched(docs, words, bands_for(percent, rows, miss), rows), "sketches")
    nodes = store(found.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "nodes")
    in_bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = store(in_bands.join(shared, "band"), "members")
    labels = None
    if not members.isEmpty():
        met = members.select("node").distinct()
        ids = store(nodes.select("node", "doc_id").join(met, "node", "left_semi").select("doc_id"), "ids").withColumnRenamed("doc_id", "wanted")
        sets = _sets(docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi"), words)
        sets = store(sets.join(met, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
        pairs = store(_star(members, sets.select("node", F.size("shingles").alias("size")), percent), "pairs")
        labels = _merged(None, store(_verified(pairs, sets, percent), "links"))
        now = members.select("band", "node").withColumn("label", F.col("node"))
        if labels is not None:
            now = members.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("band")
        left = store(now.join(several, "band", "left_semi").select("node", "label").distinct(), "left")
        if not left.isEmpty():
            pairs = store(_prefix_pairs(left, sets, percent), "pairs")
            labels = _merged(labels, store(_verified(pairs, sets, percent), "links"))
    if labels is None:
        labels = found.select("node", F.col("node").alias("label")).limit(0)
    labelled = store(nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    of_node = labelled.join(least, "label", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("label").alias("group"))
    out = found.select("doc_id", "text_key", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group")


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row of docs for each group, with all its columns: that of the smallest doc_id (nulls last), then the smallest text_key;
    of rows without shingles (null, empty or blank text) one for each (doc_id, text_key). So of repeated rows one stays. An empty
    table gives no rows; docs may have further columns of any names."""
    found = grouped(docs, **settings).groupBy("doc_id", "text_key").agg(F.min("group").alias("group"), F.count(F.lit(1)).alias("n"))
    found = store(found, "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")).alias("first")
    picked = found.where("group IS NOT NULL").groupBy("group").agg(first).select("first.doc_id", "first.text_key", "first.n")
    picked = store(picked.unionByName(found.where("group IS NULL").drop("group")), "picked")
    again = picked.where("n > 1")
    keyed = docs.select(F.struct(*named(docs)).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("key"))
    same = lambda other: F.col("id").eqNullSafe(other["doc_id"]) & (F.col("key") == other["text_key"])
    left = keyed.join(picked, same(picked), "left_semi")
    if not again.isEmpty():
        left = left.join(again, same(again), "left_anti").unionByName(left.join(again, same(again), "left_semi").dropDuplicates(["id", "key"]))
    return left.select("row.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("text_key")


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLE = {
    "op9_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sets AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n, s FROM shingled),
tokens AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS t FROM sets),
frequent AS (SELECT t, count(*) AS df FROM tokens GROUP BY t),
ranked AS (SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY df, t) AS k FROM tokens JOIN frequent USING (t)),
prefix AS MATERIALIZED (SELECT doc_id, n, t FROM ranked WHERE k <= n - ceil(0.85 * n) + 1),
candidates AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM prefix a JOIN prefix b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS MATERIALIZED (SELECT x, y FROM (SELECT c.x, c.y, a.n AS na, b.n AS nb, len(list_intersect(a.s, b.s)) AS i FROM candidates c JOIN sets a ON a.doc_id = c.x JOIN sets b ON b.doc_id = c.y) WHERE 100 * i >= 85 * (na + nb - i)),
sym AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN sym b ON b.x = r.y),
smallest AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM sets s JOIN smallest c USING (doc_id)
"""
}
