"""Mixing sources to target weights, with DataFrame functions only: a time-varying curriculum.

Each source has a weight and a schedule, which says how its share changes over the training run. The integral of the schedule,
scaled to the source's target, is its cumulative demand for words. The documents of a source, in the order of a hash, supply
words; a document's training position is where cumulative demand reaches its first word. The mix is the documents, sorted by
ranges of position.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: A source's schedule is one of these by its rank: knots (time, weight), linear between them. Shrinking, level, growing.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Words of a text are summed by source and leading hexadecimal digits of a hash: 4096 groups a source, whatever its size.
DIGITS = 3


def _pieces(schedule):
    """Of each linear piece: start time, start weight, slope, cumulative demand at its start and end (1 in all)."""
    areas = [(b - a) * (u + v) / 2 for (a, u), (b, v) in zip(schedule, schedule[1:])]
    total, done = sum(areas), 0.0
    for ((a, u), (b, v)), area in zip(zip(schedule, schedule[1:]), areas):
        yield a, u, (v - u) / (b - a), done / total, (done := done + area) / total, total


def _case(schedules, rank: str, x: str) -> str:
    """SQL for the time at which the schedule of a source has used the share x of its demand."""
    cases = []
    for k, schedule in enumerate(schedules):
        for a, u, slope, low, high, total in _pieces(schedule):
            y = f"(({x} - {low!r}D) * {total!r}D)"
            cases.append(f"WHEN {rank} % {len(schedules)} = {k} AND {x} <= {1e9 if high >= 1 - 1e-12 else high!r}D THEN {a!r}D + 2D * {y} / ({u!r}D + sqrt({u * u!r}D + {2 * slope!r}D * {y}))")
    return "CASE " + " ".join(cases) + " END"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, schedules=SCHEDULES) -> DataFrame:
    """docs (doc_id, text, source and any more) with mix_size, mix_source_size, mix_target, mix_taken, mix_passes and
    mix_position, one row for each input row.

    Sources, by code point and null last, weigh `weights` in turn and share `share` times all words; no target passes `cap`
    times its source's size, and what is cut off goes to the others by weight until none is above (water-filling, solved in
    closed form over the sources sorted by the level at which each fills). A source's words, in hash order, are used from the
    first on, again and again, until its target is reached, so that mix_taken sums to the rounded target; the one document at
    the end is taken in part. mix_passes has a struct (words, position) for each time that a document is used.

    Null text: no words, never taken. Null source: a source of its own. Null or repeated doc_id: rows count as themselves.
    Without words, all targets are 0. Columns of docs whose names start with mix_ are replaced.

    At scale: one shuffle of the rows by (source, hash group), 4096 groups a source, so that a source with a third of all rows
    is spread evenly; sums of groups are aggregated before their shuffle; windows over a single partition see one row a source.
    """
    mine = [c for c in docs.columns if not c.startswith("mix_")]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"mix_in_{k}") for k, c in enumerate(mine)),
        words_of(F.col("text")).alias("mix_size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary")).alias("mix_hash"),
        F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n")).alias("mix_source"),
    ).withColumn("mix_group", F.substring("mix_hash", 1, DIGITS))

    groups = rows.groupBy("mix_source", "mix_group").agg(F.sum("mix_size").alias("words"))
    everything = Window.partitionBy(F.lit(1))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = everything.orderBy((F.col("mix_source") == "n"), "mix_source")
    filling = everything.orderBy("fills_at", "mix_rank")
    sources = (
        groups.groupBy("mix_source").agg(F.sum("words").alias("mix_source_size"))
        .withColumn("mix_rank", F.row_number().over(named) - 1)
        .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("mix_rank") % len(weights) + 1).cast("int")))
        .withColumn("most", F.lit(float(cap)) * F.col("mix_source_size"))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("level", (F.lit(float(share)) * F.sum("mix_source_size").over(everything) - F.coalesce(F.sum("most").over(before(filling)), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before(filling)), F.lit(0.0))))
        .withColumn("level", F.first(F.when(F.col("level") < F.col("fills_at"), F.col("level")), ignorenulls=True).over(all_rows(filling)))
        .withColumn("mix_target", F.coalesce(F.least("most", F.col("weight") * F.col("level")), F.col("most")))
        .select("mix_source", "mix_source_size", "mix_rank", "mix_target", F.floor(F.col("mix_target") + 0.5).alias("mix_whole"))
    )
    groups = groups.withColumn("mix_before", F.coalesce(F.sum("words").over(before(Window.partitionBy("mix_source").orderBy("mix_group"))), F.lit(0))).drop("words").join(sources, "mix_source")

    order = Window.partitionBy("mix_source", "mix_group").orderBy("mix_hash", "mix_size")
    found = rows.join(groups, ["mix_source", "mix_group"]).withColumn("mix_start", F.col("mix_before") + F.sum("mix_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mix_size"))

    def used(k: int) -> Column:
        start = F.col("mix_start") + k * F.col("mix_source_size")
        return F.struct(
            F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("mix_whole") - start)).cast("bigint").alias("words"),
            F.when(F.col("mix_whole") > 0, F.expr(_case(schedules, "mix_rank", f"(CAST(mix_start + {k} * mix_source_size AS DOUBLE) / mix_whole)"))).alias("position"),
        )

    passes = F.filter(F.array(*(used(k) for k in range(-int(-cap // 1)))), lambda p: p.words > 0)
    found = found.withColumn("mix_passes", passes)
    return found.select(
        *(F.col(f"mix_in_{k}").alias(c) for k, c in enumerate(mine)), "mix_size", "mix_source_size", "mix_target",
        F.aggregate("mix_passes", F.lit(0).cast("bigint"), lambda a, p: a + p.words).alias("mix_taken"),
        "mix_passes", F.get("mix_passes", F.lit(0)).position.alias("mix_position"),
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of docs, of whatever names: a row for each use of a document, range-sorted by training
    position; the one document of a source that is taken in part is cut after its last word taken, and its n_chars follows.
    Null, empty and blank texts have no words and are never taken; an empty table gives no rows; for the rest see mix_sources()."""
    kept = ("doc_id", "text", "source", "n_chars")
    names = [c if c in kept else f"other_{k}" for k, c in enumerate(docs.columns)]
    docs, given = docs.toDF(*names), docs.columns
    used = mix_sources(docs, **settings).select("*", F.explode("mix_passes").alias("mix_pass"))
    text = F.when(F.col("mix_pass.words") < F.col("mix_size"), first_words(F.col("text"), F.col("mix_pass.words"))).otherwise(F.col("text"))
    used = used.withColumn("text", text)
    if "n_chars" in docs.columns:
        used = used.withColumn("n_chars", F.when(F.col("mix_pass.words") < F.col("mix_size"), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return used.orderBy("mix_pass.position", "doc_id").select(*(F.col(n).alias(c) for n, c in zip(names, given)))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.orderBy(F.asc_nulls_last("mix_position"), "doc_id").select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
        F.floor(F.col("mix_position") * 1e6).alias("millionth"),
    )


def _oracle() -> str:
    at = re.sub(r"(?<=[\d.])D\b", "::DOUBLE", _case(SCHEDULES, "rank", "(CAST(start AS DOUBLE) / whole)"))
    return rf"""
WITH rows AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS hash, coalesce('v' || source, 'n') AS source FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source = 'n', source) - 1 AS rank FROM rows GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(rank % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS most FROM sources),
levels AS (SELECT *, most / weight AS fills_at,
    (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, coalesce(least(most, weight * (SELECT arg_min(level, (fills_at, rank)) FROM levels WHERE level < fills_at)), most) AS target FROM levels),
placed AS (SELECT r.doc_id, r.size, r.hash, t.source_size, t.rank, t.target, floor(t.target + 0.5)::BIGINT AS whole,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash, r.size ROWS UNBOUNDED PRECEDING)::BIGINT - r.size AS start
  FROM rows r JOIN targets t ON r.source = t.source),
taken AS (SELECT *, greatest(0, least(size, whole - start)) AS once, greatest(0, least(size, whole - start - source_size)) AS again FROM placed)
SELECT doc_id, size, source_size, target, (once + again)::BIGINT AS taken,
  CASE WHEN once + again > 0 THEN floor(({at}) * 1e6)::BIGINT END AS millionth FROM taken
"""


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLE = {"op3_mix_sources": _oracle()}
