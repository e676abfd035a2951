"""Traversal of the link graph, level by level: bounded by depth and by a budget that goes to the links nearest to the start."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates, urls
from .shared import kept


@dataclass
class CrawlOptions:
    depth: int = 3
    max_urls: int = 200
    include: list[predicates.Pattern] = field(default_factory=list)
    exclude: list[predicates.Pattern] = field(default_factory=list)
    scope: str | None = None
    keep_query: bool = False
    robots: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class CrawlResult:
    """seen (url, depth, score), capped (url), filtered_out (url, reason) and the scope; errors are seen URLs without a page."""

    seen: DataFrame
    capped: DataFrame
    filtered_out: DataFrame
    scope: str


def enqueue(links: DataFrame, seen: DataFrame, start: str, scope: str, options: CrawlOptions, room: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From links (url, link, ord) the next frontier (url, score), what the budget leaves out (url), and what is filtered out
    (url, reason). Ties of score are broken by the order of discovery, then by URL. Only `room` rows of the frontier meet in one
    task: Spark takes the top of each partition first."""
    start_col = F.lit(start)
    fresh = links.withColumn("next", urls.normalize_url(F.col("link"), options.keep_query)).where(predicates.same_host(F.col("link"), start_col))
    fresh = fresh.groupBy("next").agg(F.min(F.struct("ord", "link")).alias("first")).select(F.col("next").alias("url"), "first.*").join(seen.select("url"), "url", "left_anti")
    fresh = fresh.withColumn("reason", predicates.reject_reason(F.col("link"), F.lit(scope), options.robots, options.include, options.exclude))
    filtered = fresh.where("reason IS NOT NULL").select("url", "reason")
    scored = fresh.where("reason IS NULL").select("url", "ord", urls.prefix_score(F.col("url"), urls.pathname(start_col)).cast("double").alias("score"))
    frontier = kept(scored.orderBy(F.desc("score"), "ord", "url").limit(max(0, room)).select("url", "score"), "frontier")
    return frontier, scored.join(frontier, "url", "left_anti").select("url"), filtered


def crawl(start: str, links: DataFrame, options: CrawlOptions | None = None, index_links: list[str] = ()) -> CrawlResult:
    """Follows links (url, link, ord; url as normalize_url gives it) from the start URL for options.depth rounds."""
    options, spark = options or CrawlOptions(), links.sparkSession
    first = spark.range(1).select(urls.normalize_url(F.lit(start), options.keep_query).alias("url"), urls.default_scope(urls.hostname(F.lit(start)), urls.pathname(F.lit(start))).alias("scope")).first()
    scope = options.scope or first["scope"]
    seen = kept(spark.createDataFrame([(first["url"], 0, float("inf"))], "url string, depth int, score double"), "seen")
    frontier = seen.select("url")
    none = spark.createDataFrame([], "url string")
    capped, filtered, count = none, none.withColumn("reason", F.lit("")), 1
    for depth in range(0 if index_links and options.depth > 0 else 1, options.depth + 1):
        if depth == 0:
            out = spark.createDataFrame([(start, u, k) for k, u in enumerate(index_links)], "url string, link string, ord long")
        else:
            out = links.join(frontier, "url", "left_semi").select("url", "link", F.col("ord").cast("bigint").alias("ord"))
        new, over, dropped = enqueue(out, seen, start, scope, options, options.max_urls - count)
        n = new.count()
        capped, filtered = kept(capped.union(over).distinct(), "capped"), kept(filtered.union(dropped).distinct(), "filtered")
        if n:
            seen = kept(seen.union(new.select("url", F.lit(depth).alias("depth"), "score")), "seen")
        frontier, count = (new.select("url") if depth else seen.select("url")), count + n
        if not n and depth:
            break
    return CrawlResult(seen, capped, filtered, scope)


def reachable(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """url, depth: the least number of edges (src, dst) from the start, up to `depth`."""
    spark = edges.sparkSession
    seen = kept(spark.createDataFrame([(start, 0)], "url string, depth int"), "seen")
    for k in range(1, depth + 1):
        new = kept(edges.join(seen.where(F.col("depth") == k - 1).select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti"), "new")
        if new.isEmpty():
            break
        seen = seen.union(new.select("url", F.lit(k).alias("depth")))
    return seen


def summary(result: CrawlResult, pages: DataFrame) -> DataFrame:
    """One row: pages found, seen URLs without a page, links filtered out and left over."""
    there = pages.select(urls.normalize_url(F.col("url")).alias("url")).distinct()
    found = result.seen.select("url").join(there.withColumn("page", F.lit(1)), "url", "left").agg(F.count("page").alias("pages"), F.count_if(F.col("page").isNull()).alias("errors"))
    return found.withColumns({"filtered_links": F.lit(result.filtered_out.select("url").distinct().count()), "remaining_links": F.lit(result.capped.count())})


def first_by_order(candidates: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """For each key the value of the least order: which of several candidate addresses answered."""
    return candidates.groupBy(key).agg(F.min_by(value, order).alias(value))


def latest_by_key(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")
