"""Command line: crawl a table of pages, look after the cache, report and mend links."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates, urls
from ..operators import crawl, links
from ..operators.shared import kept
from ..sources import store
from . import extract


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagemill")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl")
    c.add_argument("url")
    c.add_argument("--pages", required=True, help="Parquet table (page_id, url, html)")
    c.add_argument("-d", "--depth", type=int, default=3)
    c.add_argument("-m", "--max-urls", type=int, default=200)
    c.add_argument("-o", "--output", default=".")
    c.add_argument("-i", "--include")
    c.add_argument("-x", "--exclude")
    c.add_argument("--restrict-path-override")
    c.add_argument("--robots", help="text of robots.txt")
    c.add_argument("--ignore-robots", action="store_true")
    c.add_argument("--no-filter", action="store_true")
    c.add_argument("--no-cache", action="store_true")
    c.add_argument("--no-cache-write", action="store_true")
    c.add_argument("--keep-query-strings", action="store_true")
    c.add_argument("-n", "--name")
    k = sub.add_parser("cache")
    k.add_argument("--clear", action="store_true")
    k.add_argument("--site")
    k.add_argument("--stats", action="store_true")
    k.add_argument("--path", default=store.cache_location())
    r = sub.add_parser("links")
    r.add_argument("dir")
    r.add_argument("--fix", action="store_true")
    r.add_argument("--group", type=int)
    r.add_argument("--keep-query-strings", action="store_true")
    r.add_argument("--hostname")
    return p


def addresses(pages: DataFrame, keep_query: bool) -> DataFrame:
    """url, key: under which keys a crawl finds a page, its own address and, where no page has that, the one with the trailing slash
    toggled, which is tried when a page isn't there."""
    own = pages.select("url", urls.normalize_url(F.col("url"), keep_query).alias("key")).distinct()
    other = own.select("url", urls.alternate_slash(F.col("key")).alias("key")).join(own.select("key").distinct(), "key", "left_anti")
    return own.unionByName(other)


def run_crawl(spark: SparkSession, args) -> dict:
    pages = spark.read.parquet(args.pages)
    keys = addresses(pages, args.keep_query_strings)
    found = links.html_links(pages).join(keys, "url").select(F.col("key").alias("url"), "link", F.col("pos").alias("ord"))
    options = crawl.CrawlOptions(
        args.depth, args.max_urls, predicates.parse_patterns(args.include), predicates.parse_patterns(args.exclude), args.restrict_path_override, args.keep_query_strings,
        [] if args.ignore_robots else predicates.parse_robots(args.robots or ""),
    )
    result = crawl.crawl(args.url, found, options)
    hit = keys.join(result.seen.select(F.col("url").alias("key")), "key", "left_semi").select("url").distinct()
    wanted, held = pages.join(hit, "url", "left_semi").select("page_id", "url", "html"), None
    if not args.no_cache and store.exists(spark, store.cache_location()):
        cached, missed = store.with_cache(wanted, store.cache_read(spark, store.cache_location()))
        held = cached.drop("url").join(wanted.select("page_id", "url", urls.cache_key(F.col("url")).alias("key")), "key")
        wanted = missed
    extracted = extract.extract_markdown(wanted)
    good = kept(extracted.where(~predicates.is_error_page(F.col("markdown"))), "pages")
    from_cache = 0
    if held is not None:
        held = kept(held.select(F.col("page_id").cast("bigint"), *good.columns[1:]), "cached")
        from_cache = held.count()
    if not args.no_cache_write:
        store.cache_write(good, store.cache_location())
    if held is not None:
        good = good.unionByName(held)
    files = extract.output_files(good, args.keep_query_strings, not args.no_filter)
    if args.name:
        files = files.withColumn("host", F.lit(args.name))
    return store.write_tree(files, args.output).first().asDict() | crawl.summary(result, keys.select(F.col("key").alias("url"))).first().asDict() | {"from_cache": from_cache, "scope": result.scope}


def run_links(spark: SparkSession, args):
    host = args.hostname or args.dir.rstrip("/").rsplit("/", 1)[-1]
    files = store.read_tree(spark, args.dir, host)
    if args.fix:
        fixed = links.fix_links(files, args.keep_query_strings).where("changed")
        n = fixed.count()
        store.write_tree(fixed.withColumn("host", F.lit(".")), args.dir).first()
        print(f"{n} files changed")
        files = store.read_tree(spark, args.dir, host)
    hrefs = files.select("host", F.col("rel_path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit(links.MD_LINK), 2)).alias("link")).where(urls.is_http(F.col("link")) & (urls.hostname(F.col("link")) == F.col("host")))
    out = links.outlinks(hrefs.select("file", "link"), files.select("host", "rel_path"), args.keep_query_strings)
    return (links.group_outlinks(out, args.group) if args.group else out).orderBy(F.desc("references"), "url")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pagemill").getOrCreate()
    if args.command == "crawl":
        for k, v in run_crawl(spark, args).items():
            print(f"{k}: {v}")
    elif args.command == "cache":
        if args.clear:
            print(f"{store.cache_clear(spark, args.path, args.site)} entries removed")
        else:
            store.cache_stats(spark, args.path).show(truncate=False)
    else:
        for row in run_links(spark, args).toLocalIterator():
            print(f"{row.references}x {row.url}")


if __name__ == "__main__":
    main()
