"""The page cache as a table, and trees of Markdown files."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.crawl import latest_by_key

#: Entries of other versions, or older than this, are misses.
VERSION, TTL_DAYS = 2, 7
CACHE = "key string, url string, title string, markdown string, links array<string>, raw_html_length bigint, cached_at timestamp, version int, hostname string"


def cache_location(name: str = "PAGEMILL") -> str:
    """Of the variables NAME_CACHE_DIR, XDG_CACHE_HOME, LOCALAPPDATA (Windows) and the home folder, the first there is."""
    env = os.environ
    own = name.lower()
    if env.get(f"{name}_CACHE_DIR"):
        return env[f"{name}_CACHE_DIR"]
    if env.get("XDG_CACHE_HOME"):
        return os.path.join(env["XDG_CACHE_HOME"], own)
    if sys.platform == "win32" and env.get("LOCALAPPDATA"):
        return os.path.join(env["LOCALAPPDATA"], own)
    return os.path.join(os.path.expanduser("~"), ".cache", own)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cache_write(pages: DataFrame, path: str) -> None:
    """Appends pages (url, title, markdown, links, raw_html_length) as entries, by host name; the latest of a key counts."""
    rows = pages.select(
        urls.cache_key(F.col("url")).alias("key"), "url", "title", "markdown", "links", "raw_html_length", F.current_timestamp().alias("cached_at"), F.lit(VERSION).alias("version"), urls.hostname(F.col("url")).alias("hostname"),
    )
    rows.write.mode("append").partitionBy("hostname").parquet(path)


def cache_read(spark: SparkSession, path: str, ttl_days: float = TTL_DAYS) -> DataFrame:
    """Valid entries: of the version, not older than the time to live, the latest of each key. A host is a partition, so a filter on
    hostname reads that host's files only."""
    rows = spark.read.schema(CACHE).parquet(path)
    fresh = rows.where((F.col("version") == VERSION) & (F.col("cached_at") >= F.current_timestamp() - F.expr(f"make_dt_interval(0, 0, 0, {ttl_days * 86400})")))
    return latest_by_key(fresh, "key", "cached_at")


def cache_stats(spark: SparkSession, path: str) -> DataFrame:
    """Entries by host, and the size of the files in KB."""
    rows = spark.read.schema(CACHE).parquet(path).select("hostname", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = rows.groupBy("hostname", "file").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return files.groupBy("hostname").agg(F.sum("n").alias("entries"), F.round(F.sum("size") / 1024).cast("bigint").alias("kb"))


def cache_clear(spark: SparkSession, path: str, site: str | None = None) -> int:
    """Removes all entries, or those of a host; returns how many there were. Folders go by Hadoop's file system."""
    rows = spark.read.schema(CACHE).parquet(path)
    n = (rows if site is None else rows.where(F.col("hostname") == site)).count()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if site is None else f"{path}/hostname={site}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return n


def with_cache(pages: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pages (url, ...) what the cache holds, and the pages that it misses."""
    keyed = pages.withColumn("key", urls.cache_key(F.col("url")))
    return cached.join(keyed.select("key"), "key", "left_semi"), keyed.join(cached.select("key"), "key", "left_anti").drop("key")


def write_tree(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (host, rel_path, content) as folder/host/rel_path; the folder must be one that all executors share. Returns
    the number of files and of UTF-16 units written; the writing happens when that is read."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = units = 0
            for host, rel, content in zip(*(c.to_pylist() for c in b.select(["host", "rel_path", "content"]).columns)):
                to = os.path.normpath(os.path.join(folder, host, rel))
                if not to.startswith(os.path.normpath(os.path.join(folder, host)) + os.sep):
                    raise ValueError(f"{rel} leaves its folder")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{os.getpid()}.part"  # a task that is run again replaces what it wrote
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(content or "")
                os.replace(part, to)
                n, units = n + 1, units + len((content or "").encode("utf-16-le")) // 2
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([units], pa.int64())], names=["files", "total_bytes"])

    return files.select("host", "rel_path", "content").mapInArrow(run, "files bigint, total_bytes bigint").agg(F.sum("files").alias("files"), F.sum("total_bytes").alias("total_bytes"))


def read_tree(spark: SparkSession, folder: str, host: str | None = None) -> DataFrame:
    """host, rel_path, content of the .md files below folder/<host>, or below folder itself if it is that of one host."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tail = F.regexp_extract(path, rf"\Q{os.path.normpath(folder)}\E/(.*)$", 1)
    if host:
        return rows.select(F.lit(host).alias("host"), tail.alias("rel_path"), F.col("value").alias("content"))
    return rows.select(F.regexp_extract(tail, "^([^/]*)/", 1).alias("host"), F.regexp_replace(tail, "^[^/]*/", "").alias("rel_path"), F.col("value").alias("content"))
