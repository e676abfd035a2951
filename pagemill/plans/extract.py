"""Pages to Markdown as one Arrow pass, and the choice between a page and the Markdown that its site hosts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, markdown, predicates, urls
from ..functions.batches import slices

SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("markdown", pa.string()), ("links", pa.list_(pa.string())), ("raw_html_length", pa.int64())])


def extract_markdown(pages: DataFrame) -> DataFrame:
    """page_id, url, title, markdown, links, raw_html_length of pages (page_id, url, html). Null html is an empty page."""

    def run(batches):
        for b in batches:
            for part in slices(b, 2):
                ids, us, hs = (c.to_pylist() for c in part.columns)
                rows = [html.extract(h, u) for h, u in zip(hs, us)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int64()),
                ], schema=SCHEMA)

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, url string, title string, markdown string, links array<string>, raw_html_length bigint")


def titles_and_links(pages: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """page_id, title, links of pages (page_id, url, html), without the conversion; null html has a null title. In titles all
    character references are read, as browsers do, or those named only, each with its semicolon."""
    schema = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("links", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            for part in slices(b, 2):
                rows = [html.title_and_links(h, u, references) for h, u in zip(part.column(2).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], schema=schema)

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, title string, links array<string>")


def output_files(extracted: DataFrame, keep_query: bool = False, use_filter: bool = True) -> DataFrame:
    """host, rel_path, content: what the tree of files gets. Of pages with one path the last, by page_id, stays."""
    rows = extracted.select(urls.hostname(F.col("url")).alias("host"), urls.url_to_rel_path(F.col("url"), keep_query).alias("rel_path"), "page_id", F.col("markdown").alias("content"))
    rows = rows.groupBy("host", "rel_path").agg(F.max_by("content", "page_id").alias("content"))
    if use_filter:
        rows = markdown.filter_markdown(rows, "content", aggressive_chrome=True)
    return rows.withColumn("content", markdown.vendor_rules(F.col("content")))


def prefer_hosted(pages: DataFrame, hosted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """url, markdown: for each of pages (url) the first of its candidates among hosted (url, content_type, text) that looks like
    Markdown; pages without one are left out. by: columns that both have and the result keeps; texts hosted under one address, as in
    several fetches, then go to the pages that agree in them."""
    wanted = pages.select(*by, "url", F.posexplode(urls.markdown_candidates(F.col("url"))).alias("ord", "candidate"))
    good = hosted.where(predicates.is_markdown_like(F.col("content_type"), F.col("text"))).select(*by, F.col("url").alias("candidate"), "text")
    first = wanted.join(good, [*by, "candidate"]).groupBy(*by, "url").agg(F.min_by("text", "ord").alias("text"))
    return first.select(*by, "url", markdown.clean_markdown(F.col("text")).alias("markdown"))
