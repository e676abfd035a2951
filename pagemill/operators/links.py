"""The link graph: links of pages and of Markdown, links to pages that aren't there, and links rewritten between stored files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates, urls
from ..functions.batches import slices
from .shared import kept

HREF = r"""<[aA]\s(?:[^>]*?\s)?[hH][rR][eE][fF]\s*=\s*"([^"]*)\""""
#: Text, address and title of a Markdown link.
MD_LINK = r"\[([^\]]*)\]\(([^)\s]+)((?:\s+\"[^\"]*\")?)\)"


def _followed(links: DataFrame) -> DataFrame:
    return links.where(predicates.same_host(F.col("link"), F.col("base")) & ~predicates.is_asset(F.col("link")))


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, link of pages (page_id, url, html): same-host addresses in the order of the page, the first of equals;
    fragments are dropped, queries kept, assets and utility pages left out."""
    hrefs = F.transform(F.regexp_extract_all("html", F.lit(HREF), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    resolved = F.transform(F.array_distinct(hrefs), lambda x: F.regexp_replace(urls.resolve(x, F.col("url")), "#.*$", ""))
    links = pages.select("page_id", "url", F.col("url").alias("base"), F.posexplode(resolved).alias("pos", "link"))
    kept = _followed(links).where(~predicates.is_utility(F.col("link")))
    return kept.groupBy("page_id", "url", "link").agg(F.min("pos").alias("pos"))


def markdown_links(documents: DataFrame, markdown: str = "markdown", base: str = "url") -> DataFrame:
    """All columns but the Markdown, with pos and link: inline links, then those in angle brackets, then bare ones; those of other
    hosts, to assets, fragments and mail left out; suffixes of hosted Markdown dropped; the first of equals."""
    md = F.col(markdown)
    found = F.concat(
        F.regexp_extract_all(md, F.lit(MD_LINK), 2),
        F.regexp_extract_all(md, F.lit(r"<((?:https?://|/)[^>\s]+)>"), 1), F.regexp_extract_all(md, F.lit(r"(?:^|[\s(])(https?://[^\s)>\]]+)"), 1),
    )
    rest = [c for c in documents.columns if c != markdown]
    wanted = F.filter(F.array_distinct(found), predicates.is_followable_href)
    resolved = F.transform(wanted, lambda x: urls.strip_markdown_suffix(F.regexp_replace(urls.resolve(x, F.col(base)), "#.*$", "")))
    links = documents.select(*rest, F.col(base).alias("base"), F.posexplode(resolved).alias("pos", "link"))
    return _followed(links).groupBy(*rest, "link").agg(F.min("pos").alias("pos"))


def merge_links(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def outlinks(links: DataFrame, files: DataFrame, keep_query: bool = False) -> DataFrame:
    """url, references: addresses without query among links (file, link) whose path isn't in files (host, rel_path), and in how
    many files they are. Links are made distinct by file before the anti join, which may then be of any size on either side."""
    each = links.select("file", urls.outlink_key(F.col("link")).alias("url"), urls.hostname(F.col("link")).alias("host"), urls.url_to_rel_path(F.col("link"), keep_query).alias("rel_path")).distinct()
    return each.join(files, ["host", "rel_path"], "left_anti").select("file", "url").distinct().groupBy("url").agg(F.count(F.lit(1)).alias("references"))


def group_outlinks(found: DataFrame, level: int) -> DataFrame:
    return found.groupBy(urls.group_key(F.col("url"), level).alias("url")).agg(F.sum("references").alias("references"))


def page_outlinks(pages: DataFrame) -> DataFrame:
    files = pages.select(urls.hostname(F.col("url")).alias("host"), urls.url_to_rel_path(F.col("url")).alias("rel_path")).distinct()
    return outlinks(html_links(pages).select(F.col("page_id").alias("file"), "link"), files)


def _replaced(text: str, new: dict[str, str]) -> str:
    return re.sub(MD_LINK, lambda m: f"[{m[1]}]({new[m[2]]}{m[3]})" if m[2] in new else m[0], text)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, rel_path, content of batches that hold old and new addresses too, slice by slice."""
    for b in batches:
        for part in slices(b, 2):
            texts, old, new = (part.column(k).to_pylist() for k in (2, 3, 4))
            content = pa.array([_replaced(t, dict(zip(x, y))) if t is not None and x else t for t, x, y in zip(texts, old, new)], pa.string())
            yield part.select([0, 1, 2]).set_column(2, "content", content)


def _hrefs(files: DataFrame) -> DataFrame:
    return files.select("host", "rel_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(MD_LINK), 2))).alias("href"))


def _rewritten(files: DataFrame, changes: DataFrame) -> DataFrame:
    maps = changes.groupBy("host", "rel_path").agg(F.collect_list(F.struct("href", "new")).alias("m"))
    joined = files.join(maps, ["host", "rel_path"], "left")
    return joined.select("host", "rel_path", "content", F.col("m.href").alias("old"), F.col("m.new").alias("new")).mapInArrow(_applied, "host string, rel_path string, content string")


def rewrite_absolute_links(files: DataFrame, keep_query: bool = False) -> DataFrame:
    """files (host, rel_path, content) with absolute links to stored files of the same host made relative; query and fragment go."""
    links = _hrefs(files).where(urls.is_http(F.col("href")) & (urls.hostname(F.col("href")) == F.col("host"))).withColumn("target", urls.url_to_rel_path(F.col("href"), keep_query))
    there = files.select("host", F.col("rel_path").alias("target"))
    return _rewritten(files, links.join(there, ["host", "target"], "left_semi").withColumn("new", urls.relative_link(F.col("target"), F.col("rel_path"))))


def _normal_path(folder: Column, href: Column) -> Column:
    parts = F.split(F.concat(folder, F.lit("/"), F.regexp_replace(href, "^/+", "")), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).when((x == ".") | (x == ""), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(kept, "/")


def rewrite_broken_links(files: DataFrame) -> DataFrame:
    """files with relative links to .md files that aren't stored made absolute again."""
    href = F.col("href")
    links = _hrefs(files).where(~href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & href.rlike(r"\.md(?:[#?].*)?$"))
    links = links.withColumn("suffix", F.regexp_extract("href", r"\.md([#?].*)?$", 1)).withColumn("target", _normal_path(F.regexp_replace("rel_path", "/?[^/]*$", ""), F.regexp_replace("href", r"[#?].*$", "")))
    there = files.select("host", F.col("rel_path").alias("target"))
    return _rewritten(files, links.join(there, ["host", "target"], "left_anti").withColumn("new", F.concat(urls.rel_path_to_url(F.col("target"), F.col("host")), "suffix")))


def fix_links(files: DataFrame, keep_query: bool = False) -> DataFrame:
    """files after both rewritings, with changed: whether a file's content is another than before. What files is computed from is
    computed once, and the result is read from stored tables only, so that the tree of files may be overwritten with it."""
    files = kept(files.select("host", "rel_path", "content"), "files")
    after = rewrite_broken_links(kept(rewrite_absolute_links(files, keep_query), "files"))
    return after.join(files.select("host", "rel_path", F.col("content").alias("before")), ["host", "rel_path"]).select("host", "rel_path", "content", (F.col("content") != F.col("before")).alias("changed"))


def canonicalize_markdown_links(text: str, base: str) -> str:
    """Same-host links to hosted Markdown made absolute, without the suffix."""
    from urllib.parse import urljoin, urlunsplit

    host = urlsplit(base).hostname

    def one(m):
        at = urlsplit(urljoin(base, m[2]))
        path = re.sub(r"(?i)\.(md|markdown)$", "", at.path)
        return m[0] if at.scheme not in ("http", "https") or at.hostname != host or path == at.path else f"[{m[1]}]({urlunsplit((at.scheme, at.netloc, path, at.query, at.fragment))}{m[3]})"

    return re.sub(MD_LINK, one, text)
