"""Predicates over URLs and texts: patterns, robots rules, file kinds, and the reason for which a link is not followed."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls

#: File extensions that are no pages, and parts of paths that are no documentation.
ASSETS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "json", "xml", "zip", "tar", "gz", "pdf", "dmg", "pkg"]
UTILITY = ["/search", "/login", "/signin", "/signup"]


@dataclass(frozen=True)
class Pattern:
    """A substring, or a regular expression, of a URL's path and query."""

    value: str
    regex: bool = False

    def test(self, target: Column) -> Column:
        return target.rlike(self.value) if self.regex else target.contains(self.value)


def parse_patterns(raw: str | None) -> list[Pattern]:
    """Comma-separated patterns; /.../flags is a regular expression, of whose flags i, m and s count."""
    found = []
    for part in (x.strip() for x in (raw or "").split(",")):
        if m := re.fullmatch(r"/(.+)/([gimsuy]*)", part):
            flags = "".join(f for f in "ims" if f in m[2])
            found.append(Pattern(f"(?{flags})" * bool(flags) + m[1], True))
        elif part:
            found.append(Pattern(part))
    return found


def target_of(url: Column) -> Column:
    return F.concat(urls.pathname(url), urls.search(url))


def _any(url: Column, patterns: list[Pattern]) -> Column:
    def test(target):
        out = F.lit(False)
        for p in patterns:
            out = out | p.test(target)
        return out

    return urls.let(target_of(url), test)


def is_excluded(url: Column, patterns: list[Pattern]) -> Column:
    return _any(url, patterns)


def is_included(url: Column, patterns: list[Pattern]) -> Column:
    return _any(url, patterns) if patterns else F.lit(True)


def parse_robots(text: str) -> list[tuple[str, str]]:
    """Rules (allow or disallow, pattern) for all agents, in order: those below a User-agent line of *, up to the next one."""
    rules, everyone = [], False
    for line in text.split("\n"):
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            everyone = value == "*"
        elif everyone and key in ("allow", "disallow") and value:
            rules.append((key, value))
    return rules


def parse_robots_table(robots: DataFrame) -> DataFrame:
    """The same over a table (host, text): host, ord, type, pattern. A host's file is one row, so no shuffle is needed."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.alias("ord"), F.lower(F.trim(F.regexp_extract(x, r"^([^#:]*):", 1))).alias("key"), F.trim(F.regexp_replace(F.regexp_extract(x, r"^[^#:]*:([^#]*)", 1), "\r", "")).alias("value")))
    agents = F.filter(lines, lambda x: x.key == "user-agent")
    rows = robots.select("host", lines.alias("lines"), agents.alias("agents")).select("host", "agents", F.explode("lines").alias("line"))
    last = F.try_element_at(F.filter("agents", lambda a: a.ord < F.col("line.ord")), F.lit(-1))
    return rows.where(F.col("line.key").isin("allow", "disallow") & (F.col("line.value") != "") & (last.value == "*")).select("host", F.col("line.ord").alias("ord"), F.col("line.key").alias("type"), F.col("line.value").alias("pattern"))


def robots_regex(pattern: str) -> str:
    """* is anything, $ at the end is the end, all else is itself; without $ it is a prefix."""
    anchored = pattern.endswith("$")
    body = ".*".join(re.escape(x) for x in pattern.removesuffix("$").split("*"))
    return r"\A" + body + r"\z" * anchored


def robots_length(pattern: str) -> int:
    return len(pattern.removesuffix("*"))


def is_allowed(url: Column, rules: list[tuple[str, str]]) -> Column:
    """Of the rules that match, the one with the longest pattern decides, the first of equals; without one all is allowed."""
    def test(target):
        out = F.lit(True)
        for kind, pattern in _shortest_first(rules):
            out = F.when(target.rlike(robots_regex(pattern)), F.lit(kind == "allow")).otherwise(out)
        return out

    return urls.let(target_of(url), test)


def _shortest_first(rules):
    order = sorted(enumerate(rules), key=lambda r: (-robots_length(r[1][1]), r[0]))
    return [rule for _, rule in reversed(order)]


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"(?i)\A\s*(<!doctype\s+html|<html[\s>])")


def is_markdown_like(content_type: Column, text: Column, kinds=("markdown", "text/plain", "application/octet-stream")) -> Column:
    named = F.lit(False)
    for k in kinds:
        named = named | F.lower(F.coalesce(content_type, F.lit(""))).contains(k)
    return ~looks_like_html(text) & (named | F.ltrim(text).startswith("#"))


def is_llms_txt_like(content_type: Column, text: Column) -> Column:
    return is_markdown_like(content_type, text, ("markdown", "text/plain"))


def is_asset(url: Column) -> Column:
    return F.lower(urls.pathname(url)).rlike(r"\.(" + "|".join(ASSETS) + r")\z")


def is_utility(url: Column) -> Column:
    return urls.pathname(url).rlike("|".join(UTILITY))


def is_followable_href(href: Column) -> Column:
    return ~((href == "") | href.startswith("#") | href.startswith("mailto:") | href.startswith("tel:"))


def same_host(url: Column, other: Column) -> Column:
    return urls.hostname(url) == urls.hostname(other)


def is_error_page(markdown: Column) -> Column:
    body = F.length(F.trim(F.regexp_replace(markdown, r"(?m)^#[^\n]*\n*", "")))
    low = F.lower(markdown)
    return (body < 200) & (low.contains("page not found") | low.contains("404") | low.contains("not found"))


def reject_reason(url: Column, scope: Column, robots: list[tuple[str, str]] = (), include: list[Pattern] = (), exclude: list[Pattern] = ()) -> Column:
    """Why a link of the right host is not followed, by the first test that it fails; null if it is."""
    return (
        F.when(~urls.is_in_scope(url, scope), "scope").when(~is_allowed(url, list(robots)), "robots")
        .when(~is_included(url, list(include)), "include").when(is_excluded(url, list(exclude)), "exclude")
    )
