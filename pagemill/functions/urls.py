"""URL algebra as Column functions, after the WHATWG URL standard for http and https."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP = r"^(?i:https?)://[^/?#\s]+"
#: Percent-encodings that url_encode makes and the standard's path set does not.
PLAIN_IN_PATH = {
    "%2F": "/", "%2C": ",", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~", "%3A": ":", "%3B": ";", "%40": "@", "%26": "&", "%3D": "=",
    "%2B": "+", "%24": "$", "%2A": "*", "%5B": "[", "%5D": "]", "%7C": "|", "%25": "%",
}
#: What encodeURIComponent leaves alone and url_encode does not.
PLAIN_IN_COMPONENT = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once and the expression no larger than its parts."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _undo(column: Column, table: dict[str, str]) -> Column:
    for code, char in table.items():
        column = F.replace(column, F.lit(code), F.lit(char))
    return column


def encode_component(text: Column) -> Column:
    """encodeURIComponent."""
    return _undo(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), PLAIN_IN_COMPONENT)


def encode_path(path: Column) -> Column:
    """Percent-encodes what a path may not hold; the common path, which has nothing of that, is returned as it is."""
    return F.when(path.rlike(r"[^!-~]|[\"<>`{}^]"), _undo(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), PLAIN_IN_PATH)).otherwise(path)


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(HTTP), F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def hostname(url: Column) -> Column:
    """Lower-case host without port; empty for what is no http URL."""
    return F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def port(url: Column) -> Column:
    """":port", empty for the scheme's default."""
    p = F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?[^/?#:]+(:\d+)", 1)
    return F.when(F.concat(scheme(url), p).isin("http:80", "https:443"), "").otherwise(p)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), hostname(url), port(url))


def _without_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def pathname(url: Column) -> Column:
    def of(raw):
        dotted = F.when(raw.rlike(r"/\.\.?(/|$)"), _without_dots(raw)).otherwise(raw)
        return F.when(raw.rlike(r"\A/[!-~&&[^\"<>`{}^\\]]*\z") & ~raw.rlike(r"/\.\.?(/|$)"), raw).when(raw == "", "/").otherwise(let(F.translate(dotted, "\\", "/"), encode_path))

    return let(F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^?#]*)", 1), of)


def search(url: Column) -> Column:
    """"?query", empty without one or with an empty one."""
    table = PLAIN_IN_PATH | {"%3F": "?", "%7B": "{", "%7D": "}", "%60": "`", "%5E": "^", "%5C": "\\"}

    def of(q):
        encoded = F.when(q.rlike(r"[^!-~]|[\"<>']"), _undo(F.replace(F.url_encode(q), F.lit("+"), F.lit("%20")), table)).otherwise(q)
        return F.when(q == "?", "").otherwise(encoded)

    return let(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), of)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(#.*)$", 1)


def canonical(url: Column) -> Column:
    """The URL as the standard serialises it; null if it is no http URL."""
    return let(url, lambda u: F.when(is_http(u), F.concat(origin(u), pathname(u), search(u), fragment(u))))


def resolve(href: Column, base: Column) -> Column:
    """href relative to base, serialised; null if the result is no http URL."""

    def joined(href, base):
        directory = F.regexp_replace(pathname(base), "[^/]*$", "")
        return (
            F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
            .when(href.startswith("/"), F.concat(origin(base), href))
            .when(href.startswith("?"), F.concat(origin(base), pathname(base), href))
            .when(href.startswith("#") | (href == ""), F.concat(origin(base), pathname(base), search(base), href))
            .otherwise(F.concat(origin(base), directory, href))
        )

    return let(F.struct(href.alias("h"), base.alias("b")), lambda v: canonical(joined(F.trim(v.h), v.b)))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def normalize_url(url: Column, keep_query: bool = False) -> Column:
    """Without fragment, and without query unless kept; what is no URL stays as it is."""
    return F.when(is_http(url), F.concat(origin(url), pathname(url), search(url) if keep_query else F.lit(""))).otherwise(url)


def prefix_score(url: Column, ref_path: Column) -> Column:
    """Number of equal leading path segments of the URL and a path; 0 for what is no URL."""
    a, b = segments(pathname(url)), segments(ref_path)
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(is_http(url), F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1)).otherwise(0)


def is_in_scope(url: Column, scope: Column) -> Column:
    return (scope == "/") | (is_http(url) & let(pathname(url), lambda p: (p == scope) | p.startswith(F.concat(scope, F.lit("/")))))


def default_scope(host: Column, path: Column) -> Column:
    s = segments(path)
    return F.when((host == "github.com") & (F.size(s) >= 2), F.concat(F.lit("/"), F.get(s, 0), F.lit("/"), F.get(s, 1))).when(host == "github.com", path).otherwise("/")


def url_to_rel_path(url: Column, keep_query: bool = False) -> Column:
    p = F.regexp_replace(pathname(url), "^/+|/+$", "")
    name = F.when(p == "", "index").otherwise(p)
    if keep_query:
        name = F.concat(name, encode_component(search(url)))
    return F.when(is_http(url), F.concat(name, F.lit(".md")))


def markdown_candidates(url: Column) -> Column:
    """Where a page's hosted Markdown may lie, in order; empty for what is no URL."""
    p, rest = pathname(url), F.concat(search(url), fragment(url))
    bare = F.regexp_replace(p, "/+$", "")
    at = lambda path: F.concat(origin(url), path, rest)
    beside = F.when(bare == "", F.lit("/index.md")).otherwise(F.concat(bare, F.lit(".md")))
    many = F.array_distinct(F.array_compact(F.array(at(beside), F.when(p.endswith("/"), at(F.concat(bare, F.lit("/index.md")))))))
    return F.when(~is_http(url), F.array().cast("array<string>")).when(p.rlike(r"(?i)\.(md|markdown|txt)$"), F.array(at(p))).otherwise(many)


def llms_txt_candidates(url: Column) -> Column:
    """Where a site's index for language models may lie, from the URL's own directory up to the root."""
    s = segments(pathname(url))
    s = F.when(F.try_element_at(s, F.lit(-1)).rlike(r"\.[^.]+$") & (F.size(s) > 0), F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - 1))).otherwise(s)
    each = F.transform(F.sequence(F.size(s), F.lit(0), F.lit(-1)), lambda n: F.concat(origin(url), F.lit("/"), F.array_join(F.concat(F.slice(s, F.lit(1), n), F.array(F.lit("llms.txt"))), "/")))
    return F.when(is_http(url), F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def strip_markdown_suffix(url: Column) -> Column:
    """Without a trailing .md or .markdown of the path."""
    p = F.regexp_replace(pathname(url), r"(?i)\.(md|markdown)$", "")
    return F.when(is_http(url), F.concat(origin(url), p, search(url), fragment(url))).otherwise(url)


def directory_name(url: Column, fallback: str = "docs") -> Column:
    return F.when(is_http(url), hostname(url)).otherwise(fallback)


def shorten_url(url: Column) -> Column:
    p = pathname(url)
    short = F.when(F.length(p) > 50, F.concat(F.substring(p, 1, 25), F.lit("..."), F.right(p, F.lit(22)))).otherwise(p)
    return F.when(is_http(url), F.concat(hostname(url), port(url), short)).otherwise(url)


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def group_key(url: Column, level: int) -> Column:
    return F.concat(origin(url), F.lit("/"), F.array_join(F.slice(segments(pathname(url)), 1, level), "/"))


def outlink_key(url: Column) -> Column:
    return F.concat(origin(url), pathname(url))


def rel_path_to_url(path: Column, host: Column) -> Column:
    p = F.regexp_replace(path, r"\.md$", "")
    p = F.when(p == "index", "").otherwise(F.regexp_replace(p, "/index$", "/"))
    return F.concat(F.lit("https://"), host, F.lit("/"), p)


def alternate_slash(url: Column) -> Column:
    """What is tried after a page was not found: the URL with its trailing slash toggled."""
    return F.when(url.endswith("/"), F.regexp_replace(url, "/$", "")).otherwise(F.concat(url, F.lit("/")))


def relative_link(target: Column, current: Column) -> Column:
    """Path of one file from the folder of another, both relative to the same root."""
    a = F.split(F.regexp_replace(current, "[^/]*$", ""), "/")
    a, b = F.slice(a, 1, F.size(a) - 1), F.split(target, "/")
    same = F.zip_with(a, F.slice(b, 1, F.greatest(F.lit(0), F.size(b) - 1)), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    k = F.when(first == 0, F.least(F.size(a), F.size(b) - 1)).otherwise(first - 1)
    up = F.repeat(F.lit("../"), F.size(a) - k)
    out = F.concat(up, F.array_join(F.slice(b, k + 1, F.size(b) - k), "/"))
    return F.when(out.startswith("."), out).otherwise(F.concat(F.lit("./"), out))


def title_from_markdown(markdown: Column, url: Column) -> Column:
    """The first level-one heading, else the last path segment in words, else "Documentation"."""
    head = F.trim(F.regexp_extract(markdown, r"(?m)^#[ \t]+(.+)$", 1))
    last = F.translate(F.try_element_at(segments(pathname(url)), F.lit(-1)), "-_", "  ")
    words = F.array_join(F.transform(F.split(last, r"\b"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")
    return F.when(head != "", head).when(is_http(url) & (F.size(segments(pathname(url))) > 0), words).otherwise("Documentation")
