"""URL algebra, predicates, Markdown filters, HTML conversion, links, traversal, cache and trees on small inline tables."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import html, markdown, predicates, urls
from pagemill.operators import crawl, links
from pagemill.plans import extract
from pagemill.sources import store


def value(spark, column, **cells):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items())) if cells else spark.range(1)
    return df.select(column.alias("v")).first()["v"]




@pytest.mark.parametrize(
    ("f", "u", "want"),
    [
        (lambda: urls.normalize_url(F.col("u")), "https://A.example:443/x/?q=1#h", "https://a.example/x/"),
        (lambda: urls.normalize_url(F.col("u"), True), "https://a.example/x?q=1#h", "https://a.example/x?q=1"),
        (lambda: urls.normalize_url(F.col("u")), "no url", "no url"),
        (lambda: urls.normalize_url(F.col("u")), "https://a.example", "https://a.example/"),
        (lambda: urls.normalize_url(F.col("u")), "https://a.example/a/./b/../für d", "https://a.example/a/f%C3%BCr%20d"),
        (lambda: urls.prefix_score(F.col("u"), F.lit("/a/b/c")), "https://h.example/a/b/x", 2),
        (lambda: urls.prefix_score(F.col("u"), F.lit("/a/x/c")), "https://h.example/a/b/c", 1),
        (lambda: urls.prefix_score(F.col("u"), F.lit("/")), "https://h.example/a", 0),
        (lambda: urls.prefix_score(F.col("u"), F.lit("/a")), "https://h.example/a/b", 1),
        (lambda: urls.is_in_scope(F.col("u"), F.lit("/o/repo")), "https://h.example/o/repo-fork", False),
        (lambda: urls.is_in_scope(F.col("u"), F.lit("/o/repo")), "https://h.example/o/repo/x", True),
        (lambda: urls.is_in_scope(F.col("u"), F.lit("/")), "https://h.example/", True),
        (lambda: urls.default_scope(urls.hostname(F.col("u")), urls.pathname(F.col("u"))), "https://github.com/o/r/tree/x", "/o/r"),
        (lambda: urls.default_scope(urls.hostname(F.col("u")), urls.pathname(F.col("u"))), "https://a.example/x", "/"),
        (lambda: urls.url_to_rel_path(F.col("u")), "https://a.example", "index.md"),
        (lambda: urls.url_to_rel_path(F.col("u")), "https://a.example/a/b/", "a/b.md"),
        (lambda: urls.url_to_rel_path(F.col("u"), True), "https://a.example/a?x=1&y=a b", "a%3Fx%3D1%26y%3Da%2520b.md"),
        (lambda: urls.markdown_candidates(F.col("u")), "https://a.example/d/", ["https://a.example/d.md", "https://a.example/d/index.md"]),
        (lambda: urls.markdown_candidates(F.col("u")), "https://a.example/x.MD?q", ["https://a.example/x.MD?q"]),
        (lambda: urls.markdown_candidates(F.col("u")), "https://a.example/", ["https://a.example/index.md"]),
        (lambda: urls.llms_txt_candidates(F.col("u")), "https://a.example/a/b.html", ["https://a.example/a/llms.txt", "https://a.example/llms.txt"]),
        (lambda: urls.llms_txt_candidates(F.col("u")), "https://a.example/", ["https://a.example/llms.txt"]),
        (lambda: urls.strip_markdown_suffix(F.col("u")), "https://a.example/x.markdown", "https://a.example/x"),
        (lambda: urls.resolve(F.lit("../c?x#y"), F.col("u")), "https://a.example/a/b/d", "https://a.example/a/c?x#y"),
        (lambda: urls.resolve(F.lit("//b.example/z"), F.col("u")), "https://a.example/a", "https://b.example/z"),
        (lambda: urls.resolve(F.lit("mailto:x@y"), F.col("u")), "https://a.example/a", None),
        (lambda: urls.rel_path_to_url(F.col("u"), F.lit("h.example")), "a/index.md", "https://h.example/a/"),
        (lambda: urls.rel_path_to_url(F.col("u"), F.lit("h.example")), "index.md", "https://h.example/"),
        (lambda: urls.relative_link(F.lit("a/c.md"), F.col("u")), "a/b.md", "./c.md"),
        (lambda: urls.relative_link(F.lit("c.md"), F.col("u")), "a/x/b.md", "../../c.md"),
        (lambda: urls.alternate_slash(F.col("u")), "https://a.example/x/", "https://a.example/x"),
        (lambda: urls.title_from_markdown(F.lit("text"), F.col("u")), "https://a.example/get-started", "Get Started"),
        (lambda: urls.group_key(F.col("u"), 1), "https://a.example/a/b", "https://a.example/a"),
    ],
)
def test_urls(spark, f, u, want):
    assert value(spark, f(), u=u) == want


def test_patterns_and_robots(spark):
    assert predicates.parse_patterns("/docs/, a ,,/b.c/gi") == [predicates.Pattern("docs", True), predicates.Pattern("a"), predicates.Pattern("(?i)b.c", True)]
    text = "User-agent: X\nDisallow: /no\nUser-agent: *\nDisallow: /a # c\nAllow: /a/b\nDisallow:\nDisallow: /*.pdf$\nAllow: /tie\nDisallow: /tie\n"
    rules = predicates.parse_robots(text)
    assert rules == [("disallow", "/a"), ("allow", "/a/b"), ("disallow", "/*.pdf$"), ("allow", "/tie"), ("disallow", "/tie")]
    table = predicates.parse_robots_table(spark.createDataFrame([("h", text)], "host string, text string")).orderBy("ord").collect()
    assert [(r.type, r.pattern) for r in table] == rules
    for path, allowed in (("/a/x", False), ("/a/b/c", True), ("/no", True), ("/x.pdf", False), ("/x.pdf?q", True), ("/tie", True)):
        assert value(spark, predicates.is_allowed(F.col("u"), rules), u=f"https://h.example{path}") is allowed
    inc = predicates.parse_patterns("q=1")
    assert value(spark, predicates.is_included(F.col("u"), inc), u="https://h.example/?q=1") and not value(spark, predicates.is_excluded(F.col("u"), []), u="https://h.example/")
    reason = predicates.reject_reason(F.col("u"), F.lit("/s"), rules, [], predicates.parse_patterns("zip"))
    assert value(spark, reason, u="https://h.example/t/zip") == "scope" and value(spark, reason, u="https://h.example/s/zip") == "exclude"
    assert value(spark, predicates.looks_like_html(F.col("u")), u=" <!DOCTYPE html>") and value(spark, predicates.is_markdown_like(F.lit(None).cast("string"), F.col("u")), u="# x")
    assert value(spark, predicates.is_error_page(F.col("u")), u="# 404\nPage not found")


CODE = "```\nCopyright 2024\n---\n  latest\n```"


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (markdown.clean_markdown, "a\n\n\n\nb  \n   \nc\n", "a\n\nb\n\nc"),
        (markdown.filter_navigation, "A > B > C\n[Skip Navigation](#x)t\n![](i.png)\n![c](i.png)\nkeep ![c](i.png)", "t\nkeep ![c](i.png)"),
        (markdown.filter_legal_boilerplate, f"Copyright © 2020 X\n© 2021\nAll Rights reserved.\nTerms of Use | Privacy Policy\nx\n{CODE}", f"x\n{CODE}"),
        (markdown.filter_empty_sections, "### A\n\n### B\ntext\n## C\n### End", "\n### B\ntext\n## C"),
        (markdown.filter_empty_sections, "### A\n#### B\nx", "#### B\nx"),
        (markdown.filter_empty_sections, "###\nx\n### C\n```\n### D\n```", "###\nx\n### C\n```\n### D\n```"),
        (markdown.filter_formatting_artifacts, f"a\n---\n===\n**\n**b**\n{CODE}", f"a\n**b**\n{CODE}"),
        (markdown.clean_whitespace, "a  b\n\n\n\nc  \n```\n    x\n```", "a b\n\nc\n```\n x\n```"),
        (markdown.strip_fallback_chrome, f"latest\nSystem requirements\nSearch ⌘K\nOn this page\nkeep\n{CODE}", f"keep\n{CODE}"),
        (markdown.vendor_rules, "Microsoft Learn\n5 min\nFeedback\nkeep", "Microsoft Learn\nkeep"),
        (markdown.vendor_rules, "5 min\nkeep", "5 min\nkeep"),
        (markdown.deduplicate_content, "p\n\np\n\n# h\n\n# h\n\n### k\n### k\n```\np\n\np\n```", "p\n\n# h\n\n### k\n### k\n```\np\n\np\n```"),
    ],
)
def test_markdown(spark, f, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"] == want


def test_filter_markdown(spark):
    df = spark.createDataFrame([(1, "latest\nHome > A > B\n\npara\n\npara\n\n### Empty\n"), (2, None)], "id long, markdown string")
    assert {r.id: r.markdown for r in markdown.filter_markdown(df, aggressive_chrome=True).collect()} == {1: "para", 2: None}


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("<p><b>one<br><p>two</p>", "**one**\n\n**two**"),
        ("<h2>T <em>x</em></h2><ul><li>a<li>b</ul>", "## T x\n\n-   a\n-   b"),
        ('<pre><code class="language-py">x = 1\n  y</code></pre>', "```py\nx = 1\n  y\n```"),
        ('<a href="/x" title="t">go</a> <a href="/y"></a>', '[go](https://h.example/x "t")'),
        ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"),
        ("<p>x</p><script>var t='</p>'</script><div hidden>no</div><span style='display: none'>no</span>", "x"),
        ("<ol><li>a</li><li>b</li></ol><blockquote><p>q</p></blockquote>", "1.  a\n2.  b\n\n> q"),
    ],
)
def test_html(source, want):
    assert html.extract(f"<html><body>{source}</body></html>", "https://h.example/p")[1] == want


def test_page(spark):
    body = "<article><header><h1>Gone</h1></header><p>" + "word " * 150 + '</p><div class="toc">toc</div></article><div class="ad">ad</div>'
    page = f'<html><head><title> The  page </title></head><body><nav><a href="/a?x#y">A</a><a href="/login">L</a><a href="/b.png">B</a></nav>{body}</body></html>'
    r = extract.extract_markdown(spark.createDataFrame([(1, "https://h.example/d/", page), (2, "https://h.example/e", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert r[0].title == "The page" and r[0].links == ["https://h.example/a?x"] and r[0].markdown.startswith("# The page\n\nword") and "toc" not in r[0].markdown and "ad" not in r[0].markdown.split()
    assert r[1].markdown == ""


def test_md_links_reads_the_whole_text(spark, tmp_path):
    from pagemill.plans import core_queries

    texts = [(1, "plain"), (2, None), (3, "[k](/own) https://h.example/bare\n[e](https://else.example/)"), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.pos, r.link) for r in core_queries.md_links(spark, str(tmp_path)).collect())
    h = "https://h.example"
    same = lambda k: [(k, 0, f"{h}/d/{k}"), (k, 1, f"{h}/y"), (k, 2, f"{h}/z")]
    assert got == sorted([*same(1), *same(2), (3, 0, f"{h}/own"), (3, 1, f"{h}/d/3"), (3, 2, f"{h}/y"), (3, 3, f"{h}/bare"), (3, 4, f"{h}/z"), *same(4)])


def test_markdown_links(spark):
    md = '[a](b.md "t") [c](https://h.example/c#x) ![i](/i.png) <https://h.example/d> https://h.example/e [o](https://other.example/) [m](mailto:x)'
    got = links.markdown_links(spark.createDataFrame([(md, "https://h.example/x/y")], "markdown string, url string")).orderBy("pos").collect()
    assert [r.link for r in got] == ["https://h.example/x/b", "https://h.example/c", "https://h.example/d", "https://h.example/e"]


def test_rewriting(spark, tmp_path):
    files = spark.createDataFrame([("h.example", "a/b.md", '[x](https://h.example/a/c?q#f "t") [y](https://h.example/none) [z](./gone.md#s) [w](c.md)'), ("h.example", "a/c.md", "plain")], "host string, rel_path string, content string")
    got = {r.rel_path: r for r in links.fix_links(files).collect()}
    assert got["a/b.md"].content == '[x](./c.md "t") [y](https://h.example/none) [z](https://h.example/a/gone#s) [w](c.md)' and got["a/b.md"].changed and not got["a/c.md"].changed
    assert store.write_tree(files, str(tmp_path)).first().files == 2
    back = store.read_tree(spark, str(tmp_path)).orderBy("rel_path").collect()
    assert [(r.host, r.rel_path) for r in back] == [("h.example", "a/b.md"), ("h.example", "a/c.md")] and back[1].content == "plain"


def test_outlinks(spark):
    found = spark.createDataFrame([("f1", "https://h.example/x?1"), ("f1", "https://h.example/x?2"), ("f2", "https://h.example/x"), ("f2", "https://h.example/there")], "file string, link string")
    out = links.outlinks(found, spark.createDataFrame([("h.example", "there.md")], "host string, rel_path string"))
    assert [tuple(r) for r in out.collect()] == [("https://h.example/x", 2)]
    assert [tuple(r) for r in links.group_outlinks(out, 1).collect()] == [("https://h.example/x", 2)]


def test_crawl(spark):
    site = "https://h.example"
    edges = [("/d/", "/d/a"), ("/d/", "/other"), ("/d/", "/d/b"), ("/d/a", "/d/"), ("/d/a", "/d/c"), ("/d/b", "/d/c"), ("/d/c", "/d/deep"), ("/lost", "/d/x")]
    df = spark.createDataFrame([(site + a, site + b, k) for k, (a, b) in enumerate(edges)], "url string, link string, ord long")
    r = crawl.crawl(f"{site}/d/", df, crawl.CrawlOptions(depth=2, max_urls=4))
    assert {x.url.removeprefix(site): x.depth for x in r.seen.collect()} == {"/d/": 0, "/d/a": 1, "/d/b": 1, "/other": 1} and {x.url for x in r.capped.collect()} == {f"{site}/d/c"}
    r = crawl.crawl(f"{site}/d/", df, crawl.CrawlOptions(depth=3, scope="/d", exclude=predicates.parse_patterns("deep")))
    assert {x.url.removeprefix(site): x.depth for x in r.seen.collect()} == {"/d/": 0, "/d/a": 1, "/d/b": 1, "/d/c": 2}
    assert {(x.url.removeprefix(site), x.reason) for x in r.filtered_out.collect()} == {("/other", "scope"), ("/d/deep", "exclude")}
    assert {x.url.removeprefix(site): x.depth for x in crawl.reachable(df.select(F.col("url").alias("src"), F.col("link").alias("dst")), f"{site}/d/", 3).collect()}["/d/deep"] == 3


def test_cache_and_stream(spark, tmp_path):
    from pagemill.streaming import incremental

    pages = spark.createDataFrame([(1, "https://h.example/a", "<title>A</title><p>x"), (2, "https://i.example/b", "<p>y")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/in")
    incremental.extract_stream(incremental.page_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/cache", f"{tmp_path}/state").awaitTermination()
    store.cache_write(extract.extract_markdown(pages.where("page_id = 1")), f"{tmp_path}/cache")
    got = store.cache_read(spark, f"{tmp_path}/cache")
    assert got.count() == 2 and store.cache_read(spark, f"{tmp_path}/cache", -1).count() == 0
    hit, miss = store.with_cache(pages.union(spark.createDataFrame([(3, "https://h.example/new", "")], pages.schema)), got)
    assert hit.count() == 2 and [r.page_id for r in miss.collect()] == [3]
    assert {r.hostname: r.entries for r in store.cache_stats(spark, f"{tmp_path}/cache").collect()} == {"h.example": 2, "i.example": 1}
    assert store.cache_clear(spark, f"{tmp_path}/cache", "h.example") == 2 and store.cache_read(spark, f"{tmp_path}/cache").count() == 1


def test_hosted(spark):
    pages = spark.createDataFrame([("https://h.example/d/",), ("https://h.example/e",)], "url string")
    hosted = spark.createDataFrame([("https://h.example/d.md", "text/html", "<html>"), ("https://h.example/d/index.md", None, "# Hi  \n\n\n\nx")], "url string, content_type string, text string")
    assert [tuple(r) for r in extract.prefer_hosted(pages, hosted).collect()] == [("https://h.example/d/", "# Hi\n\nx")]


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "page_outlinks" in entry.queries()


def test_nesting_has_no_limit():
    deep = "<div>" * 3000 + "<ul><li>" * 200 + "x" + "</div>" * 10
    assert html.extract(f"<body>{deep}</body>", "https://h.example/")[1].strip().endswith("x")
    assert "word" in html.extract("<body>" + "<p><b>word<br>" * 400 + "</body>", "https://h.example/")[1]


def test_open_formatting_is_bounded():
    out = html.extract("<body>" + "<p><b>word</p>" * 200 + "</body>", "https://h.example/")[1]
    assert out.count("word") == 200 and len(out) < 200 * 30


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a*b [c] d_e `f` \\</p>", r"a\*b \[c\] d\_e \`f\` " + "\\\\"),
        ("<p># no heading</p><p>1. no list</p><p>- no list</p><p>a # b</p>", "\\# no heading\n\n1\\. no list\n\n\\- no list\n\na # b"),
        ("<pre><code>a*b</code></pre>", "```\na*b\n```"),
        ("<p><code>a_b</code></p>", "`a_b`"),
        ("<dl><dt>loose <span>a</span><span>b</span><span>a</span></dt></dl>", "a · b"),
        ("<dl><dt>kept <span> </span></dt></dl>", "kept"),
        ("<h2>a <a href='/x'>b</a></h2>", "## a b"),
        ("<p>x<span class='sr-only'>gone</span></p><p data-markdown='remove'>gone</p>", "x"),
        ("<div hidden><pre><code>kept</code></pre></div><div hidden>gone</div>", "```\nkept\n```"),
        ("<div class='PageFeedback-1'>gone</div><p>x</p>", "x"),
        ("<ul><li><h5>Example</h5><pre><code>a</code></pre></li></ul>", "-   ```\n    a\n    ```"),
        ("<div class='cm-editor' data-language='js'><div class='cm-content'><div class='cm-line'>a</div><div class='cm-line'>b</div></div></div>", "```js\na\nb\n```"),
        ("<div class='my-CodeBlock'><button>Copy</button><pre><code>a</code></pre></div>", "```\na\n```"),
        ("<dl><dt><div class='PropertyDetail'><button>name</button></div><div class='PropertyDetail'><span>string</span> more</div></dt></dl>", "name · string"),
    ],
)
def test_rules_of_pages(source, want):
    assert html.extract(f"<html><body>{source}</body></html>", "https://h.example/p")[1] == want


def test_learn_chrome_goes_from_its_host_only():
    page = "<html><body><div id='article-metadata'>meta</div><p>x</p></body></html>"
    assert html.extract(page, "https://learn.microsoft.com/a")[1] == "x"
    assert html.extract(page, "https://h.example/a")[1] == "meta\n\nx"


def test_raw_length_is_that_after_the_rules():
    assert html.extract("<!DOCTYPE html><html><head></head><body><p>a&amp;b 😀</p></body></html>", "https://h.example/")[3] == len("<!DOCTYPE html><html><head></head><body><p>a&amp;b 😀</p></body></html>") + 1
    assert html.extract("<html><body><p>x</p><i class='sr-only'>gone</i></body></html>", "https://h.example/")[3] == len("<html><body><p>x</p></body></html>")


def test_deduplicate_against_lines_in_order():
    """Against a plain reading of the rules: a paragraph or heading goes if it was there, then blank lines are merged."""
    import random

    pick = random.Random(4)
    for _ in range(300):
        text = "\n".join(pick.choice(["a", "b", " a ", "", "", "# h", "## h", "### k", "#tag", "```", "\u00a0"]) for _ in range(pick.randrange(1, 25)))
        want, seen, run, code = [], set(), [], False
        for line in [*text.split("\n"), None]:
            bare = None if line is None else line.strip()
            prose = bool(bare) and not code and bare[0] != "#" and bare[:3] != "```"
            if run and not prose:
                if (k := "\n".join(run).strip()) not in seen:
                    want += run
                seen.add(k)
                run = []
            if line is None:
                break
            if prose:
                run.append(line)
            elif code or bare[:3] == "```":
                code ^= bare[:3] == "```"
                want.append(line)
            elif not bare:
                want += [""] if want and want[-1] != "" else []
            elif not (bare[:2] in ("# ", "##") and bare[:3] != "###" and " " in bare[:3]) or ("h", bare) not in seen:
                seen.add(("h", bare))
                want.append(line)
        assert markdown.deduplicate_text(text) == "\n".join(want), text


def test_dropping_lines_reads_texts_without_a_match_as_they_are(spark):
    texts = ["a > b > c", "x\n  a > b > c \ny", "a >\nb >\nc", "a > b\n> c", "```\na > b > c\n```", "plain", "", "\u00a0![x](y)\u2003\nz", "a\r> b > c"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(markdown.drop_lines(F.col("t"), markdown.NAVIGATION_LINES)).collect()]
    assert got == ["", "x\ny", "a >\nb >\nc", "a > b\n> c", "```\na > b > c\n```", "plain", "", "z", ""]


def test_crawl_command_reads_the_cache_and_tries_the_other_slash(spark, tmp_path, monkeypatch):
    from pagemill.plans import cli

    page = "<html><head><title>{0}</title></head><body><p>" + "text of {0} " * 30 + "</p>{1}</body></html>"
    rows = [
        (1, "https://h.example/d/", page.format("start", '<a href="/d/a">a</a><a href="/d/b/">b</a><a href="/d/none">n</a>')),
        (2, "https://h.example/d/a", page.format("first", "")),
        (3, "https://h.example/d/b", page.format("second", '<a href="/d/c">c</a>')),
        (4, "https://h.example/d/c", page.format("third", "")),
        (5, "https://h.example/d/other", page.format("other", "")),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    monkeypatch.setenv("PAGEMILL_CACHE_DIR", f"{tmp_path}/cache")
    call = lambda out, *more: cli.run_crawl(spark, cli.parser().parse_args(["crawl", "https://h.example/d/", "--pages", f"{tmp_path}/pages", "-o", f"{tmp_path}/{out}", "-d", "2", *more]))
    first = call("one")
    assert (first["files"], first["pages"], first["errors"], first["from_cache"]) == (4, 4, 1, 0)
    again = call("two")
    assert (again["files"], again["pages"], again["from_cache"]) == (4, 4, 4) and again["total_bytes"] == first["total_bytes"]
    assert {r.rel_path for r in store.read_tree(spark, f"{tmp_path}/two/h.example", "h.example").collect()} == {"d.md", "d/a.md", "d/b.md", "d/c.md"}


def against_sql(spark, folder, name, **tables):
    """The query's rows and those of its SQL, over tables of (schema, rows)."""
    import duckdb
    from pagemill.plans import core_queries

    sql = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    return order(core_queries.QUERIES[name](spark, str(folder)).collect()), order(sql.execute(core_queries.ORACLE[name]).fetchall())


@pytest.mark.parametrize(("name", "rows"), [("doc_filter_markdown", 2), ("doc_filter_injected", 5)])
def test_documents_of_which_nothing_is_left(spark, tmp_path, name, rows):
    texts = ["All rights reserved.", "All rights reserved.\nall rights reserved", None, "", "x", "All rights reserved.\ny\nAll rights reserved."]
    got, want = against_sql(spark, tmp_path, name, documents=("doc_id long, text string", list(enumerate(texts))))
    assert got == want and len(got) == rows


def test_pages_with_equal_candidates_keep_their_own_text(spark, tmp_path):
    addresses = ["https://h.example/x", "https://h.example/x/", "https://h.example/x", "https://h.example/", "https://h.example", "https://h.example/y.md"]
    got, want = against_sql(spark, tmp_path, "hosted_markdown", pages=("page_id long, url string", list(enumerate(addresses))))
    assert got == want and len({digest for _, digest in got}) == len(addresses)


def test_titles_with_references_that_are_cut_off(spark, tmp_path):
    titles = ["a &amp", "a &amp; b &quo", "&lt;x&gt; &quot;&#x27;&amp;lt;", "&copy; a &ampx", " a \n b "]
    pages = [(k, "https://h.example/", f"<html><head><title>{x}</title></head><body>&amp</body></html>") for k, x in enumerate(titles)]
    got, want = against_sql(spark, tmp_path, "page_title", pages=("page_id long, url string, html string", [*pages, (9, "https://h.example/", None), (10, "https://h.example/", "<p>x")]))
    assert got == want and dict(got)[0] == "a &amp"
    assert html.extract(pages[0][2], pages[0][1])[0] == "a &"


def test_filters_line_by_line_are_the_column_functions(spark):
    import random

    pick = random.Random(5)
    pool = ["a", " b  c ", "", "", " ", "# h", "## h", "### k", "#### é", "###", "  ### z", "```", " ```x", "``` > a > b", "a > b > c", "> a > b > c", "![x](y)", "Copyright 2024", "© 2020 x", "All Rights reserved.", "ALL RIGHTſ RESERVED", "---", "**", "* _"]
    pool += ["Terms of Use | Privacy Policy", "latest", "Search ⌘K", "Search ⌘", "[a](b)[c](d)", "skip NAVIGATION", "[Skip Navigation](#x)t", "bacskip navigationk to x](y)", "Current page is here", "[Back to", "the top](#t) x", " Dark \r", "Edit Page now", "\t"]
    texts = [(k, "\n".join(pick.choice(pool) for _ in range(pick.randrange(1, 14)))) for k in range(1500)]
    text = F.col("t")
    for step in (markdown.strip_fallback_chrome, markdown.filter_navigation, markdown.filter_legal_boilerplate, markdown.filter_empty_sections, markdown.filter_formatting_artifacts):
        text = step(text)
    want = {r.k: r.v for r in spark.createDataFrame(texts, "k int, t string").select("k", text.alias("v")).collect()}
    wrong = [(t, got, to) for k, t in texts if (got := markdown.filter_text(t, aggressive_chrome=True)) != (to := markdown.clean_whitespace_text(markdown.deduplicate_text(want[k])))]
    assert not wrong, wrong[0]


def test_slices_hold_every_row_and_few_bytes():
    import pyarrow as pa

    from pagemill.functions import batches

    texts = pa.array(["x" * n for n in (0, 5, 900_000, 200_000, 3_000_000, 1)] + [None] * 600 + ["end"])
    for parts in (list(batches.slices(texts)), [x.column(0) for x in batches.slices(pa.record_batch({"t": texts}), 0)]):
        assert pa.concat_arrays(parts) == texts and all(len(x) <= 256 and (len(x) == 1 or sum(len(t or "") for t in x.to_pylist()) <= 1_000_000) for x in parts)
    assert not list(batches.slices(pa.array([], pa.string())))


def test_repeated_paragraphs_of_a_batch_go_slice_by_slice(spark, tmp_path):
    import pyarrow as pa

    from pagemill.functions import batches

    seen = []
    parts = batches.in_slices(iter([pa.record_batch({"k": range(20), "t": ["p" * 300_000] * 20})]), 1, lambda t: seen.append(t) or markdown.deduplicate_text(t))
    assert next(parts).num_rows == len(seen) == 3 and sum(x.num_rows for x in parts) == 17
    texts = ["a\nb\na", None, "", "a\n a", "b\nb\nc"]
    got, want = against_sql(spark, tmp_path, "doc_paragraph_dedup", documents=("doc_id long, text string", list(enumerate(texts))))
    assert got == want and len(got) == 4


def test_links_of_a_batch_are_rewritten_slice_by_slice():
    import pyarrow as pa

    size = 300_000
    rows = [{"host": "h", "rel_path": f"{k}.md", "content": f"[a](/x \"t\") [b](/y){'z' * size}", "old": ["/x"] if k % 2 else None, "new": ["./x.md"] if k % 2 else None} for k in range(9)]
    parts = list(links._applied(iter([pa.RecordBatch.from_pylist([*rows, {"host": "h", "rel_path": "n.md", "content": None, "old": ["/x"], "new": ["/y"]}])])))
    assert [x.num_rows for x in parts] == [3, 3, 4]
    got = [c and c[:-size] for x in parts for c in x.column(2).to_pylist()]
    assert got == [*(['[a](/x "t") [b](/y)', '[a](./x.md "t") [b](/y)'] * 5)[:9], None]
