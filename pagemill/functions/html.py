"""HTML to Markdown: a tree of elements from tag soup, rules over the tree, and a visitor that writes Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

#: Kinds of elements, and what the rules look for.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
BLOCKS = ENDS_P | {"body", "dd", "dt", "html", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "figcaption", "summary"}
SCOPE = {"table", "td", "th", "caption", "html", "body", "button"}
ROOTS = [".sl-markdown-content", ".markdown-body", ".docs-content", ".doc-content", ".content-body", "#content", ".content", "main article", "article", "main", "[role=main]"]
CHROME_TAGS = {"nav", "header", "footer"}
CHROME_CLASSES = {"sidebar", "nav", "header", "footer", "version-selector", "theme-toggle", "search-bar", "table-of-contents", "toc", "page-nav", "edit-page", "skip-to-content"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary"}
JUNK = {"script", "style", "svg", "nav", "footer", "noscript", "iframe"}
HIDDEN_CLASSES = {"visuallyHidden", "sr-only", "visually-hidden"}
LEARN_IDS = {
    "ms--content-header", "center-doc-outline", "side-doc-outline", "ms--ai-summary", "ms--inline-notifications", "article-metadata", "article-metadata-footer", "site-user-feedback-footer", "right-rail-training-mobile",
    "right-rail-recommendations-mobile", "right-rail-events-mobile", "ms--additional-resources-mobile", "action-panel",
}
#: What has a meaning in Markdown, anywhere in a text or where one begins, and gets a backslash.
ESCAPED = re.compile(r"[\\*`\[\]_]")
ESCAPED_FIRST = re.compile(r"\A(?:-|\+ |=+|#{1,6} |~~~|>|(\d+)\. )")
LEARN_PARTS = {"permission-content-unauthorized-private", "learning-resource-card", "recommendations", "site-feedback-section", "open-source-feedback-section"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, {k: v or "" for k, v in attrs}, [], parent

    def walk(self):
        """Elements below, in document order; the tree may change behind the one being looked at."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out)

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def remove(self):
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def above(self):
        node = self.parent
        while node:
            yield node
            node = node.parent


class Builder(HTMLParser):
    """Builds the tree as browsers do for what pages get wrong most: paragraphs and list items that aren't closed, and formatting
    that is still open when its paragraph ends, which goes on in the next one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root, self.apart = Node("html"), 0
        self.open, self.formatting = [self.root], []

    def handle_decl(self, decl):
        self.apart += units(decl) + 3

    def handle_comment(self, data):
        self.apart += units(data) + 7

    def _add(self, x):
        self.open[-1].children.append(x)

    def _push(self, node):
        node.parent = self.open[-1]
        self._add(node)
        self.open.append(node)

    def _close(self, tags, stop=SCOPE):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return True
            if self.open[k].tag in stop:
                return False
        return False

    def _reopen(self):
        for k, node in enumerate(self.formatting):
            if node not in self.open:
                again = Node(node.tag, node.attrs.items())
                self.formatting[k] = again
                self._push(again)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body"):
            if tag != "html":
                if not any(n.tag == tag for n in self.open):
                    self._close({"head"}, set())
                    self._push(Node(tag, attrs))
            return
        if tag in ENDS_P:
            self._close({"p"})
        if tag == "li":
            self._close({"li"}, SCOPE | {"ul", "ol"})
        elif tag in ("dd", "dt"):
            self._close({"dd", "dt"}, SCOPE | {"dl"})
        elif tag in ("tr",):
            self._close({"tr"}, {"table"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"table"})
        elif tag in ("thead", "tbody", "tfoot"):
            self._close({"thead", "tbody", "tfoot"}, {"table"})
        if tag == "a":
            self.handle_endtag("a")
        if tag not in BLOCKS and tag not in RAW:
            self._reopen()
        node = Node(tag, attrs)
        self._push(node)
        if tag in VOID:
            self.open.pop()
        elif tag in FORMATTING:
            alike = [n for n in self.formatting if n.tag == tag and n.attrs == node.attrs]
            if len(alike) >= 3:  # as browsers do: of equal ones only the last three are opened again
                self.formatting = [n for n in self.formatting if n is not alike[0]]
            self.formatting.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in FORMATTING:
            self.formatting = [n for k, n in enumerate(self.formatting) if not (n.tag == tag and all(m.tag != tag for m in self.formatting[k + 1 :]))]
            self._close({tag})
        elif tag == "p" and not any(n.tag == "p" for n in self.open):
            self._push(Node("p"))
            self.open.pop()
        elif tag not in ("html", "body") and tag not in VOID:
            self._close({tag}, {"html"})

    def handle_data(self, data):
        if data.strip():
            if self.open[-1].tag not in RAW | {"title"}:
                self._reopen()
        self._add(data)


def units(text: str) -> int:
    """Length in units of UTF-16."""
    return len(text) + sum(c > "\uffff" for c in text) if not text.isascii() else len(text)


def parsed(html: str) -> Builder:
    b = Builder()
    b.feed(html)
    b.close()
    return b


def parse(html: str) -> Node:
    return parsed(html).root


def matches(node: Node, selector: str) -> bool:
    if selector[0] == ".":
        return selector[1:] in node.classes()
    if selector[0] == "#":
        return node.attrs.get("id") == selector[1:]
    if selector == "[role=main]":
        return node.attrs.get("role") == "main"
    if " " in selector:
        outer, inner = selector.split(" ")
        return node.tag == inner and any(a.tag == outer for a in node.above())
    return node.tag == selector


def inner_length(node: Node) -> int:
    """Length in UTF-16 units of the serialised contents."""
    out, stack = 0, [(node.tag in RAW, c) for c in node.children]
    while stack:
        raw, x = stack.pop()
        if isinstance(x, str):
            out += units(x) if raw else units(x) + 4 * x.count("&") + 3 * (x.count("<") + x.count(">")) + 5 * x.count("\xa0")
            continue
        out += 2 + len(x.tag) + sum(4 + units(k) + units(v) + 4 * v.count("&") + 5 * (v.count('"') + v.count("\xa0")) for k, v in x.attrs.items())
        if x.tag not in VOID:
            out += 3 + len(x.tag)
            stack += ((x.tag in RAW, c) for c in x.children)
    return out


def page_links(root: Node, base: str) -> list[str]:
    from ..functions.predicates import ASSETS, UTILITY

    found: dict[str, None] = {}
    host = urlsplit(base).hostname
    for node in root.walk():
        if node.tag == "a" and "href" in node.attrs:
            try:
                url = urljoin(base, node.attrs["href"].strip())
                at = urlsplit(url)
            except ValueError:
                continue
            path = at.path.lower()
            if at.scheme in ("http", "https") and at.hostname == host and not path.endswith(tuple("." + x for x in ASSETS)) and not any(x in at.path for x in UTILITY):
                found[url.split("#")[0]] = None
    return list(found)


def _distinct(texts):
    return list(dict.fromkeys(t for t in (x.strip() for x in texts) if t))


def prepare(root: Node, host: str) -> None:
    """The rules over the tree, in order: code editors and wrappers, headers of properties, hidden and tagged elements, terms,
    then those of vendors."""
    for n in list(root.walk()):
        if "cm-editor" in n.classes():
            content = next((c for c in n.walk() if "cm-content" in c.classes()), None)
            if content:
                lines = [c.text() for c in content.walk() if "cm-line" in c.classes()]
                lang = next((a.attrs["data-language"] for a in (content, n, *n.above()) if "data-language" in a.attrs), "")
                code, pre = Node("code", [("class", f"language-{lang}")] if lang else []), Node("pre")
                code.children, code.parent = ["\n".join(lines) if lines else content.text()], pre
                pre.children, pre.parent, n.children = [code], n, [pre]
    for n in list(root.walk()):
        c = n.attrs.get("class", "")
        if n.tag != "pre" and (any(x in c for x in ("CodeBlock", "codeblock", "code-block")) or "cm-editor" in n.classes()):
            pres = [p for p in n.walk() if p.tag == "pre"]
            if pres:
                n.children = pres
                for p in pres:
                    p.parent = n
    for n in list(root.walk()):
        if n.tag == "dt":
            details = [d for d in n.walk() if "PropertyDetail" in d.attrs.get("class", "")]
            if details:
                n.children = [" · ".join(_distinct((next((x for x in d.walk() if x.tag == "button"), None) or next((x for x in d.walk() if x.tag == "span"), None) or d).text() for d in details))]
    for n in list(root.walk()):
        if n.attrs.get("data-markdown") == "remove" or n.classes() & HIDDEN_CLASSES:
            n.remove()
    for n in list(root.walk()):
        if n.tag == "dt" and any(isinstance(c, Node) for c in n.children):
            for d in list(n.walk()):
                if d.tag == "svg" or "hidden" in d.attrs or d.attrs.get("aria-hidden") == "true":
                    d.remove()
            if texts := _distinct(c.text() for c in n.children if isinstance(c, Node)):
                n.children = [" · ".join(texts)]
    for n in list(root.walk()):
        if "hidden" in n.attrs and (any(d.tag in ("pre", "code", "dl") for d in n.walk()) or len(n.text()) > 100):
            del n.attrs["hidden"]
        if any(x in n.attrs.get("class", "") for x in ("PageFeedback", "PageFooter")):
            n.remove()
        elif re.fullmatch("h[1-6]", n.tag) and any(isinstance(c, Node) for c in n.children):
            n.children = [re.sub(r"\s+", " ", n.text()).strip()]
    for n in list(root.walk()):
        if n.tag in ("h4", "h5") and any(a.tag == "li" for a in n.above()):
            t = n.text().strip().lower()
            after = n.parent.children[n.parent.children.index(n) + 1 :]
            nxt = next((c for c in after if isinstance(c, Node)), None)
            if t in ("", "description") or n.tag == "h5" and nxt is not None and nxt.tag == "pre":
                n.remove()
    if host.endswith("microsoft.com"):
        for n in list(root.walk()):
            if n.attrs.get("id") in LEARN_IDS or "popover-content" in n.classes() or n.attrs.get("data-bi-name") in LEARN_PARTS:
                n.remove()


def content_root(root: Node) -> Node:
    """The first of the content selectors whose first match has over 500 characters inside, else the body; without chrome."""
    nodes = list(root.walk())
    body = next((n for n in nodes if n.tag == "body"), root)
    found = body
    for selector in ROOTS:
        first = next((n for n in nodes if matches(n, selector)), None)
        if first is not None and inner_length(first) > 500:
            found = first
            break
    for n in list(found.walk()):
        if n.tag in CHROME_TAGS or n.classes() & CHROME_CLASSES or n.attrs.get("role") in CHROME_ROLES or n.attrs.get("aria-label") == "breadcrumb":
            n.remove()
    return found


def _hidden(n: Node) -> bool:
    style = n.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _language(pre: Node, code: Node | None) -> str:
    for n in filter(None, (code, pre, *list(pre.above())[:2])):
        if m := re.search(r"(?:language|lang|highlight)-(\w+)", n.attrs.get("class", "")):
            return m[1]
        if n.attrs.get("data-code-language"):
            return n.attrs["data-code-language"]
    return ""


def written(steps) -> str:
    """Runs a method of Writer: a generator that yields those it needs the results of, which run on a stack of their own, so that
    elements may be nested to any depth."""
    stack, got = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(got))
            got = None
        except StopIteration as end:
            stack.pop()
            got = end.value
    return got


def plain(text: str, first: bool = False) -> str:
    """Text with its white space collapsed and what Markdown would read as a mark escaped; first: a block begins with it."""
    text = re.sub(r"[ \t\r\n]+", " ", text)
    text = ESCAPED.sub(r"\\\g<0>", text.lstrip(" ") if first else text)
    return ESCAPED_FIRST.sub(lambda m: f"{m[1]}\\. " if m[1] else "\\" + m[0], text)


class Writer:
    """Markdown of a tree; the methods run by written()."""

    def __init__(self, base: str):
        self.base = base

    def inline(self, node: Node):
        parts = []
        for c in node.children:
            parts.append(plain(c) if isinstance(c, str) else (yield self.one(c)))
        return "".join(parts)

    def block(self, node: Node):
        """Children as blocks apart by blank lines, runs of inline content between them as paragraphs."""
        parts, run = [], []
        for c in node.children:
            if isinstance(c, str):
                run.append(plain(c, not any(run)))
            elif c.tag in BLOCKS:
                parts.append("".join(run))
                run = []
                parts.append((yield self.one(c)))
            else:
                run.append((yield self.one(c)))
        parts.append("".join(run))
        return "\n\n".join(p for p in (re.sub(r"\A[ \n]+|[ \n]+\Z", "", x) for x in parts) if p)

    def one(self, n: Node):
        t = n.tag
        if t in JUNK or t in ("head", "title") or _hidden(n):
            return ""
        if re.fullmatch("h[1-6]", t):
            body = (yield self.inline(n)).strip()
            return f"{'#' * int(t[1])} {body}" if body else ""
        if t == "pre":
            code = next((c for c in n.walk() if c.tag == "code"), None)
            return f"```{_language(n, code)}\n{(code or n).text().strip(chr(10))}\n```"
        if t == "code":
            body = n.text()
            return f"`{body}`" if body.strip() else ""
        if t in ("b", "strong", "em", "i"):
            body = yield self.inline(n)
            mark, bare = "**" if t in ("b", "strong") else "*", body.strip()
            return body.replace(bare, mark + bare + mark, 1) if bare else body
        if t == "br":
            return "  \n"
        if t == "hr":
            return "* * *"
        if t == "img":
            src = n.attrs.get("src", "")
            return f"![{n.attrs.get('alt', '')}]({src})" if src else ""
        if t == "a":
            return (yield self.link(n))
        if t in ("ul", "ol"):
            items, k = [], int(n.attrs.get("start") or 1) if (n.attrs.get("start") or "1").isdigit() else 1
            for c in n.children:
                if isinstance(c, Node) and not _hidden(c):
                    mark = "-   " if t == "ul" else f"{k}.  "
                    k += 1
                    items.append(mark + (yield self.block(c)).replace("\n", "\n" + " " * len(mark)).strip())
            return "\n".join(items)
        if t == "blockquote":
            return "\n".join(f"> {x}" if x else ">" for x in (yield self.block(n)).split("\n"))
        if t == "table":
            return (yield self.table(n))
        return (yield self.block(n) if t in BLOCKS else self.inline(n))

    def link(self, n: Node):
        blocks = any(isinstance(c, Node) and c.tag in BLOCKS for c in n.children)
        body, href = (yield self.block(n) if blocks else self.inline(n)), n.attrs.get("href", "").strip()
        if not body.strip():
            return ""
        if not href:
            return body if blocks else body.strip()
        try:
            href = urljoin(self.base, href)
        except ValueError:
            pass
        title = f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""
        lines = [x.strip() for x in body.split("\n") if x.strip()]
        first = re.sub(r"^#+\s+", "", lines[0])
        return f"[{first}]({href}{title})" + ("\n\n" + "\n\n".join(lines[1:]) if len(lines) > 1 else "")

    def table(self, n: Node):
        cells = []
        for r in n.walk():
            if r.tag == "tr":
                row = []
                for c in r.children:
                    if isinstance(c, Node) and c.tag in ("td", "th"):
                        row.append(re.sub(r"\s*\n\s*", " ", (yield self.block(c))).replace("|", r"\|").strip())
                if row:
                    cells.append(row)
        if not cells:
            return ""
        lines = ["| " + " | ".join(r) + " |" for r in cells]
        return "\n".join([lines[0], "| " + " | ".join(["---"] * len(cells[0])) + " |", *lines[1:]])


def clean(text: str) -> str:
    """clean_markdown() for one text."""
    text = re.sub(r"\n{3,}", "\n\n", text)
    text = re.sub(r"(?m)^[^\S\n]+$", "", text)
    text = re.sub(r"\n---\n(?:\s*---\n)+", "\n---\n", text)
    return re.sub(r"(?m)[^\S\n]+$", "", text).strip()


def page_title(root: Node) -> str:
    return next((re.sub(r"\s+", " ", n.text()).strip() for n in root.walk() if n.tag == "title"), "")


def title_and_links(html: str | None, url: str, references: tuple[str, ...] | None = None) -> tuple[str | None, list[str]]:
    """What extract() finds before any rule is applied; no title for null html. references: those that titles are read with, all if
    None; others, such as one cut off before its semicolon, stay as they are written."""
    if html is None:
        return None, []
    if references is not None:
        other = rf"&(?!(?:{'|'.join(references)});)"
        html = re.sub(r"(?i)(<title(?:\s[^>]*)?>)([^<]*)", lambda m: m[1] + re.sub(other, "&amp;", m[2]), html)
    root = parse(html)
    return page_title(root), page_links(root, url or "")


def extract(html: str, url: str) -> tuple[str, str, list[str], int]:
    """Title, Markdown and links of a page, and the length of its HTML after the rules, in UTF-16 units (comments count, even where a
    rule removed them)."""
    built = parsed(html or "")
    root = built.root
    title, links = page_title(root), page_links(root, url or "")
    prepare(root, urlsplit(url or "").hostname or "")
    length = inner_length(root) + len("<html></html>") + built.apart if html else 0
    body = clean(written(Writer(url or "").block(content_root(root))))
    return title, body if body.startswith("# ") or not title else f"# {title}\n\n{body}", links, length
