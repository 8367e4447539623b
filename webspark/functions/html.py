"""Page extraction: title, description, links (native patterns), main content and markdown (a
forgiving parser behind Arrow UDFs; HTML nests, so patterns cannot find what an element holds)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that never hold main content, and those left out for the main content only.
ALWAYS_OUT, MAIN_OUT = frozenset(["script", "style"]), frozenset(["nav", "header", "footer"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What ends an open element of the same list (unclosed paragraphs, items, cells).
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p", "li"}, "td": {"td", "th", "p", "li"}, "th": {"td", "th", "p", "li"}}
BLOCKS = frozenset("address article aside blockquote div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table tr ul li body".split())
NO_TITLE, NO_DESCRIPTION = "No title available", "No description available"


def _decoded(text: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def title(html: Column) -> Column:
    """The page's title, or the words that say there is none."""
    found = F.trim(F.regexp_replace(_decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))
    return F.when(found == "", NO_TITLE).otherwise(found)


def description(html: Column) -> Column:
    """The description of the page's meta element; without the element the words that say so."""
    tag = r'(?is)<meta\s[^>]*name="description"[^>]*content="([^"]*)"'
    return F.when(html.rlike(tag), _decoded(F.regexp_extract(html, tag, 1))).otherwise(NO_DESCRIPTION)


def hrefs(html: Column) -> Column:
    """The targets of all anchors in order, as written, repeats kept and empty ones dropped."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return F.filter(F.transform(found, _decoded), lambda x: x != "")


class _Tree(HTMLParser):
    """A forgiving reading of a page into (open tag, attributes, children) lists."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["root", {}, []]
        self.stack: list[list] = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = CLOSES.get(tag)
        if ends is None and tag in BLOCKS:
            ends = {"p"}
        if ends:
            for i in range(len(self.stack) - 1, 0, -1):
                open_tag = self.stack[i][0]
                if open_tag in ends:
                    del self.stack[i:]
                elif open_tag in ("table", "ul", "ol", "div", "section", "article", "body") or (tag == "td" and open_tag == "tr"):
                    break
        node = [tag, dict(attrs), []]
        self.stack[-1][2].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1][2].append(data)


def _parse(html: str) -> list:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _body(node: list) -> list:
    """The body element, wherever it stands; without one the whole page."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n[0] == "body":
            return n
        todo += [c for c in reversed(n[2]) if isinstance(c, list)]
    return node


def _prune(node: list, out: frozenset) -> list:
    return [node[0], node[1], [_prune(c, out) if isinstance(c, list) else c for c in node[2] if not (isinstance(c, list) and c[0] in out)]]


def _write(node: list) -> str:
    attrs = "".join(f' {k}="{(v or "").replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in node[1].items())
    inner = "".join(_write(c) if isinstance(c, list) else c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for c in node[2])
    if node[0] == "root":
        return inner
    return f"<{node[0]}{attrs}>" + ("" if node[0] in VOID else f"{inner}</{node[0]}>")


def main_html(html: str | None, main_only: bool = True) -> str | None:
    """The body without scripts and styles, and for the main content without navigation, header and
    footer elements. Nested deeper than Python's stack, a page gives null."""
    if html is None:
        return None
    try:
        return _write(_prune(_body(_parse(html)), ALWAYS_OUT | (MAIN_OUT if main_only else frozenset())))
    except RecursionError:
        return None


def _inline(node: list | str) -> str:
    if isinstance(node, str):
        return " ".join(node.split()) if node.strip() else " " if node else ""
    parts = []
    for c in node[2]:
        if isinstance(c, str):
            text = " ".join(c.split())
            parts.append((" " if c[:1].isspace() else "") + text + (" " if text and c[-1:].isspace() else ""))
        else:
            parts.append(_inline(c))
    text = "".join(parts)
    tag, bare = node[0], text.strip()
    if tag == "br":
        return "\n"
    if not bare:
        return text
    if tag in ("b", "strong"):
        return f"**{bare}**"
    if tag in ("i", "em"):
        return f"_{bare}_"
    if tag == "code":
        return f"`{bare}`"
    if tag == "a" and node[1].get("href"):
        return f"[{bare}]({node[1]['href']})"
    return text


def _tidy(text: str) -> str:
    return "\n".join(" ".join(line.split()) for line in text.split("\n")).strip()


def _blocks(node: list, out: list[str]) -> None:
    run: list = []

    def flush() -> None:
        if run:
            text = _tidy(_inline(["span", {}, list(run)]))
            if text:
                out.append(text)
            run.clear()

    for c in node[2]:
        if isinstance(c, str) or c[0] not in BLOCKS:
            if isinstance(c, list) and any(isinstance(x, list) and x[0] in BLOCKS for x in c[2]):
                flush()
                _blocks(c, out)
            else:
                run.append(c)
            continue
        flush()
        tag = c[0]
        if tag[0] == "h" and tag[1:].isdigit():
            text = _tidy(_inline(c)).replace("\n", " ")
            if text:
                out.append("#" * int(tag[1:]) + " " + text)
        elif tag == "pre":
            text = "".join(x if isinstance(x, str) else _plain(x) for x in c[2]).strip("\n")
            out.append(f"```\n{text}\n```")
        elif tag in ("li", "dd", "dt"):
            inner: list[str] = []
            _blocks(c, inner)
            if inner:
                item = "* " + "\n".join(inner).replace("\n", "\n  ")
                if out and out[-1].startswith("* "):
                    out[-1] += "\n" + item
                else:
                    out.append(item)
        elif tag == "blockquote":
            inner = []
            _blocks(c, inner)
            out.append("\n".join("> " + line for line in "\n\n".join(inner).split("\n")))
        elif tag == "tr":
            cells = [_tidy(_inline(x)).replace("\n", " ") for x in c[2] if isinstance(x, list) and x[0] in ("td", "th") and not any(isinstance(y, list) and y[0] in BLOCKS for y in x[2])]
            if len(cells) > 1:
                row = "| " + " | ".join(cells) + " |"
                if out and out[-1].startswith("| "):
                    out[-1] += "\n" + row
                else:
                    out.append(row)
            else:
                _blocks(c, out)
        elif tag == "hr":
            out.append("---")
        else:
            _blocks(c, out)
    flush()


def _plain(node: list) -> str:
    return "".join(x if isinstance(x, str) else _plain(x) for x in node[2])


def markdown_text(html: str | None, main_only: bool = True) -> str | None:
    """Markdown of a page: headings, paragraphs, emphasis, links, lists, quotations, tables, code."""
    if html is None:
        return None
    try:
        body = _prune(_body(_parse(html)), ALWAYS_OUT | frozenset(["head"]) | (MAIN_OUT if main_only else frozenset()))
        out: list[str] = []
        _blocks(body, out)
        return "\n\n".join(out)
    except RecursionError:
        return None


def main_content(html: Column, main_only: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: main_html(v, main_only))

    return run(html)


def to_markdown(html: Column, main_only: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: markdown_text(v, main_only))

    return run(html)
