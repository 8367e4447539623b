"""Text functions: entities, snippets, content budgets, fences."""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities of result pages in the order they are decoded; the ampersand comes last.
RESULT_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&"))
#: The named entities of XML.
XML_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: The marker of the fence around page content, and what replaces its forgeries.
MARKER, FENCE_REMOVED, NONCE_REMOVED, MARKER_BROKEN = "UNTRUSTED_CONTENT", "[untrusted-content-removed]", "[nonce-removed]", "UNTRUSTED-CONTENT"


def decode_entities(text: Column) -> Column:
    """The six entities of result pages, one after the other."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), RESULT_ENTITIES, text)


def clean_text(markup: Column) -> Column:
    """Markup without tags, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(markup, r"<[^>]*>", "")), r"\s+", " "))


def decode_xml_entities(text: Column) -> Column:
    """Numeric and the five named entities in a single pass; others stay. Only texts with an
    ampersand go to Python."""

    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] == "#":
            try:
                return chr(int(e[2:], 16) if e[1] in "xX" else int(e[1:]))
            except (ValueError, OverflowError):
                return m[0]
        return XML_ENTITIES.get(e, m[0])

    pattern = re.compile(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+);")

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else pattern.sub(one, v))

    coded = F.coalesce(F.contains(text, F.lit("&")), F.lit(False))
    return F.when(coded, decode(F.when(coded, text))).otherwise(text)


def strip_cdata(text: Column) -> Column:
    """The trimmed content of a text that is one CDATA section; other texts stay."""
    whole = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
    return F.when(text.rlike(whole), F.trim(F.regexp_extract(text, whole, 1))).otherwise(text)


def cap_snippet(text: Column, most: int = 300) -> Column:
    return F.substring(F.trim(text), 1, most)


def without_title_lines(text: Column, title: Column) -> Column:
    """Lines of a snippet that only repeat the title are dropped."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != title), "\n")


def fenced_json(text: Column) -> Column:
    """The body of the first fenced block; null if there is none."""
    found = r"(?is)```(?:json)?\s*(.*?)```"
    return F.when(text.rlike(found), F.trim(F.regexp_extract(text, found, 1)))


def _marker(dropped: Column) -> Column:
    return F.concat(F.lit("\n\n…[truncated "), dropped.cast("string"), F.lit(" characters]…\n\n"))


def budget_content(text: Column, most: int) -> Column:
    """Struct (content, truncated, dropped): a text cut to ``most`` code points, head and tail kept
    around a marker; a budget the marker does not fit in keeps the head alone. Null stays null."""
    most = max(0, int(most))
    length = F.length(text)
    room = most - F.length(_marker(length))
    head = F.ceil(F.greatest(room, F.lit(0)) / 2).cast("int")
    tail = (F.greatest(room, F.lit(0)) - head).cast("int")
    dropped = length - head - tail
    cut = F.concat(F.substr(text, F.lit(1), head), _marker(dropped), F.substr(text, length - tail + 1, tail))
    fits, tiny = length <= most, room <= 0
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(fits, text).when(tiny, F.substr(text, F.lit(1), F.lit(most))).otherwise(cut).alias("content"),
            (~fits).alias("truncated"),
            F.when(fits, F.lit(0)).when(tiny, length - most).otherwise(dropped).cast("bigint").alias("dropped"),
        ),
    )


def budget_text(text: str, most: float) -> tuple[str, bool, int]:
    """The budget counted in UTF-16 units, as scripts in browsers count; never half a pair."""
    if most == float("inf") or most != most:
        return text, False, 0
    most = max(0, int(most))
    units = text.encode("utf-16-le", "surrogatepass")
    n = len(units) // 2
    if n <= most:
        return text, False, 0

    def part(a: int, b: int) -> str:
        def inside_pair(i: int) -> bool:
            return 0 < i < n and 0xDC <= units[2 * i + 1] <= 0xDF and 0xD8 <= units[2 * i - 1] <= 0xDB

        if inside_pair(a):
            a += 1
        if inside_pair(b):
            b -= 1
        return units[2 * a : 2 * max(a, b)].decode("utf-16-le", "surrogatepass")

    def width(s: str) -> int:
        return len(s.encode("utf-16-le", "surrogatepass")) // 2

    def marker(dropped: int) -> str:
        return f"\n\n…[truncated {dropped} characters]…\n\n"

    room = most - width(marker(n))
    if room <= 0:
        head = part(0, most)
        return head, True, n - width(head)
    ahead = -(-room // 2)
    head, tail = part(0, ahead), part(n - (room - ahead), n) if room > ahead else ""
    dropped = n - width(head) - width(tail)
    return head + marker(dropped) + tail, True, dropped


def budget_content_utf16(text: Column, most: int) -> Column:
    """As ``budget_content``, counted in UTF-16 units. Texts that fit in code points whatever their
    script stay out of Python."""

    @F.pandas_udf("content string, truncated boolean, dropped bigint")
    def cut(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if v is None else budget_text(v, most) for v in values], columns=["content", "truncated", "dropped"])

    fits = 2 * F.length(text) <= most
    whole = F.struct(text.alias("content"), F.lit(False).alias("truncated"), F.lit(0).cast("bigint").alias("dropped"))
    return F.when(text.isNotNull(), F.when(fits, whole).otherwise(cut(F.when(~fits, text))))


def sanitize_untrusted(text: Column, nonce: str) -> Column:
    """A page's content with everything broken that could close the fence around it."""
    out = text
    if nonce:
        out = F.replace(out, F.lit(f"<<<{MARKER}_{nonce}>>>"), F.lit(FENCE_REMOVED))
        out = F.replace(out, F.lit(f"<<<END_{MARKER}_{nonce}>>>"), F.lit(FENCE_REMOVED))
        out = F.replace(out, F.lit(nonce), F.lit(NONCE_REMOVED))
    return F.regexp_replace(out, "(?i)untrusted_content", MARKER_BROKEN)


def frame(text: Column, nonce: str) -> Column:
    return F.concat(F.lit(f"<<<{MARKER}_{nonce}>>>\n"), sanitize_untrusted(text, nonce), F.lit(f"\n<<<END_{MARKER}_{nonce}>>>"))


def prefix_warning(message: Column, provider: Column, *aliases: str) -> Column:
    """A warning with its provider's name in front, unless it bears it already."""
    known = F.startswith(message, F.concat(provider, F.lit(":")))
    for alias in aliases:
        known = known | F.startswith(message, F.lit(f"{alias}:"))
    return F.when(known, message).otherwise(F.concat(provider, F.lit(": "), message))


def unescape_html(text: str) -> str:
    return html.unescape(text)


def url_safe_base64(data: Column) -> Column:
    """Unpadded base64 with the alphabet for addresses."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))
