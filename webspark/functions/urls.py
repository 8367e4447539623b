"""URL algebra.

Column functions for absolute addresses, which stay inside code generation, and a parser after the
public WHATWG URL standard (host case, default ports, dot segments, percent-encoding, relative
references) behind an Arrow UDF. ``resolve`` sends only the addresses to Python that the plain form
does not cover.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of files that are no pages.
ASSET_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "zip", "gz", "rar", "7z", "exe", "dmg",
)
#: Schemes of links that lead to no page.
NON_HTTP_SCHEMES = ("mailto", "tel", "javascript", "data", "sms", "ftp")
#: Default ports by scheme.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
#: Scheme, slashes and authority.
_HEAD = r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*[^/?#\\]*"


def clean(url: Column) -> Column:
    """Without control characters and blanks at the ends, tabs and line breaks."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean(url), _SCHEME, 1))


def host(url: Column) -> Column:
    """Lower-case host without user part and port; empty if there is none."""
    return F.lower(F.regexp_extract(clean(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*(?:[^/?#\\]*@)?([^/?#\\:]*)", 1))


def port(url: Column) -> Column:
    """The port if it isn't the scheme's own; else empty."""
    own = r"(?i)^(?:http:[^:]*:80|https:[^:]*:443)$"
    head = F.regexp_replace(F.regexp_extract(clean(url), _HEAD, 0), r"[^:]*@", "")
    return F.regexp_extract(F.regexp_replace(head, own, ""), r"^[^:]*:[^:]*:(\d+)$", 1)


def path(url: Column) -> Column:
    found = F.regexp_extract(clean(url), _HEAD + r"([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    """The query with its question mark; empty without one or if nothing follows the mark."""
    return F.regexp_extract(clean(url), r"^[^?#]*(\?[^#]+)", 1)


def is_http(url: Column) -> Column:
    """Whether an address has the scheme http or https and a host; false for null."""
    return F.coalesce(clean(url).rlike(r"(?i)^https?:[/\\]*(?:[^/?#\\]*@)?[^/?#\\:]"), F.lit(False))


def origin(url: Column) -> Column:
    """Scheme, host and a port that isn't the scheme's own; null for what is no http address."""
    head = F.lower(F.regexp_extract(clean(url), _HEAD, 0))
    bare = F.regexp_replace(head, r"^(https?):[/\\]*(?:.*@)?", "$1://")
    return F.when(is_http(url), F.regexp_replace(bare, r"(?<=^http://[^:]{0,300}):(?:80)?$|(?<=^https://[^:]{0,300}):(?:443)?$", ""))


def without_fragment(url: Column) -> Column:
    """Normal form of an absolute http address without its fragment; null for others."""
    return F.when(is_http(url), F.concat(origin(url), path(url), F.regexp_extract(clean(url), r"^[^?#]*(\?[^#]*)", 1)))


def discovery_form(url: Column) -> Column:
    """Without fragment and without one slash at the end, but for a bare host."""
    full = without_fragment(url)
    return F.when((path(url) != "/") & full.endswith("/"), F.regexp_replace(full, "/$", "")).otherwise(full)


def url_key(url: Column) -> Column:
    """What makes two results the same page: host, path without a slash at the end, query. Scheme,
    port and fragment don't count. Null for what is no http address."""
    whole = r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*(?:[^/?#\\]*@)?([^/?#\\:]*)[^/?#\\]*([^?#]*)(\?[^#]+)?(?s:.*)$"
    # one pass takes the address apart; a cleaned one holds no line break
    parts = F.split(F.regexp_replace(clean(url), whole, "$1\n$2\n$3"), "\n")
    place = F.regexp_replace(F.get(parts, 1), "/$", "")
    return F.when(is_http(url), F.concat(F.lower(F.get(parts, 0)), F.when(place == "", "/").otherwise(place), F.get(parts, 2)))


def request_path(url: Column) -> Column:
    """Path and query; an address that is none stays as it is."""
    return F.when(is_http(url), F.concat(path(url), query(url))).otherwise(url)


def dedupe_key(url: Column, ignore_query: bool = True) -> Column:
    """The address, without its query but with its fragment."""
    return F.regexp_replace(url, r"^([^?#]*)\?[^#]*", "$1") if ignore_query else url


def is_internal_host(base: Column, other: Column, allow_subdomains: bool = False) -> Column:
    """Whether a host belongs to the scope of the linking page's host."""
    same = base == other
    return same | F.endswith(other, F.concat(F.lit("."), base)) if allow_subdomains else same


def has_asset_extension(path_: Column) -> Column:
    """Whether the text after the last dot of a path is the extension of a file."""
    return F.contains(path_, F.lit(".")) & F.lower(F.substring_index(path_, ".", -1)).isin(*ASSET_EXTENSIONS)


def leads_elsewhere(link: Column) -> Column:
    """Whether a link has a scheme that leads to no page."""
    return F.coalesce(link.rlike("(?i)^(" + "|".join(NON_HTTP_SCHEMES) + "):"), F.lit(False))


def escape_pattern(text: str) -> str:
    """Text with the signs of regular expressions escaped, but for the star."""
    return re.sub(r"([.+^${}()|\[\]\\?])", r"\\\1", text)


def glob_pattern(glob: str) -> str:
    """The anchored regular expression of a glob, in which only the star means something."""
    return "^" + escape_pattern(glob).replace("*", ".*") + "$"


def passes_globs(path_: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path matches any of the globs to include (all, if there are none) and none of those
    to exclude. Globs are compiled once, into one pattern a list."""

    def hits(globs: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [path_.rlike(glob_pattern(g)) for g in globs])

    ok = F.lit(True)
    if include:
        ok = ok & hits(include)
    if exclude:
        ok = ok & ~hits(exclude)
    return ok


class Url(NamedTuple):
    scheme: str
    host: str
    port: str
    path: str
    query: str
    fragment: str

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port else "")

    @property
    def href(self) -> str:
        return self.origin + self.path + self.query + self.fragment


_SPECIAL = frozenset(DEFAULT_PORTS)
_FORBIDDEN_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


def _encode(text: str, keep: str) -> str:
    return quote(text, safe=keep)


_PATH_KEEP = "!$%&'()*+,-./:;=@[\\]_|~^"
_QUERY_KEEP = "!$%&()*+,-./:;=?@[\\]_|~^`{}"
_FRAGMENT_KEEP = "!$%&'()*+,-./:;=?@[\\]_|~^{}#"


def _host(text: str) -> str | None:
    text = "".join(c for c in text if c not in "­​⁠﻿‌‍")
    if text.startswith("["):
        return text.lower() if text.endswith("]") else None
    if "%" in text:
        from urllib.parse import unquote

        text = unquote(text)
    text = text.replace("。", ".").lower()
    if not text.isascii():
        try:
            text = ".".join(p if p.isascii() else p.encode("idna").decode() for p in text.split("."))
        except UnicodeError:
            return None
    return None if not text or _FORBIDDEN_HOST.search(text) else text


def _segments(text: str) -> str:
    out: list[str] = []
    parts = text.split("/")
    for i, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def parse_url(raw: str | None, base: Url | None = None) -> Url | None:
    """A special-scheme address after the public standard; null if it is none or invalid."""
    if raw is None:
        return None
    text = re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", raw)
    text = re.sub(r"[\t\n\r]", "", text)
    text, _, fragment = text.partition("#")
    mark = "#" in raw and fragment != ""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", text)
    own = m[1].lower() if m else ""
    if m and own not in _SPECIAL:
        return None
    rest = text[m.end() :] if m else text
    fragment = "#" + _encode(fragment, _FRAGMENT_KEEP) if mark else ""
    relative = not m or (base is not None and own == base.scheme and not re.match(r"[/\\]{2}", rest))
    if relative and base is None:
        return None
    body, q, query_ = rest.partition("?")
    body = body.replace("\\", "/")
    query_ = "?" + _encode(query_, _QUERY_KEEP) if q else ""
    if relative and not body.startswith("//"):
        if body.startswith("/"):
            place = body[1:]
        elif body:
            place = base.path.rsplit("/", 1)[0][1:] + "/" + body if base.path.count("/") > 1 else body
        else:
            return base._replace(query=query_ if q else base.query, fragment=fragment)
        return base._replace(path=_segments(_encode(place, _PATH_KEEP)), query=query_, fragment=fragment)
    kind = own or base.scheme
    body = body.lstrip("/")
    authority, slash, place = body.partition("/")
    authority = authority.rpartition("@")[2]
    name, colon, number = authority.partition(":") if not authority.startswith("[") else (authority.split("]")[0] + "]", "", authority.rpartition("]:")[2] if "]:" in authority else "")
    if number and (not number.isdigit() or int(number) > 65535):
        return None
    name = _host(name)
    if name is None:
        return None
    number = "" if not number or int(number) == DEFAULT_PORTS[kind] else str(int(number))
    return Url(kind, name, number, _segments(_encode(place, _PATH_KEEP)), query_, fragment)


def resolve_text(value: str | None, base: str | None = None) -> str | None:
    """The absolute http address a reference means on a page; null for any other."""
    url = parse_url(value, parse_url(base)) if base is not None else parse_url(value)
    return url.href if url and url.scheme in ("http", "https") else None


#: An address the standard leaves as it is, but for its fragment.
_PLAIN = r"^https?://[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?/(?:[A-Za-z0-9_~!$&()*+,;=:@/%\-]|\.[A-Za-z0-9_])*(?:\?[A-Za-z0-9_~!$&()*+,;=:@/%.\-]+)?(?:#[A-Za-z0-9_\-]+)?\z"


def resolve(value: Column, base: Column) -> Column:
    """The absolute http address that ``value`` means on page ``base``; null for any other scheme and
    for what is no address. Plain absolute addresses never leave code generation: the UDF sees null
    in their place."""

    @F.pandas_udf("string")
    def by_standard(values: pd.Series, bases: pd.Series) -> pd.Series:
        parsed: dict[str, Url | None] = {}
        out = []
        for v, b in zip(values, bases):
            if v is None:
                out.append(None)
                continue
            if b not in parsed:
                parsed[b] = parse_url(b) if b is not None else None
            url = parse_url(v, parsed[b])
            out.append(url.href if url and url.scheme in ("http", "https") else None)
        return pd.Series(out, index=values.index, dtype=object)

    plain = F.coalesce(value.rlike(_PLAIN), F.lit(False))
    return F.when(plain, value).otherwise(by_standard(F.when(~plain, value), F.when(~plain, base)))
