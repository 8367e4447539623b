"""Pieces of SQL that several checks share."""

from __future__ import annotations


def url_struct(column: str) -> str:
    """An address taken apart by one pattern: scheme s, host h, port p, path a, query q."""
    clean = rf"regexp_replace(regexp_replace({column}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\n\r]', '', 'g')"
    return rf"regexp_extract({clean}, '^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*(?:[^/?#\\@]*@)?([^/?#\\:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?', ['s', 'h', 'p', 'a', 'q'])"


HTTP = "(lower(u.s) IN ('http', 'https') AND u.h <> '')"
HOST = "lower(u.h)"
PATH = "(CASE WHEN u.a = '' THEN '/' ELSE u.a END)"
SEARCH = "(CASE WHEN u.q = '?' THEN '' ELSE u.q END)"
PORT = "(CASE WHEN u.p = '' OR (lower(u.s) = 'http' AND u.p = '80') OR (lower(u.s) = 'https' AND u.p = '443') THEN '' ELSE u.p END)"
ORIGIN = f"(lower(u.s) || '://' || {HOST} || CASE WHEN {PORT} <> '' THEN ':' || {PORT} ELSE '' END)"
KEY = f"(CASE WHEN {HTTP} THEN {HOST} || (CASE WHEN {PATH} = '/' THEN '/' ELSE regexp_replace({PATH}, '/$', '') END) || {SEARCH} END)"


def percent_encoded(column: str) -> str:
    """Non-ASCII letters as UTF-8 in percent escapes, letter by letter."""
    return f"array_to_string(list_transform(string_split({column}, ''), lambda c: CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')"
