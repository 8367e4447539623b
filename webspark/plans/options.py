"""Plan-time settings: what a request asks for, read leniently into typed values."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

#: Formats by how they are asked for.
STRING_FORMATS = ("markdown", "html", "rawHtml", "links", "screenshot", "summary")
OBJECT_FORMATS = ("markdown", "html", "rawHtml", "links")
UNSUPPORTED_FORMATS = ("images", "rawBase64", "changeTracking", "branding", "product", "menu", "audio", "video", "question", "highlights")
FULL_PAGE_NOTE = "screenshot@fullPage is v1; use {type:'screenshot',fullPage:true}"
#: Actions a stored page cannot play, by name, and those that are only noted.
ACTIONS = ("wait", "click", "write", "press", "scroll", "screenshot")
NOTED_ACTIONS = ("pdf", "executeJavascript", "scrape")


class FormatError(ValueError):
    """A format that is not known."""


@dataclass
class Formats:
    """The formats of a request, in order and without doubles."""

    names: list[str] = field(default_factory=list)
    full_page: bool = False
    json: dict | None = None
    summary: bool = False
    warnings: list[str] = field(default_factory=list)


def normalize_formats(asked: list[Any]) -> Formats:
    """Names and objects to formats; unsupported ones are noted once, unknown ones raise."""
    out = Formats()

    def add(name: str) -> None:
        if name not in out.names:
            out.names.append(name)

    def note(text: str) -> None:
        if text not in out.warnings:
            out.warnings.append(text)

    for item in asked:
        kind = item if isinstance(item, str) else item.get("type") if isinstance(item, dict) else None
        if kind == "screenshot@fullPage" and isinstance(item, str):
            out.full_page = True
            add("screenshot")
            note(FULL_PAGE_NOTE)
        elif kind in UNSUPPORTED_FORMATS:
            note(f"format {kind} is not supported by this deployment")
        elif isinstance(item, str) and kind in STRING_FORMATS:
            add(kind)
        elif isinstance(item, dict) and kind == "screenshot":
            add(kind)
            out.full_page |= item.get("fullPage") is True
        elif isinstance(item, dict) and kind == "json":
            out.json = {**(out.json or {}), **{k: item[k] for k in ("schema", "prompt") if k in item and (k == "schema" or isinstance(item[k], str))}}
        elif isinstance(item, dict) and kind == "summary":
            out.summary = True
            add(kind)
        elif isinstance(item, dict) and kind in OBJECT_FORMATS:
            add(kind)
        else:
            raise FormatError(f"Unsupported format: {json.dumps(item)}")
    return out


def with_links(formats: list[str]) -> list[str]:
    """A crawl always needs the links."""
    return formats if "links" in formats else [*formats, "links"]


def split_actions(actions: list[dict]) -> tuple[list[dict], list[str]]:
    """(actions that can be played, warnings once for the others)."""
    known = [a for a in actions if isinstance(a, dict) and a.get("type") in ACTIONS]
    others = dict.fromkeys(a["type"] for a in actions if isinstance(a, dict) and a.get("type") in NOTED_ACTIONS)
    return known, [f"action {name} is not supported by this deployment" for name in others]


def _number(value: Any) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value) if math.isfinite(value) else None
    digits = ""
    for c in str(value).strip():
        if c.isdigit() or (c in "+-" and not digits):
            digits += c
        else:
            break
    return float(digits) if digits.strip("+-") else None


def bounded_int(value: Any, default: int, low: int, high: int) -> int:
    """A whole number within bounds; what is no number gives the default."""
    n = _number(value)
    return default if n is None else int(min(max(int(n), low), high))


@dataclass(frozen=True)
class CrawlOptions:
    """The stored options of a crawl with their defaults."""

    limit: int = 10_000
    max_depth: int = 10
    allow_external: bool = False
    allow_subdomains: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ignore_robots: bool = False
    sitemap: str = "include"
    formats: tuple[str, ...] = ("markdown",)
    user_agent: str = ""
    webhook: dict | None = None


def parse_options(raw: str | None) -> CrawlOptions:
    """Stored options; what is missing, broken or of the wrong kind takes its default."""
    try:
        source = json.loads(raw) if raw else {}
    except ValueError:
        source = {}
    source = source if isinstance(source, dict) else {}
    scrape = source.get("scrapeOptions") if isinstance(source.get("scrapeOptions"), dict) else {}
    asked = scrape.get("formats") if isinstance(scrape.get("formats"), list) else ["markdown"]
    try:
        formats = normalize_formats(asked)
        names = [n for n in formats.names if n != "summary"]
        if (formats.json is not None or formats.summary) and "markdown" not in names:
            names.append("markdown")
    except FormatError:
        names = ["markdown"]
    strings = lambda v: tuple(x for x in v if isinstance(x, str)) if isinstance(v, list) else ()
    limit, depth = _number(source.get("limit")), _number(source.get("maxDiscoveryDepth"))
    hook = source.get("webhook")
    return CrawlOptions(
        limit=int(limit) if limit is not None and limit > 0 else 10_000,
        max_depth=int(depth) if depth is not None and depth >= 0 else 10,
        allow_external=source.get("allowExternalLinks") is True,
        allow_subdomains=source.get("allowSubdomains") is True,
        include=strings(source.get("includePaths")),
        exclude=strings(source.get("excludePaths")),
        ignore_robots=source.get("ignoreRobotsTxt") is True,
        sitemap=source["sitemap"] if source.get("sitemap") in ("skip", "only") else "include",
        formats=tuple(names),
        user_agent=source["robotsUserAgent"] if isinstance(source.get("robotsUserAgent"), str) else "",
        webhook=hook if isinstance(hook, dict) and isinstance(hook.get("url"), str) and hook["url"] else None,
    )


def normalize_sources(asked: list[Any]) -> list[str]:
    """Sources of a search, names or objects with a type, in order and without doubles."""
    names = [s if isinstance(s, str) else s.get("type") if isinstance(s, dict) else None for s in asked]
    return list(dict.fromkeys(n for n in names if n))


@dataclass(frozen=True)
class ModelConfig:
    """Settings of the model calls: time, repairs and the budget of characters."""

    timeout_ms: int = 20_000
    max_repairs: int = 2
    max_chars: int = 48_000
    strict_json: str = "auto"

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> ModelConfig:
        strict = (env.get("LLM_STRICT_JSON") or "").strip().lower()
        value = lambda key: (env.get(key) or "").strip() or None
        return cls(
            bounded_int(value("LLM_TIMEOUT_MS"), 20_000, 1000, 300_000) if value("LLM_TIMEOUT_MS") else 20_000,
            bounded_int(value("LLM_MAX_REPAIRS"), 2, 0, 5) if value("LLM_MAX_REPAIRS") else 2,
            bounded_int(value("LLM_MAX_INPUT_CHARS"), 48_000, 1000, 2**53 - 1) if value("LLM_MAX_INPUT_CHARS") else 48_000,
            strict if strict in ("on", "off") else "auto",
        )
