"""Plan-time requests and answers of outside services: what would be sent, and what an answer means.
Nothing here calls a network; the values describe the rows that a fetcher brings in as tables."""

from __future__ import annotations

import json
from typing import Any

from webspark.operators.search import CAPABILITIES

#: Codes of safe search by kind of source: on, left open, off.
SAFE_CODES = {"web": ("1", "-2", "-2"), "news": ("1", "-1", "-2"), "images": ("1", "1", "-1")}
#: Rows a page by kind of source, and the category names of a meta search.
PAGE_SIZES = {"news": 30, "images": 100}
CATEGORIES = {"web": "general", "news": "news", "images": "images"}
#: Crawl fields that are accepted and not acted upon.
IGNORED_FIELDS = ("crawlEntireDomain", "delay", "ignoreQueryParameters", "excludeTags", "includeTags", "maxConcurrency", "prompt", "regexOnFullURL", "zeroDataRetention")


def safe_code(source: str, safe: bool | None) -> str:
    on, unset, off = SAFE_CODES[source]
    return unset if safe is None else on if safe else off


def web_params(query: str, region: str, safe: bool | None, df: str | None, page: int) -> dict[str, str]:
    """Parameters of a page of web results; from the second page on with an offset: 10, then 15 more each."""
    out = {"q": query, "kl": region, "kp": "1" if safe is True else "-2"}
    if df:
        out["df"] = df
    if page > 1:
        out["s"] = str(10 + 15 * (page - 2))
    return out


def media_params(source: str, query: str, region: str, token: str, safe: bool | None, time_filter: str | None, page: int) -> dict[str, str]:
    """Parameters of a page of news or images."""
    out = {"o": "json", "q": query, "l": region, "vqd": token, "p": safe_code(source, safe), "s": str((page - 1) * PAGE_SIZES[source])}
    if source == "news":
        out["noamp"] = "1"
    else:
        out["ct"] = "AT"
    if time_filter:
        out["df" if source == "news" else "f"] = time_filter
    return out


def meta_params(source: str, query: str, lang: str | None, safe: bool | None, time_range: str | None, page: int, engines: str | None = None) -> dict[str, str]:
    """Parameters of a page of a meta search."""
    out = {"q": query, "format": "json", "categories": CATEGORIES[source], "pageno": str(page)}
    extra = {"language": lang, "safesearch": "2" if safe is True else None, "time_range": time_range, "engines": engines}
    return {**out, **{k: v for k, v in extra.items() if v}}


def meta_endpoint(base: str) -> str:
    return base.removesuffix("/") + "/search"


def meta_headers(raw: str | None) -> tuple[dict[str, str], list[str]]:
    """(headers, warnings): the usual headers and those configured as a JSON object, which win."""
    usual = {"content-type": "application/json"}
    if not raw:
        return usual, []
    try:
        own = json.loads(raw)
    except ValueError:
        own = None
    if isinstance(own, dict):
        return {**usual, **own}, []
    return usual, ["searxng: SEARXNG_HEADERS is not valid JSON — ignoring"]


def ignored_fields(body: dict[str, Any]) -> list[str]:
    """The fields of a crawl request that have no effect, in order of name."""
    scrape = body.get("scrapeOptions")
    inner = [f"scrapeOptions.{k}" for k in scrape if k != "formats"] if isinstance(scrape, dict) else []
    return sorted([*(f for f in IGNORED_FIELDS if f in body), *inner])


def ignored_warning(fields: list[str]) -> str | None:
    return f"unsupported fields ignored: {', '.join(fields)}" if fields else None


def is_transient(status: int) -> bool:
    """Whether an answer is worth one more try."""
    return status == 429 or status >= 500


def rejects_schema(body: str) -> bool:
    """Whether an error text says that structured output isn't taken: it names the parameter and refuses it."""
    low = body.lower()
    named = any(w in low for w in ("response_format", "response format", "responseformat", "json_schema"))
    return named and any(w in low for w in ("unsupported", "invalid", "not supported", "unknown", "unrecognized"))


def chat_body(model: str | None, messages: list[dict[str, str]], schema: dict | None, strict: bool, named: bool = True, max_tokens: int = 2048, temperature: float = 0) -> dict[str, Any]:
    """What a chat service is sent; ``named`` wraps a strict schema with a name."""
    body: dict[str, Any] = {"messages": messages, "temperature": temperature, "max_tokens": max_tokens}
    if model is not None:
        body["model"] = model
    if schema is not None:
        form = {"name": "extraction", "strict": True, "schema": schema} if named else schema
        body["response_format"] = {"type": "json_schema", "json_schema": form} if strict else {"type": "json_object"}
    return body


def usage(raw: Any) -> dict[str, float] | None:
    """Token counts of an answer; None if it tells none."""
    source = raw.get("usage") if isinstance(raw, dict) and isinstance(raw.get("usage"), dict) else raw
    if not isinstance(source, dict):
        return None
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    out = {name: source[key] for key, name in (("prompt_tokens", "input"), ("completion_tokens", "output")) if number(source.get(key))}
    return out or None


def answer_content(raw: Any) -> tuple[str, Any]:
    """(text, parsed value) of an answer that is a text or an object with a response."""
    if isinstance(raw, str):
        return raw, None
    response = raw.get("response") if isinstance(raw, dict) else None
    if isinstance(response, str):
        return response, None
    if isinstance(response, (dict, list)):
        return json.dumps(response, ensure_ascii=False), response
    raise ValueError("unexpected shape of an answer")


def prefixed(message: str, provider: str) -> str:
    """An error text with its provider's name in front, once."""
    return message if message.startswith(f"{provider}: ") else f"{provider}: {message}"


def servable(provider: str, missing: list[str]) -> list[str]:
    """The missing sources that a provider can serve, in their order."""
    return [s for s in missing if s in CAPABILITIES.get(provider, ())]
