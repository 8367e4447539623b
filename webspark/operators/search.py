"""Search: result pages and JSON answers parsed, pages joined until dry, the first provider that has
something for a source wins, results grouped and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webspark.functions import jsonx, text, urls
from webspark.operators.links import keep_first

#: What each provider can serve, and the order in which they are asked.
CAPABILITIES = {"ddg": ["web"], "ddg-media": ["news", "images"], "searxng": ["web", "news", "images"], "browser": ["web", "news"]}
DEFAULT_CHAIN = ["ddg", "ddg-media", "browser"]
#: Marks of a page that challenges instead of answering.
CHALLENGES = ('class="anomaly-modal', 'id="anomaly-modal"', 'class="challenge-form', 'id="challenge-form"')
MOST_HTML = 1_000_000
_TITLE = r'(?s)<a\b[^>]{0,500}class="[^"]*\bresult__a\b[^>]*>(.*?)</a>'
_SNIPPET = r'(?s)<a\b[^>]{0,500}class="[^"]*\bresult__snippet\b[^>]*>(.*?)</a>'


def is_challenge(html: Column) -> Column:
    hits = F.lit(False)
    for mark in CHALLENGES:
        hits = hits | F.contains(html, F.lit(mark))
    return hits


def result_target(href: Column) -> Column:
    """The address behind a redirecting href; others stay; null if the redirect names none."""
    inner = F.try_url_decode(F.replace(F.nullif(F.regexp_extract(href, r"[?&]uddg=([^&#]+)", 1), F.lit("")), F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(href, F.lit("duckduckgo.com/l/")), inner).otherwise(href)


def web_results(pages: DataFrame) -> DataFrame:
    """(query, page, pos, url, title, snippet): the results on result pages.

    pages: query, page, status, html. Challenges, pages that failed and pages of over a million
    characters have none. A page is cut before each title, so that the snippet of a result is the
    first between its title and the next one; results without an http address are dropped.
    """
    good = pages.where((F.coalesce("status", F.lit(200)) == 200) & (F.length("html") <= MOST_HTML) & ~is_challenge(F.col("html")))
    marked = F.regexp_replace("html", r'(<a\b[^>]{0,500}class="[^"]*\bresult__a\b)', "\x01$1")
    blocks = good.select("query", "page", F.posexplode(F.split(marked, "\x01")).alias("pos", "block")).where(F.col("block").rlike(_TITLE) & (F.col("pos") > 0))
    opening = F.regexp_extract("block", r"^<a\b[^>]*>", 0)
    href = text.decode_entities(F.regexp_extract(opening, r'\shref="([^"]*)"', 1))
    rows = blocks.select(
        "query", "page", F.col("pos").cast("bigint").alias("pos"), result_target(href).alias("url"),
        text.clean_text(F.regexp_extract("block", _TITLE, 1)).alias("title"), text.clean_text(F.regexp_extract("block", _SNIPPET, 1)).alias("snippet"),
    )
    return rows.where(urls.is_http(F.col("url")))


def page_status(status: Column) -> Column:
    """What the status of an answer means: fine, a challenge, blocked, worth another try, or lost."""
    return (
        F.when(status.between(200, 299) & (status != 202), "ok").when(status == 202, "challenge").when(status == 403, "blocked").when(status >= 500, "retry").otherwise("error")
    )


def json_items(answers: DataFrame, path: str = "$.results") -> DataFrame:
    """(query, page, pos, item): the members of the results array of JSON answers; answers: query,
    page, body. Answers without such an array have none."""
    members = F.try_variant_get(F.try_parse_json("body"), path, "array<variant>")
    return answers.select("query", "page", F.posexplode(members).alias("pos", "v")).select("query", "page", (F.col("pos") + 1).cast("bigint").alias("pos"), F.to_json("v").alias("item"))


def news_items(items: DataFrame) -> DataFrame:
    """News of a media answer: an http address and a title are needed, an image only if it is http."""
    i = F.col("item")
    image = jsonx.text_at(i, "$.image")
    rows = items.select(
        "query", "page", "pos", jsonx.text_at(i, "$.url").alias("url"), jsonx.text_at(i, "$.title").alias("title"), F.coalesce(jsonx.text_at(i, "$.excerpt"), F.lit("")).alias("snippet"),
        jsonx.text_at(i, "$.date").alias("date"), F.when(urls.is_http(image), image).alias("image_url"),
    )
    return rows.where(urls.is_http(F.col("url")) & F.col("title").isNotNull())


def image_items(items: DataFrame) -> DataFrame:
    """Images of a media answer: an http image is needed; the page only if it is another address."""
    i = F.col("item")
    page = jsonx.text_at(i, "$.url")
    rows = items.select(
        "query", "page", "pos", jsonx.text_at(i, "$.image").alias("image_url"), page.alias("url"), jsonx.text_at(i, "$.title").alias("title"),
        jsonx.int_at(i, "$.width").alias("width"), jsonx.int_at(i, "$.height").alias("height"),
    )
    own = urls.is_http(F.col("url")) & (F.col("url") != F.col("image_url"))
    return rows.where(urls.is_http(F.col("image_url"))).withColumn("url", F.when(own, F.col("url")))


def meta_items(items: DataFrame, source: str) -> DataFrame:
    """Results of a meta search for one source, by the fields it has for it."""
    i = F.col("item")
    at = lambda p: F.try_variant_get(F.try_parse_json(i), p, "string")
    url = at("$.url")
    if source == "images":
        size = jsonx.resolution(at("$.resolution"))
        rows = items.select("query", "page", "pos", at("$.img_src").alias("image_url"), url.alias("url"), at("$.title").alias("title"), size["width"].alias("width"), size["height"].alias("height"))
        return rows.where(urls.is_http(F.col("image_url"))).withColumn("url", F.when(F.col("url") != F.col("image_url"), F.col("url")))
    base = items.select("query", "page", "pos", url.alias("url"), F.coalesce(at("$.title"), F.lit("")).alias("title"), F.coalesce(at("$.content"), F.lit("")).alias("snippet"),
                        at("$.publishedDate").alias("date"), F.coalesce(at("$.thumbnail_src"), at("$.img_src")).alias("image_url"))
    rows = base.where(urls.is_http(F.col("url")))
    return rows.drop("date", "image_url") if source == "web" else rows


def engine_errors(body: Column) -> Column:
    """The failures a meta search reports, as one text: strings, lists of strings and objects with an
    error."""
    entries = F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.unresponsive_engines", "array<variant>"), F.array().cast("array<variant>"))

    def one(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        words = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
        joined = F.array_join(F.transform(words, lambda x: F.try_variant_get(x, "$", "string")), " ")
        return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), joined).otherwise(F.try_variant_get(v, "$.error", "string"))

    return F.array_join(F.filter(F.transform(entries, one), lambda x: x.isNotNull()), "; ")


def vqd_token(html: Column) -> Column:
    """The token of a search page, in double quotes, bare, or in single quotes, in this order; null
    if there is none or the page is too long."""
    forms = [r'vqd="([^"]+)"', r"vqd=([0-9-]+)&", r"vqd='([^']+)'"]
    return F.when(F.length(html) <= MOST_HTML, F.coalesce(*[F.nullif(F.regexp_extract(html, f, 1), F.lit("")) for f in forms]))


def until_dry(rows: DataFrame, limit: int, key: str = "url", most_pages: int = 5) -> DataFrame:
    """``rows`` (query, page, pos, ...) as paging would collect them, with ``position`` from 1.

    Doubles by ``key`` fall to the first; pages are read up to ``most_pages``, up to the first that
    adds nothing, and up to the one that reaches ``limit``; then the first ``limit`` rows are taken
    and numbered. Rows with a null key are no doubles of anything.
    """
    made = rows.where(F.col("page") <= most_pages).withColumn("ws_key", urls.url_key(F.col(key)))
    fresh = keep_first(made, ["query", "ws_key"], ["page", "pos"], nulls=True).drop("ws_key")
    pages = fresh.groupBy("query", "page").agg(F.count(F.lit(1)).alias("added"))
    upto = W.partitionBy("query").orderBy("page")
    read = (
        pages.withColumn("nth", F.row_number().over(upto)).withColumn("before", F.coalesce(F.sum("added").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .where((F.col("nth") == F.col("page")) & (F.col("before") < limit)).select("query", "page")
    )
    kept = fresh.join(read, ["query", "page"])
    ranked = kept.withColumn("position", F.row_number().over(W.partitionBy("query").orderBy("page", "pos")).cast("bigint"))
    return ranked.where(F.col("position") <= limit)


def deduped(rows: DataFrame, limit: int, key: str = "url") -> DataFrame:
    """As a meta search collects: all rows of all pages, doubles to the first, numbered, cut."""
    first = keep_first(rows.withColumn("ws_key", urls.url_key(F.col(key))), ["query", "ws_key"], ["page", "pos"], nulls=True).drop("ws_key")
    ranked = first.withColumn("position", F.row_number().over(W.partitionBy("query").orderBy("page", "pos")).cast("bigint"))
    return ranked.where(F.col("position") <= limit)


def parse_chain(raw: str | None, endpoint: str | None = None) -> tuple[list[str], list[str]]:
    """(providers, warnings) of a configured chain: names cut at commas, unknown ones skipped, doubles
    dropped, the meta search only with an address. A blank setting means the usual chain."""
    names = [t.strip().lower() for t in (raw or "").split(",")]
    names = [n for n in names if n]
    if not names:
        return list(DEFAULT_CHAIN), []
    warnings = [f'unknown search provider "{n}" skipped' for n in names if n not in CAPABILITIES]
    chain = list(dict.fromkeys(n for n in names if n in CAPABILITIES))
    if "searxng" in chain and not endpoint:
        chain.remove("searxng")
        warnings.append("searxng skipped: SEARXNG_ENDPOINT not configured")
    return chain, warnings


def first_success(rows: DataFrame, chain: list[str], sources: list[str]) -> DataFrame:
    """``rows`` (query, provider, source, ...) of the provider that wins each source: the first of the
    chain that can serve it and has a row for it. The chain is a few names, so its order is a plain
    expression; the winner is found by aggregation, not by asking one provider after the other."""
    order = F.array_position(F.array(*[F.lit(c) for c in chain]), F.col("provider"))
    able = F.array_contains(F.element_at(F.create_map(*[x for p in chain for x in (F.lit(p), F.array(*[F.lit(s) for s in CAPABILITIES[p]]))]), F.col("provider")), F.col("source"))
    good = rows.where(F.col("source").isin(*sources) & F.col("provider").isin(*chain)).withColumn("ws_place", order).where(able)
    best = good.groupBy("query", "source").agg(F.min("ws_place").alias("ws_place"))
    return good.join(best, ["query", "source", "ws_place"]).drop("ws_place")


def missing_sources(asked: DataFrame, winners: DataFrame) -> DataFrame:
    """(query, source, warning): sources nobody had results for. asked: query, source."""
    none = asked.select("query", "source").distinct().join(winners.select("query", "source").distinct(), ["query", "source"], "left_anti")
    return none.withColumn("warning", F.concat(F.lit("no provider returned results for "), F.col("source")))


def outcome(asked: DataFrame, winners: DataFrame) -> DataFrame:
    """(query, asked, served, status): whether a search as a whole has anything to show."""
    a = asked.groupBy("query").agg(F.count_distinct("source").alias("asked"))
    w = winners.groupBy("query").agg(F.count_distinct("source").alias("served"))
    both = a.join(w, "query", "left").na.fill(0, ["served"])
    return both.withColumn("status", F.when(F.col("served") == 0, "unavailable").when(F.col("served") < F.col("asked"), "partial").otherwise("complete"))


def grouped(winners: DataFrame, most: int = 100) -> DataFrame:
    """(query, web, news, images): the addresses of each source in order, null where there are none.
    A source holds ``most`` results at most, so a group is bounded."""
    ranked = winners.where(F.col("position") <= most).groupBy("query", "source").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "url"))), lambda x: x["url"]).alias("urls"))
    return ranked.groupBy("query").pivot("source", ["web", "news", "images"]).agg(F.first("urls"))


def with_pages(winners: DataFrame, pages: DataFrame) -> DataFrame:
    """Search results with their stored pages: ``found`` and the columns of ``pages`` (url unique)."""
    stored = pages.withColumnRenamed("url", "ws_u").withColumn("ws_has", F.lit(True))
    joined = winners.join(stored, F.col("url") == F.col("ws_u"), "left")
    return joined.withColumn("found", F.coalesce("ws_has", F.lit(False))).drop("ws_u", "ws_has")


def envelope(asked: DataFrame, winners: DataFrame) -> DataFrame:
    """(query, success, web, news, images, warning): how many results each source has (null for none),
    and the warnings joined; a search without any result is no success."""
    counts = winners.groupBy("query").pivot("source", ["web", "news", "images"]).agg(F.count(F.lit(1)))
    notes = missing_sources(asked, winners).groupBy("query").agg(F.array_join(F.sort_array(F.collect_set("warning")), "; ").alias("warning"))
    every = asked.select("query").distinct().join(counts, "query", "left").join(notes, "query", "left")
    some = F.coalesce("web", "news", "images").isNotNull()
    return every.select("query", some.alias("success"), "web", "news", "images", "warning")
