"""Page extraction over stored pages: the formats asked for, metadata and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.functions import html as H
from webspark.functions import urls


def joined_warnings(*warnings: Column) -> Column:
    """Warnings in one text; null if there are none."""
    return F.nullif(F.concat_ws("; ", *warnings), F.lit(""))


def metadata(df: DataFrame, warning: Column | None = None) -> Column:
    """Struct of title, description, sourceURL, statusCode, error and, where there is one, warning."""
    fields = [
        H.title(F.col("html")).alias("title"), H.description(F.col("html")).alias("description"), F.col("url").alias("sourceURL"),
        F.coalesce("status_code", F.lit(0)).alias("statusCode"), F.lit(None).cast("string").alias("error"),
    ]
    return F.struct(*fields, *([warning.alias("warning")] if warning is not None else []))


def page_links(pages: DataFrame) -> DataFrame:
    """(id, ord, href, url): anchors of pages in order, as written and as the page means them; repeats
    and targets that are no pages are kept (url is null for them). pages: id, url, html."""
    rows = pages.where("html is not null").select("id", F.col("url").alias("base"), F.posexplode(H.hrefs(F.col("html"))).alias("pos", "href"))
    return rows.select("id", (F.col("pos") + 1).cast("bigint").alias("ord"), "href", urls.resolve(F.col("href"), F.col("base")).alias("url"))


def scrape(wanted: DataFrame, pages: DataFrame, formats: tuple[str, ...] = ("markdown",), main_only: bool = True) -> DataFrame:
    """(url, found, title, description and a column a format): stored pages in the formats asked for.

    wanted: url; pages: url (unique), html, status_code. An address without a page has found false
    and nulls. Formats: markdown, html, rawHtml, links; those not asked for are not computed, since
    their expressions are not in the plan.
    """
    got = wanted.select("url").distinct().join(pages.select(F.col("url").alias("ws_u"), "html", "status_code"), F.col("url") == F.col("ws_u"), "left")
    found = F.col("ws_u").isNotNull()
    source = F.col("html")
    make = {
        "markdown": lambda: H.to_markdown(source, main_only), "html": lambda: H.main_content(source, main_only), "rawHtml": lambda: source,
        "links": lambda: F.coalesce(H.hrefs(source), F.array().cast("array<string>")),
    }
    return got.select(
        "url", found.alias("found"), F.when(found, H.title(source)).alias("title"), F.when(found, H.description(source)).alias("description"),
        *[F.when(found, make[f]()).alias(f) for f in formats if f in make],
    )
