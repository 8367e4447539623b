"""Links of pages: filtering for a crawl, discovery for a map, scope and assets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webspark.functions import urls


@dataclass(frozen=True)
class LinkRules:
    """Which links of a page a crawl follows."""

    max_depth: int = 10
    allow_external: bool = False
    allow_subdomains: bool = False
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


def keep_first(df: DataFrame, key: list[str], order: list[str], nulls: bool = False) -> DataFrame:
    """The first row of each key in the given order; null counts as a key like others, or, with
    ``nulls``, rows with a null in their key are all kept.

    Order columns must tell the rows apart. The limit of one on the row number is pushed below the
    shuffle, so each task sends one row a key. To keep rows with nulls, the null is taken for a key of
    the row's own, made of its order columns.
    """
    parts = key
    if nulls:
        own = F.concat_ws("\x01", F.lit("\x00"), *[F.col(c).cast("string") for c in order])
        parts = [F.coalesce(F.col(k).cast("string"), own) for k in key]
    return df.withColumn("ws_rank", F.row_number().over(W.partitionBy(*parts).orderBy(*order))).where("ws_rank = 1").drop("ws_rank")


def exploded_links(pages: DataFrame, base: str = "url", links: str = "links") -> DataFrame:
    """``pages`` with a row a link: ``ord`` from 1 and ``link``; null links are dropped."""
    return pages.select("*", F.posexplode(links).alias("ws_pos", "link")).where("link is not null").withColumn("ord", (F.col("ws_pos") + 1).cast("bigint")).drop("ws_pos", links)


def filter_links(pages: DataFrame, rules: LinkRules = LinkRules(), seen: DataFrame | None = None) -> DataFrame:
    """(page, ord, url, depth): the links of each page that a crawl follows, first ones kept.

    pages: page (unique), url, links, depth (that of the page). In this order links are dropped:
    beyond the depth, blank or a fragment, of a scheme that leads to no page, unresolvable or not
    http(s), outside the scope of the linking page's host, with the extension of a file, and failing
    the globs. Fragments are cut off; of equal addresses of a page the first stays, and none that
    ``seen`` (url) holds. Pages without links or with an address that is none give no rows.
    """
    rows = (
        exploded_links(pages.select("page", F.col("url").alias("base"), "links", (F.col("depth") + 1).cast("int").alias("depth")))
        .where((F.col("depth") <= rules.max_depth) & urls.is_http(F.col("base")))
        .withColumn("raw", F.trim(F.col("link")))
        .where((F.col("raw") != "") & ~F.startswith("raw", F.lit("#")) & ~urls.leads_elsewhere(F.col("raw")))
        .select("page", "ord", "depth", "base", F.regexp_replace(urls.resolve(F.col("raw"), F.col("base")), r"#.*$", "").alias("url"))
        .where("url is not null")
    )
    kept = rows.where(~urls.has_asset_extension(urls.path(F.col("url"))) & urls.passes_globs(urls.path(F.col("url")), rules.include, rules.exclude))
    if not rules.allow_external:
        kept = kept.where(urls.is_internal_host(urls.host(F.col("base")), urls.host(F.col("url")), rules.allow_subdomains))
    first = keep_first(kept.select("page", "ord", "url", "depth"), ["page", "url"], ["ord"])
    return first.join(seen.select("url").distinct(), "url", "left_anti").select("page", "ord", "url", "depth") if seen is not None else first


def discover_links(pages: DataFrame, include_subdomains: bool = False) -> DataFrame:
    """(page, ord, url): the http links of each page into its own host (or below it), without
    fragment and slash at the end, first ones kept. pages: page, url, links."""
    rows = exploded_links(pages.select("page", F.col("url").alias("base"), "links")).where(urls.is_http(F.col("link")))
    mine = rows.where(urls.is_internal_host(urls.host(F.col("base")), urls.host(F.col("link")), include_subdomains))
    return keep_first(mine.select("page", "ord", urls.discovery_form(F.col("link")).alias("url")), ["page", "url"], ["ord"])


def link_scope(base: Column, link: Column) -> Column:
    """Where a link leads: same host, a host below it, another host, or no page."""
    b, h = urls.host(base), urls.host(link)
    return F.when(~urls.is_http(link), "none").when(b == h, "same").when(F.endswith(h, F.concat(F.lit("."), b)), "below").otherwise("other")
