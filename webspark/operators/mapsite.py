"""Maps of sites: page links joined with sitemap links, without doubles, searched and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webspark.functions import urls
from webspark.operators.links import keep_first
from webspark.operators.sitemap import MOST_LINKS

EMPTY_WARNING = "browser discovery returned no links"
SEARCH_WARNING = "search relevance ordering is not supported; results are filtered by substring"


def _searched(df: DataFrame, search: str | None) -> DataFrame:
    return df.where(F.contains(F.lower("url"), F.lit(search.lower()))) if search else df


def map_sorted(page_links: DataFrame, sitemap_links: DataFrame, search: str | None = None, limit: int = MOST_LINKS) -> DataFrame:
    """(site, rank, url): the older map: all links once, in alphabetical order, the first ``limit``
    of each site. Both inputs: site, url."""
    every = _searched(page_links.select("site", "url").unionByName(sitemap_links.select("site", "url")).distinct(), search)
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("site").orderBy("url")).cast("bigint"))
    return ranked.where(F.col("rank") <= limit).select("site", "rank", "url")


def map_site(
    page_links: DataFrame, sitemap_links: DataFrame, sitemap: str = "include", ignore_query: bool = True, search: str | None = None, limit: int = MOST_LINKS
) -> DataFrame:
    """(site, rank, url): links in the order of discovery, page links before those of the sitemap,
    the first of those that differ in the query only. Both inputs: site, ord, url. ``sitemap``:
    include, skip or only. The limit is a rank inside each site, pushed below the shuffle."""
    sides = []
    if sitemap != "only":
        sides.append(page_links.select("site", F.lit(0).alias("side"), "ord", "url"))
    if sitemap != "skip":
        sides.append(sitemap_links.select("site", F.lit(1).alias("side"), "ord", "url"))
    merged = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    first = keep_first(merged.withColumn("ws_key", urls.dedupe_key(F.col("url"), ignore_query)), ["site", "ws_key"], ["side", "ord", "url"]).drop("ws_key")
    ranked = _searched(first, search).withColumn("rank", F.row_number().over(W.partitionBy("site").orderBy("side", "ord", "url")).cast("bigint"))
    return ranked.where(F.col("rank") <= limit).select("site", "rank", "url")


def map_warnings(maps: DataFrame, sites: DataFrame, searched: bool = False) -> DataFrame:
    """(site, warning): what a map has to say about each site; null where nothing."""
    some = maps.select("site").distinct().withColumn("some", F.lit(True))
    note = F.concat_ws("; ", F.when(F.col("some").isNull(), EMPTY_WARNING), F.lit(SEARCH_WARNING) if searched else F.lit(None))
    return sites.select("site").distinct().join(some, "site", "left").select("site", F.nullif(note, F.lit("")).alias("warning"))
