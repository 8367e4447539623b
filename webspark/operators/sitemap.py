"""Sitemaps: entries in robots files, addresses in files, and the walk through index files."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webspark.functions import text, urls
from webspark.io import materialize
from webspark.operators.links import keep_first


#: The most addresses a site's sitemaps give: the largest limit that can be asked for.
MOST_LINKS = 100_000


def body_text(body: Column) -> Column:
    """Text of a response body: gzip by its first bytes, else UTF-8; what calls itself gzip and is
    none is taken as text. Only packed bodies go to Python."""

    @F.pandas_udf("string")
    def unpack(values: pd.Series) -> pd.Series:
        def one(v: bytes | None) -> str | None:
            if v is None:
                return None
            try:
                v = zlib.decompress(v, 31)
            except zlib.error:
                pass
            return v.decode("utf-8", "replace")

        return values.map(one)

    packed = F.coalesce(F.startswith(body, F.lit(b"\x1f\x8b")), F.lit(False))
    return F.when(packed, unpack(F.when(packed, body))).otherwise(F.decode(body, "UTF-8"))


def is_index(xml: Column) -> Column:
    return F.coalesce(xml.rlike(r"(?i)<sitemapindex[\s>]"), F.lit(False))


def locations(xml: Column, tag: str) -> Column:
    """The address of each block of a tag, entities decoded; blocks without one are left out."""
    blocks = F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    found = F.transform(blocks, lambda b: F.regexp_extract(b, r"(?is)<loc\b[^>]*>(.*?)</loc>", 1))
    return F.filter(found, lambda x: x != "")


def simple_locations(xml: Column) -> Column:
    """The older reading: every plain loc element that begins with http; nothing is decoded."""
    return F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1)), F.trim), lambda x: F.startswith(x, F.lit("http")))


def entries(robots: DataFrame) -> DataFrame:
    """(origin, ord, url): the sitemaps of each origin: those its robots file names, else the usual
    place. robots: origin, status, body; only bodies of status 200 to 299 are read."""
    ok = F.col("status").between(200, 299) & F.col("body").isNotNull()
    lines = F.when(ok, F.filter(F.split("body", r"\r?\n"), lambda l: l.rlike(r"(?i)^\s*sitemap\s*:\s*\S+"))).otherwise(F.array().cast("array<string>"))
    named = (
        robots.select("origin", F.posexplode_outer(lines).alias("pos", "line"))
        .select("origin", "pos", urls.resolve(F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1), F.concat("origin", F.lit("/robots.txt"))).alias("url"))
    )
    given = named.where("pos is not null and url is not null").select("origin", (F.col("pos") + 1).cast("bigint").alias("ord"), "url")
    usual = robots.select("origin").distinct().join(given.select("origin").distinct(), "origin", "left_anti").select("origin", F.lit(1).cast("bigint").alias("ord"), F.concat("origin", F.lit("/sitemap.xml")).alias("url"))
    return given.unionByName(usual)


def file_locations(files: DataFrame, tag: str) -> DataFrame:
    """(url, ord, loc): absolute addresses in sitemap files; files: url, xml."""
    decoded = text.decode_xml_entities(text.strip_cdata(F.col("raw")))
    rows = files.select("url", F.posexplode(locations(F.col("xml"), tag)).alias("pos", "raw")).select("url", (F.col("pos") + 1).cast("bigint").alias("ord"), F.trim(decoded).alias("raw"))
    return rows.select("url", "ord", urls.resolve(F.col("raw"), F.col("url")).alias("loc")).where("loc is not null")


def walk(starts: DataFrame, files: DataFrame, max_depth: int = 3, limit: int = MOST_LINKS) -> DataFrame:
    """(origin, rank, loc): the addresses that the sitemaps of each origin hold, in reading order.

    starts: origin, ord, url; files: url, xml. Indexes are followed level by level down to
    ``max_depth``, no file twice for an origin; what a file holds stands where its index names it.
    Each level is an equi-join and is written before the next, so the plan does not grow; the loop
    only asks whether a level has rows. ``limit`` keeps the first addresses of each origin.
    """
    # the place of a file is the path of its positions, as text that sorts in reading order
    place = lambda c: F.lpad(c.cast("string"), 9, "0")
    level = keep_first(starts.select("origin", "url", place(F.col("ord")).alias("place")), ["origin", "url"], ["place"])
    indexes = materialize(file_locations(files.where(is_index(F.col("xml"))), "sitemap"), "sitemap-indexes")
    leaves = file_locations(files.where(~is_index(F.col("xml"))), "url")
    seen = materialize(level, "sitemap-level")
    level, parts, depth = seen, [seen], 0
    while depth < max_depth:
        below = level.join(indexes, "url").select("origin", F.col("loc").alias("url"), F.concat("place", F.lit("/"), place(F.col("ord"))).alias("place"))
        fresh = keep_first(below, ["origin", "url"], ["place"]).join(seen.select("origin", "url"), ["origin", "url"], "left_anti")
        level = materialize(fresh, "sitemap-level")
        if not level.limit(1).count():
            break
        parts.append(level)
        seen = seen.select("origin", "url").unionByName(level.select("origin", "url"))
        depth += 1
    visited = parts[0]
    for part in parts[1:]:
        visited = visited.unionByName(part)
    rows = visited.join(leaves, "url").select("origin", "loc", F.concat("place", F.lit("/"), place(F.col("ord"))).alias("place"))
    first = keep_first(rows, ["origin", "loc"], ["place"])
    ranked = first.select("origin", F.row_number().over(W.partitionBy("origin").orderBy("place")).cast("bigint").alias("rank"), "loc")
    return ranked.where(F.col("rank") <= limit)
