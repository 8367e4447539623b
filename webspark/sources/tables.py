"""The crawl store's tables: their schemas, and the stored pages and files that stand for fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.functions import urls
from webspark.io import table

SCHEMAS = {
    "crawl_jobs": "id string, url string, status string, options string, error string, total bigint, completed bigint, created_at bigint, updated_at bigint, expires_at bigint, completed_at bigint",
    "crawl_queue": "id bigint, job_id string, url string, depth int, status string, created_at bigint",
    "crawl_results": "id bigint, job_id string, url string, status string, status_code int, markdown string, html string, raw_html string, links array<string>, metadata string, json string, error string, created_at bigint",
    "robots_txt": "origin string, status int, body string",
    "api_keys": "id string, key_hash string, prefix string, name string, created_at bigint, last_used_at bigint, expires_at bigint, revoked_at bigint",
}
#: What must be unique in each table; a writer keeps the first row.
UNIQUE = {"crawl_jobs": ["id"], "crawl_queue": ["job_id", "url"], "crawl_results": ["id"], "robots_txt": ["origin"], "api_keys": ["key_hash"]}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, body) of the robots files that were answered; others allow everything."""
    return table(spark, sf_dir, "robots_txt").where("status between 200 and 299 and body is not null").select("origin", "body")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, url, links, depth): fetched pages; the depth of all is 0."""
    return table(spark, sf_dir, "crawl_results", "id", "url", "links", "status").where("status = 'completed'").select(F.col("id").alias("page"), "url", "links", F.lit(0).alias("depth"))


#: Ids of the queue that one made-up sitemap file covers, so that no file grows with the site.
FILE_IDS = 20_000


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, xml): sitemaps of each origin, made from the plain addresses of the queue in order of
    id, since the store holds none: an index, and a file for every FILE_IDS ids."""
    rows = table(spark, sf_dir, "crawl_queue", "id", "url").where(F.col("url").rlike(r"^https?://[a-z0-9.\-]+/[a-zA-Z0-9/._?&=\-]*\z"))
    one = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    place = F.concat(F.col("origin"), F.lit("/sitemap-"), F.col("part").cast("string"), F.lit(".xml"))
    ordered = lambda field, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, field))), lambda r: r[field]), "")
    files = (
        rows.select(urls.origin(F.col("url")).alias("origin"), F.floor(F.col("id") / FILE_IDS).alias("part"), "id", one.alias("x"))
        .groupBy("origin", "part").agg(ordered("x", "id").alias("body"))
    )
    entry = F.concat(F.lit("<sitemap><loc>"), place, F.lit("</loc></sitemap>"))
    index = files.select("origin", "part", entry.alias("x")).groupBy("origin").agg(ordered("x", "part").alias("body"))
    leaf = files.select(place.alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("xml"))
    return leaf.unionByName(index.select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>")).alias("xml")))
