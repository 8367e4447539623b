"""Crawling over a stored page corpus: breadth first, level by level, within depth and budget."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.functions import urls
from webspark.io import materialize
from webspark.operators import robots
from webspark.operators.links import LinkRules, filter_links, keep_first
from webspark.operators.running import running_before


@dataclass(frozen=True)
class CrawlRules:
    """What a crawl follows and where it ends."""

    links: LinkRules = field(default_factory=LinkRules)
    limit: int = 10_000
    sitemap: str = "include"
    ignore_robots: bool = False
    user_agent: str = ""


def within_budget(rows: DataFrame, ok: Column, limit: int, group: list[str], order: str) -> DataFrame:
    """The rows that are still reached: fewer than ``limit`` successes of their group come before
    them. Failures cost nothing, and what is not reached stays pending."""
    return running_before(rows, group, order, [order], {"ws_used": ok}).where(F.col("ws_used") < limit).drop("ws_used")


def seeds(jobs: DataFrame, sitemap_links: DataFrame | None, rules: CrawlRules = CrawlRules(), robots_rules: DataFrame | None = None) -> DataFrame:
    """(job, url, rank): the first level of each job: its own address, then the links of its sitemap
    that the rules let through. jobs: job, url; sitemap_links: job, ord, url. Only the job's own
    robots rules count here. A job for the sitemap alone does not visit its own address."""
    own = jobs.select("job", F.coalesce(urls.without_fragment(F.col("url")), F.col("url")).alias("url"), F.lit(0).cast("bigint").alias("rank"))
    parts = [own] if rules.sitemap != "only" else []
    if sitemap_links is not None and rules.sitemap != "skip":
        listed = sitemap_links.groupBy("job").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]).alias("links"))
        pages = jobs.join(listed, "job").select(F.col("job").alias("page"), "url", "links", F.lit(-1).alias("depth"))
        found = filter_links(pages, rules.links).select(F.col("page").alias("job"), "url", F.col("ord").alias("rank"))
        if robots_rules is not None and not rules.ignore_robots:
            based = found.join(jobs.select("job", urls.origin(F.col("url")).alias("ws_o")), "job").join(robots_rules.withColumnRenamed("origin", "ws_o"), "ws_o", "left")
            found = based.where(robots.is_allowed(urls.request_path(F.col("url")), F.col("allow"), F.col("disallow"))).select("job", "url", "rank")
        parts.append(found)
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return keep_first(every, ["job", "url"], ["rank"])


def crawl(starts: DataFrame, pages: DataFrame, rules: CrawlRules = CrawlRules(), robots_rules: DataFrame | None = None) -> DataFrame:
    """(job, url, depth, rank, status): every address a crawl of stored pages queues.

    starts: job, url, rank; pages: url (unique), links. Level by level: forbidden addresses fail and
    are reported (status blocked), addresses without a page fail, the others are done until the
    budget of successes is spent, and what comes after stays pending and is not followed. Links are
    filtered against the linking page, first ones kept in the order of their pages, and none twice.
    A level is an equi-join, an anti-join with what is known, and one write; the driver only learns
    whether a level has rows. The budget is a running sum inside each job.
    """
    spent = None
    level = starts.select("job", "url", F.lit(0).alias("depth"), F.col("rank").cast("bigint").alias("rank"))
    known: list[DataFrame] = []
    depth = 0
    while True:
        gated = robots.with_permission(level, robots_rules).drop("crawl_delay") if robots_rules is not None and not rules.ignore_robots else level.withColumn("allowed", F.lit(True))
        fetched = gated.join(pages.select(F.col("url").alias("ws_u"), "links", F.lit(True).alias("ws_has")), F.col("url") == F.col("ws_u"), "left")
        ok = F.coalesce(F.col("allowed") & F.col("ws_has"), F.lit(False))
        counted = fetched.withColumn("ok", ok)
        if spent is not None:
            counted = counted.join(spent, "job", "left").na.fill(0, ["spent"])
        else:
            counted = counted.withColumn("spent", F.lit(0).cast("bigint"))
        counted = running_before(counted, ["job"], "rank", ["rank"], {"earlier": F.col("ok")})
        used = F.col("spent") + F.col("earlier")
        status = F.when(used >= rules.limit, "pending").when(~F.col("allowed"), "blocked").when(F.col("ok"), "done").otherwise("failed")
        last = F.when(used + 1 >= rules.limit, True).otherwise(False)
        done = materialize(counted.select("job", "url", "depth", "rank", status.alias("status"), last.alias("last"), F.when(status == "done", F.col("links")).alias("links")), "crawl-level")
        known.append(done.select("job", "url", "depth", "rank", "status"))
        everything = known[0]
        for part in known[1:]:
            everything = everything.unionByName(part)
        if depth >= rules.links.max_depth:
            break
        # the page that spends the budget is not followed
        source = done.where("status = 'done' and not last and links is not null")
        pages_in = source.select(F.struct("job", "rank").alias("page"), "url", "links", "depth")
        found = filter_links(pages_in, rules.links).select(F.col("page.job").alias("job"), F.col("page.rank").alias("parent"), "ord", "url", "depth")
        fresh = keep_first(found, ["job", "url"], ["parent", "ord"]).join(everything.select("job", "url"), ["job", "url"], "left_anti")
        ranked = running_before(fresh, ["job"], "parent", ["parent", "ord"], {"rank": F.lit(1)})
        level = materialize(ranked.select("job", "url", "depth", "rank"), "crawl-frontier")
        if not level.limit(1).count():
            break
        spent = materialize(everything.where("status = 'done'").groupBy("job").agg(F.count(F.lit(1)).alias("spent")), "crawl-spent")
        depth += 1
    return everything


def gate(queue: DataFrame, robots_rules: DataFrame) -> DataFrame:
    """(job_id, id, url, allowed, crawl_delay): which addresses of a queue their robots files allow."""
    return robots.with_permission(queue.select("job_id", "id", "url"), robots_rules)


def blocked_results(gated: DataFrame) -> DataFrame:
    """The failed results of forbidden addresses."""
    return gated.where(~F.col("allowed")).select("job_id", "id", "url", F.lit("failed").alias("status"), F.lit(robots.DISALLOWED).alias("error"))


def pace(gated: DataFrame, least: float = 1.0, most: float = 10.0) -> DataFrame:
    """(job_id, crawl_delay, wait): the longest delay that a job's robots files ask for, and the pause
    between its batches."""
    longest = gated.groupBy("job_id").agg(F.max("crawl_delay").alias("crawl_delay"))
    return longest.withColumn("wait", F.least(F.greatest(F.coalesce("crawl_delay", F.lit(least)), F.lit(least)), F.lit(most)))
