"""The job store: read models and transitions over jobs, queue and results.

Counters and statuses are derived from the rows rather than kept up to date, and every transition is
a new table, so a step that runs twice gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webspark.functions import dates, jsonx
from webspark.operators.links import keep_first
from webspark.operators.robots import DISALLOWED

TERMINAL = ("completed", "failed", "cancelled")
DEFAULT_CAP, MOST_CAP = 100, 1000
PAGE_SIZE = 50


def cap(limit: float | None = None) -> int:
    """How many rows an auxiliary list gives: 100 unless asked, 1000 at most."""
    if limit is None or limit != limit or limit in (float("inf"), float("-inf")) or limit < 1:
        return DEFAULT_CAP
    return min(int(limit), MOST_CAP)


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def counters(queue: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, total, pending, processing, done, failed, completed, blocked): what the rows of each
    job add up to. Jobs that lost their own row count too; a null job_id belongs to no job. Both
    sides are counted before they meet, so a hot job is one row a map task."""
    s = F.col("status")
    q = queue.where("job_id is not null").groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), *[_count_if(s == x, x) for x in ("pending", "processing", "done", "failed")])
    r = results.where("job_id is not null").groupBy("job_id").agg(_count_if(s == "completed", "completed"), _count_if((s == "failed") & (F.col("error") == DISALLOWED), "blocked"))
    return q.join(r, "job_id", "full").na.fill(0)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def terminal_status(attempted: Column, succeeded: Column, current: Column) -> Column:
    """The status a job ends with: cancelled and failed stay, nothing but failures is a failure."""
    return F.when(current.isin("cancelled", "failed"), current).when((attempted > 0) & (succeeded == 0), "failed").otherwise("completed")


def finalize(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, status): jobs still scraping get their terminal status, all others keep theirs."""
    c = counts.select(F.col("job_id").alias("id"), (F.col("completed") + F.col("failed")).alias("tried"), "completed")
    joined = jobs.select("id", "status").join(c, "id", "left").na.fill(0, ["tried", "completed"])
    return joined.select("id", F.when(F.col("status") == "scraping", terminal_status(F.col("tried"), F.col("completed"), F.col("status"))).otherwise(F.col("status")).alias("status"))


def last_status(changes: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """(key, status, n): the last status of each key, and the number of changes."""
    return changes.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("n"))


def claim(queue: DataFrame, size: int = 5) -> DataFrame:
    """(job_id, id, url, depth): the pending rows with the lowest ids of each job."""
    ranked = queue.where("status = 'pending'").withColumn("rank", F.row_number().over(W.partitionBy("job_id").orderBy("id")))
    return ranked.where(F.col("rank") <= size).select("job_id", "id", "url", "depth")


def with_status(queue: DataFrame, ids: DataFrame, status: str, only: str | None = None) -> DataFrame:
    """``queue`` with a new status for the rows whose id is in ``ids`` (and whose status is ``only``)."""
    marked = ids.select(F.col("id").alias("ws_id")).distinct().withColumn("ws_hit", F.lit(True))
    hit = F.col("ws_hit") & (F.col("status") == only) if only else F.col("ws_hit")
    return queue.join(marked, F.col("id") == F.col("ws_id"), "left").withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("ws_id", "ws_hit")


def create_jobs(seeds: DataFrame, now: int, days: int = 7) -> DataFrame:
    """The rows of new jobs: scraping, nothing counted. seeds: id, url, options."""
    t = F.lit(now).cast("bigint")
    zero, none = F.lit(0).cast("bigint"), F.lit(None)
    return seeds.select(
        "id", "url", F.lit("scraping").alias("status"), jsonx.valid(F.col("options")).alias("options"), none.cast("string").alias("error"), zero.alias("total"), zero.alias("completed"),
        t.alias("created_at"), t.alias("updated_at"), dates.expiry(t, days).alias("expires_at"), none.cast("bigint").alias("completed_at"),
    )


def enqueue(candidates: DataFrame, queue: DataFrame) -> DataFrame:
    """(job_id, url, depth): the candidates a queue takes in: the first of each job and address, in
    the order of ``ord``, and none it has. candidates: job_id, ord, url, depth. Addresses count as
    they are written."""
    fresh = keep_first(candidates.where("job_id is not null and url is not null"), ["job_id", "url"], ["ord", "depth"])
    return fresh.join(queue.select("job_id", "url"), ["job_id", "url"], "left_anti").select("job_id", "url", "depth")


def insert_results(results: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """``results`` with new rows; rows: id, job_id, url, status and any of the other columns. What is
    missing is null; metadata and json that are no JSON become null rather than fail the insert."""
    have = set(rows.columns)
    text = lambda c: jsonx.valid(F.col(c)) if c in ("metadata", "json") else F.col(c)
    fields = [(text(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in results.schema if f.name != "created_at"]
    return results.unionByName(rows.select(*fields, F.lit(now).cast("bigint").alias("created_at")))


def results_page(results: DataFrame, limit: int = PAGE_SIZE, after: int = 0) -> DataFrame:
    """The first ``limit`` results of each job with an id above ``after``, in order, with ``next``:
    where the following page starts, on the last row of a page that has one."""
    ranked = results.where(F.col("id") > after).withColumn("rank", F.row_number().over(W.partitionBy("job_id").orderBy("id"))).where(F.col("rank") <= limit + 1)
    more = ranked.withColumn("more", F.lead("id").over(W.partitionBy("job_id").orderBy("id")).isNotNull()).where(F.col("rank") <= limit)
    link = F.concat(F.lit("/v2/crawl/"), F.col("job_id"), F.lit("?skip="), F.col("id").cast("string"), F.lit(f"&limit={limit}"))
    return more.withColumn("next", F.when((F.col("rank") == limit) & F.col("more"), link)).drop("more").withColumn("rank", F.col("rank").cast("bigint"))


def data_item(df: DataFrame) -> Column:
    """A result as JSON for readers: names as the interface has them, null fields left out; links
    keep their strings only, metadata and json are values, and null where they are no JSON."""
    parsed = [F.try_parse_json(F.col(c)).alias(c) for c in ("metadata", "json")]
    plain = [F.col("url"), F.col("status"), F.col("markdown"), F.col("html"), F.col("raw_html").alias("rawHtml"), F.filter("links", lambda x: x.isNotNull()).alias("links")]
    return F.to_json(F.struct(*plain, *parsed, F.col("error")))


def errors(results: DataFrame, limit: int | None = None) -> DataFrame:
    """(job_id, id, timestamp, url, error): failed results that say why, newest first, so many a job."""
    ranked = results.where("status = 'failed' and error is not null").withColumn("rank", F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("id"))))
    return ranked.where(F.col("rank") <= cap(limit)).select("job_id", "id", F.col("created_at").alias("timestamp"), "url", "error")


def robots_blocked(results: DataFrame, limit: int | None = None) -> DataFrame:
    """(job_id, url): the addresses that robots files forbade, each once, in order, so many a job."""
    rows = results.where(f"status = 'failed' and error = '{DISALLOWED}'").select("job_id", "url").distinct()
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("job_id").orderBy("url"))).where(F.col("rank") <= cap(limit)).drop("rank")


def active(jobs: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """Jobs still scraping and not expired, oldest first."""
    return jobs.where((F.col("status") == "scraping") & (F.col("expires_at") > now)).orderBy("created_at", "id").limit(cap(limit)).select("id", "url", "status", "total", "completed", "created_at")


def status_view(jobs: DataFrame) -> DataFrame:
    """Jobs as readers see them: ISO times, seconds of duration once they ended, no credits used."""
    ended = F.col("completed_at").isNotNull()
    return jobs.select(
        "id", "status", "total", "completed", F.lit(0).alias("credits_used"), dates.iso(F.col("expires_at")).alias("expires_at"), dates.iso(F.col("created_at")).alias("created_at"),
        F.when(ended, dates.iso(F.col("completed_at"))).alias("completed_at"), F.when(ended, dates.seconds_between(F.col("created_at"), F.col("completed_at"))).alias("duration"),
    )


def purge(jobs: DataFrame, queue: DataFrame, results: DataFrame, now: int, keep_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without jobs that expired longer ago than ``keep_seconds``, and their rows."""
    gone = jobs.where(F.col("expires_at") < dates.retention_cutoff(now, keep_seconds)).select(F.col("id").alias("ws_job"))
    left = lambda df, c: df.join(gone, F.col(c) == F.col("ws_job"), "left_anti")
    return left(jobs, "id"), left(queue, "job_id"), left(results, "job_id")


def terminal_payload(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(id, type, status, total, completed, n_data, data): what is sent when a job has ended, with its
    first results as a JSON array. Bounded by the page size for each job."""
    page = results_page(results.select("id", "job_id", "url", "status", "markdown", "html", "raw_html", "links", "metadata", "json", "error"))
    items = page.select("job_id", "rank", data_item(page).alias("item")).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("items"))
    ended = jobs.where(is_terminal(F.col("status"))).join(items.withColumnRenamed("job_id", "ws_job"), F.col("id") == F.col("ws_job"), "left")
    kind = F.when(F.col("status") == "failed", "crawl.failed").otherwise("crawl.completed")
    data = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]"))
    return ended.select("id", kind.alias("type"), "status", "total", "completed", F.coalesce(F.size("items"), F.lit(0)).alias("n_data"), F.coalesce(data, F.lit("[]")).alias("data"))


def to_deliver(payloads: DataFrame, events: list[str] | None) -> DataFrame:
    """The payloads a webhook wants: all without a list, else those whose status is on it."""
    return payloads.where(F.col("status").isin(*events)) if events else payloads
