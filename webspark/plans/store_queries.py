"""Queries over the job store: counters, claims, pages, errors, transitions, options, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.functions import dates, jsonx
from webspark.io import table
from webspark.operators import crawl, jobs, keys
from webspark.operators.running import running_before
from webspark.plans.catalog import query

NOW = 1_762_400_000_000


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_queue", "id", "job_id", "url", "depth", "status")


@query("""
WITH q AS (
  SELECT job_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
    count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM crawl_queue WHERE job_id IS NOT NULL GROUP BY job_id
), r AS (
  SELECT job_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed' AND error = 'robots.txt disallowed') AS blocked
  FROM crawl_results WHERE job_id IS NOT NULL GROUP BY job_id
)
SELECT coalesce(q.job_id, r.job_id) AS job_id, coalesce(total, 0) AS total, coalesce(pending, 0) AS pending, coalesce(processing, 0) AS processing,
  coalesce(done, 0) AS done, coalesce(failed, 0) AS failed, coalesce(completed, 0) AS completed, coalesce(blocked, 0) AS blocked
FROM q FULL JOIN r ON q.job_id = r.job_id""")
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    return jobs.counters(table(spark, d, "crawl_queue", "job_id", "status"), table(spark, d, "crawl_results", "job_id", "status", "error"))


_FIRST_PENDING = "SELECT *, count(*) FILTER (status = 'pending') OVER (PARTITION BY job_id ORDER BY id) AS nth FROM crawl_queue"


@query(f"SELECT job_id, id, url, depth FROM ({_FIRST_PENDING}) WHERE status = 'pending' AND nth <= 5")
def claim_batch(spark: SparkSession, d: str) -> DataFrame:
    return jobs.claim(_queue(spark, d), 5)


@query(f"""SELECT job_id, s AS status, count(*) AS n FROM (
  SELECT job_id, CASE WHEN status = 'pending' AND nth <= 5 THEN 'processing' ELSE status END AS s FROM ({_FIRST_PENDING})) GROUP BY job_id, s""")
def queue_after_claim(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "crawl_queue", "id", "job_id", "url", "depth", "status")
    claimed = jobs.with_status(queue, jobs.claim(queue, 5), "processing")
    return claimed.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT job_id, CASE status WHEN 'processing' THEN 'pending' ELSE status END AS status, count(*) AS n FROM crawl_queue GROUP BY ALL")
def queue_released(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "crawl_queue", "id", "job_id", "status")
    return jobs.with_status(queue, queue.select("id"), "pending", only="processing").groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (
  SELECT job_id, id, url, status, row_number() OVER w AS rank, lead(id) OVER w AS following FROM crawl_results WHERE id > 100 WINDOW w AS (PARTITION BY job_id ORDER BY id)
)
SELECT job_id, rank, id, url, status, CASE WHEN rank = 20 AND following IS NOT NULL THEN '/v2/crawl/' || job_id || '?skip=' || id || '&limit=20' END AS next FROM r WHERE rank <= 20""")
def results_page(spark: SparkSession, d: str) -> DataFrame:
    return jobs.results_page(table(spark, d, "crawl_results", "id", "job_id", "url", "status"), 20, 100).select("job_id", "rank", "id", "url", "status", "next")


@query("""SELECT job_id, id, created_at AS timestamp, url, error FROM crawl_results r
WHERE status = 'failed' AND error IS NOT NULL AND (SELECT count(*) FROM crawl_results x WHERE x.job_id = r.job_id AND x.status = 'failed' AND x.error IS NOT NULL AND x.id > r.id) < 2""")
def job_errors(spark: SparkSession, d: str) -> DataFrame:
    return jobs.errors(table(spark, d, "crawl_results", "id", "job_id", "url", "status", "error", "created_at"), 2)


@query("SELECT DISTINCT job_id, url FROM crawl_results WHERE status = 'failed' AND error LIKE 'robots.txt disallowed'")
def robots_blocked(spark: SparkSession, d: str) -> DataFrame:
    return jobs.robots_blocked(table(spark, d, "crawl_results", "job_id", "url", "status", "error"), 1000)


@query(f"SELECT id, url, status, total, completed, created_at FROM crawl_jobs WHERE status = 'scraping' AND expires_at > {NOW} ORDER BY created_at, id LIMIT 100")
def active_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.active(table(spark, d, "crawl_jobs"), NOW)


_ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0') || 'Z'"


@query(f"""SELECT id, status, total, completed, 0 AS credits_used, {_ISO.format('expires_at')} AS expires_at, {_ISO.format('created_at')} AS created_at,
  {_ISO.format('completed_at')} AS completed_at, (completed_at - created_at) / 1000 AS duration FROM crawl_jobs""")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    return jobs.status_view(table(spark, d, "crawl_jobs"))


@query("""
WITH gone AS (SELECT id FROM crawl_jobs WHERE expires_at < 1763000000000 - 400000 * 1000)
SELECT 'jobs' AS tbl, count(*) AS n FROM crawl_jobs WHERE id NOT IN (FROM gone)
UNION ALL SELECT 'queue', count(*) FROM crawl_queue q WHERE NOT EXISTS (FROM gone WHERE gone.id = q.job_id)
UNION ALL SELECT 'results', count(*) FROM crawl_results r WHERE NOT EXISTS (FROM gone WHERE gone.id = r.job_id)""")
def purge_expired(spark: SparkSession, d: str) -> DataFrame:
    left = jobs.purge(table(spark, d, "crawl_jobs", "id", "expires_at"), table(spark, d, "crawl_queue", "job_id"), table(spark, d, "crawl_results", "job_id"), 1_763_000_000_000, 400_000)
    parts = [df.select(F.lit(n).alias("tbl")) for n, df in zip(("jobs", "queue", "results"), left)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT DISTINCT job_id, url, 1 AS depth FROM (SELECT job_id, unnest(links) AS url FROM crawl_results) l
WHERE job_id IS NOT NULL AND url IS NOT NULL AND NOT EXISTS (FROM crawl_queue q WHERE q.job_id = l.job_id AND q.url = l.url)""")
def enqueue_ignore(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "crawl_results", "id", "job_id", "links").select("job_id", "id", F.posexplode("links").alias("pos", "url"))
    candidates = found.select("job_id", F.struct("id", "pos").alias("ord"), "url", F.lit(1).alias("depth"))
    return jobs.enqueue(candidates, table(spark, d, "crawl_queue", "job_id", "url"))


@query("""
WITH q AS (SELECT job_id, sum((status = 'failed')::INT) AS bad FROM crawl_queue GROUP BY 1), r AS (SELECT job_id, sum((status = 'completed')::INT) AS good FROM crawl_results GROUP BY 1)
SELECT id, CASE WHEN status <> 'scraping' THEN status WHEN coalesce(bad, 0) + coalesce(good, 0) > 0 AND coalesce(good, 0) = 0 THEN 'failed' ELSE 'completed' END AS status
FROM crawl_jobs j LEFT JOIN q ON q.job_id = j.id LEFT JOIN r ON r.job_id = j.id""")
def terminal_status(spark: SparkSession, d: str) -> DataFrame:
    return jobs.finalize(table(spark, d, "crawl_jobs", "id", "status"), job_counters(spark, d))


@query("""
WITH o AS (SELECT id, CASE WHEN json_valid(options) THEN options END AS o FROM crawl_jobs), v AS (
  SELECT id, try_cast(o ->> '$.limit' AS BIGINT) AS l, try_cast(o ->> '$.maxDiscoveryDepth' AS BIGINT) AS m, o ->> '$.sitemap' AS s, o -> '$.scrapeOptions.formats' AS f FROM o
)
SELECT id, CASE WHEN l > 0 THEN l ELSE 10000 END AS limit_pages, CASE WHEN m >= 0 THEN m ELSE 10 END AS max_depth, CASE WHEN s IN ('skip', 'only') THEN s ELSE 'include' END AS sitemap,
  coalesce(array_to_string(from_json(f, '["VARCHAR"]'), ','), 'markdown') AS formats FROM v""")
def job_options(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("options")
    limit, depth, sitemap = jsonx.int_at(o, "$.limit"), jsonx.int_at(o, "$.maxDiscoveryDepth"), jsonx.text_at(o, "$.sitemap")
    formats = F.try_variant_get(F.try_parse_json(o), "$.scrapeOptions.formats", "array<string>")
    return table(spark, d, "crawl_jobs", "id", "options").select(
        "id", F.when(limit > 0, limit).otherwise(10_000).cast("bigint").alias("limit_pages"), F.when(depth >= 0, depth).otherwise(10).cast("bigint").alias("max_depth"),
        F.when(sitemap.isin("skip", "only"), sitemap).otherwise("include").alias("sitemap"), F.coalesce(F.array_join(formats, ","), F.lit("markdown")).alias("formats"),
    )


@query("""
WITH m AS (SELECT id, CASE WHEN json_valid(metadata) THEN metadata END AS m, CASE WHEN json_valid(json) THEN json END AS j, links FROM crawl_results)
SELECT id, m ->> '$.title' AS title, m ->> '$.sourceURL' AS source_url, try_cast(m ->> '$.statusCode' AS BIGINT) AS status_code, j ->> '$.topic' AS topic,
  try_cast(j ->> '$.score' AS BIGINT) AS score, m IS NOT NULL AS has_metadata, len(list_filter(links, lambda x: x IS NOT NULL)) AS n_links FROM m""")
def results_metadata(spark: SparkSession, d: str) -> DataFrame:
    m, j = F.col("metadata"), F.col("json")
    return table(spark, d, "crawl_results", "id", "metadata", "json", "links").select(
        "id", jsonx.text_at(m, "$.title").alias("title"), jsonx.text_at(m, "$.sourceURL").alias("source_url"), jsonx.int_at(m, "$.statusCode").alias("status_code"),
        jsonx.text_at(j, "$.topic").alias("topic"), jsonx.int_at(j, "$.score").alias("score"), jsonx.valid(m).isNotNull().alias("has_metadata"),
        F.when(F.col("links").isNotNull(), F.size(F.filter("links", lambda x: x.isNotNull()))).cast("bigint").alias("n_links"),
    )


@query("""
WITH n AS (SELECT id, job_id, url FROM crawl_queue WHERE status = 'failed')
SELECT status, error, count(*) AS n, count(metadata) AS with_metadata FROM (SELECT status, error, metadata FROM crawl_results UNION ALL SELECT 'failed', 'lost', CASE WHEN id % 2 = 0 THEN '{"a": 1}' END FROM n) GROUP BY ALL""")
def insert_results(spark: SparkSession, d: str) -> DataFrame:
    """The results with one more for each failed row of the queue; every second brings metadata that is none."""
    lost = table(spark, d, "crawl_queue", "id", "job_id", "url", "status").where("status = 'failed'")
    rows = lost.withColumn("error", F.lit("lost")).withColumn("metadata", F.when(F.col("id") % 2 == 0, '{"a": 1}').otherwise("{a"))
    return jobs.insert_results(table(spark, d, "crawl_results"), rows, NOW).groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"), F.count("metadata").alias("with_metadata"))


@query("""
WITH o AS (SELECT id, CASE WHEN json_valid(options) THEN options END AS o FROM crawl_jobs)
SELECT id, least(greatest(coalesce(try_cast(o ->> '$.limit' AS BIGINT), 100), 1), 1000) AS limit_pages, least(greatest(coalesce(try_cast(o ->> '$.maxDiscoveryDepth' AS BIGINT), 3), 0), 3) AS max_depth,
  coalesce(try_cast(o ->> '$.allowExternalLinks' AS BOOLEAN), false) AS allow_external FROM o""")
def crawl_params(spark: SparkSession, d: str) -> DataFrame:
    """Stored options brought into legal ranges, defaults for what can't be read."""
    o = F.col("options")
    return table(spark, d, "crawl_jobs", "id", "options").select(
        "id", jsonx.clamp(jsonx.int_at(o, "$.limit"), 1, 1000, 100).alias("limit_pages"), jsonx.clamp(jsonx.int_at(o, "$.maxDiscoveryDepth"), 0, 3, 3).alias("max_depth"),
        F.coalesce(jsonx.bool_at(o, "$.allowExternalLinks"), F.lit(False)).alias("allow_external"),
    )


@query("""
SELECT j.id, CASE WHEN j.status = 'failed' THEN 'crawl.failed' ELSE 'crawl.completed' END AS type, j.status, j.total, j.completed, least(coalesce(n, 0), 50)::INT AS n_data
FROM crawl_jobs j LEFT JOIN (SELECT job_id, count(*) AS n FROM crawl_results GROUP BY 1) r ON r.job_id = j.id WHERE j.status IN ('completed', 'failed')""")
def terminal_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What a webhook for completed and failed crawls is sent; the text of the data is left out."""
    return jobs.to_deliver(jobs.terminal_payload(table(spark, d, "crawl_jobs"), table(spark, d, "crawl_results")), ["completed", "failed"]).drop("data")


@query("SELECT user_id, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS status, count(*) AS n FROM events GROUP BY user_id")
def last_status(spark: SparkSession, d: str) -> DataFrame:
    return jobs.last_status(table(spark, d, "events", "user_id", "event_type", "ts", "event_id"), "user_id", "event_type", ["ts", "event_id"])


@query(f"""SELECT 'crawl_' || md5(origin) AS id, origin || '/' AS url, 'scraping' AS status, 0::BIGINT AS total, {NOW}::BIGINT AS created_at, {NOW + 7 * 86_400_000}::BIGINT AS expires_at FROM robots_txt""")
def create_jobs(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "robots_txt", "origin").select(F.concat(F.lit("crawl_"), F.md5("origin")).alias("id"), F.concat("origin", F.lit("/")).alias("url"), F.lit("{}").alias("options"))
    return jobs.create_jobs(seeds, NOW).select("id", "url", "status", "total", "created_at", "expires_at")


@query("""
WITH q AS (SELECT *, (status = 'done')::INT AS ok FROM crawl_queue), b AS (
  SELECT *, sum(ok) OVER (PARTITION BY job_id ORDER BY id) - ok AS earlier FROM q
)
SELECT job_id, count(*) AS reached, sum(ok)::BIGINT AS succeeded FROM b WHERE earlier < 20 GROUP BY job_id""")
def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawl_queue", "id", "job_id", "status").withColumn("ok", F.col("status") == "done")
    reached = crawl.within_budget(rows, F.col("ok"), 20, ["job_id"], "id")
    return reached.groupBy("job_id").agg(F.count(F.lit(1)).alias("reached"), F.count_if("ok").alias("succeeded"))


@query("""
WITH b AS (SELECT job_id, floor((row_number() OVER (PARTITION BY job_id ORDER BY id) - 1) / 5)::BIGINT AS batch, status FROM crawl_queue),
t AS (SELECT job_id, batch, count(*) FILTER (status IN ('done', 'failed')) AS tried, count(*) FILTER (status = 'done') AS ok FROM b GROUP BY 1, 2)
SELECT job_id, batch, CAST(sum(tried) OVER w AS BIGINT) AS attempted, CAST(sum(ok) OVER w AS BIGINT) AS succeeded FROM t WINDOW w AS (PARTITION BY job_id ORDER BY batch)""")
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of each job, a row a batch of five."""
    rows = running_before(table(spark, d, "crawl_queue", "id", "job_id", "status"), ["job_id"], "id", ["id"], {"place": F.lit(1)})
    batches = rows.withColumn("batch", F.floor(F.col("place") / 5)).groupBy("job_id", "batch")
    t = batches.agg(F.count_if(F.col("status").isin("done", "failed")).alias("tried"), F.count_if(F.col("status") == "done").alias("ok"))
    sums = running_before(t, ["job_id"], "batch", ["batch"], {"before_tried": F.col("tried"), "before_ok": F.col("ok")})
    return sums.select("job_id", "batch", (F.col("before_tried") + F.col("tried")).alias("attempted"), (F.col("before_ok") + F.col("ok")).alias("succeeded"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys made from the customers: some revoked, some with an end."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("bigint")
    return table(spark, d, "customer", "c_custkey", "c_name").select(
        F.concat(F.lit("key_"), k).alias("id"), keys.token_hash(F.concat(F.lit("wfc-"), k)).alias("key_hash"), F.concat(F.lit("wfc-"), k).alias("prefix"), F.col("c_name").alias("name"),
        (F.lit(NOW) - k * 1000).alias("created_at"), F.when(k % 3 == 0, NOW - k).otherwise(none).alias("last_used_at"),
        F.when(k % 5 == 0, NOW + (k - 500) * 1000).otherwise(none).alias("expires_at"), F.when(k % 7 == 0, NOW - 5).otherwise(none).alias("revoked_at"),
    )


@query(f"SELECT 'key_' || c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 5 <> 0 OR c_custkey > 500)")
def active_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).where(keys.is_active(NOW)).select("id")


@query(f"""SELECT 'key_' || c_custkey AS id, 'wfc-' || c_custkey AS prefix, c_name AS name, {_ISO.format(f'({NOW} - c_custkey * 1000)')} AS created_at,
  CASE WHEN c_custkey % 3 = 0 THEN {_ISO.format(f'({NOW} - c_custkey)')} END AS last_used_at, CASE WHEN c_custkey % 5 = 0 THEN {_ISO.format(f'({NOW} + (c_custkey - 500) * 1000)')} END AS expires_at,
  CASE WHEN c_custkey % 7 = 0 THEN {_ISO.format(f'({NOW} - 5)')} END AS revoked_at FROM customer""")
def list_keys(spark: SparkSession, d: str) -> DataFrame:
    return keys.listed(_keys(spark, d))


@query("""
WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'other-' WHEN o_orderkey % 997 = 1 THEN 'secret' ELSE 'wfc-' END AS kind FROM orders),
u AS (SELECT CASE WHEN kind = 'secret' THEN 'master secret' ELSE kind || k END AS token, kind, k FROM t)
SELECT token, kind = 'secret' OR (kind = 'wfc-' AND c_custkey IS NOT NULL) AS allowed, CASE WHEN kind = 'wfc-' AND c_custkey IS NOT NULL THEN 'key_' || c_custkey END AS key_id
FROM u LEFT JOIN customer c ON c.c_custkey = u.k AND c_custkey % 7 <> 0 AND (c_custkey % 5 <> 0 OR c_custkey > 500)""")
def authorize_tokens(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    token = F.when(k % 4 == 0, F.concat(F.lit("other-"), k)).when(k % 997 == 1, "master secret").otherwise(F.concat(F.lit("wfc-"), k))
    return keys.authorize(table(spark, d, "orders", "o_orderkey").select(token.alias("token")), _keys(spark, d), NOW, ["master secret"])


@query(f"""SELECT 'key_' || c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN {NOW - 5} WHEN c_custkey % 2 = 0 THEN {NOW} END::BIGINT AS revoked_at,
  greatest(CASE WHEN c_custkey % 3 = 0 THEN {NOW} - c_custkey END, u)::BIGINT AS last_used_at
FROM customer LEFT JOIN (SELECT o_custkey, {NOW} - 100 + max(o_orderkey) AS u FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def key_changes(spark: SparkSession, d: str) -> DataFrame:
    """Keys after every second one is revoked and all orders have used theirs."""
    all_keys = _keys(spark, d)
    ids = table(spark, d, "customer", "c_custkey").where("c_custkey % 2 = 0").select(F.concat(F.lit("key_"), "c_custkey").alias("id"))
    uses = table(spark, d, "orders", "o_orderkey", "o_custkey").select(F.concat(F.lit("key_"), "o_custkey").alias("id"), (F.col("o_orderkey") + NOW - 100).alias("used_at"))
    return keys.touched(keys.revoke(all_keys, ids, NOW), uses).select("id", "revoked_at", "last_used_at")


@query(f"""
WITH t AS (SELECT n_nationkey AS k, u.unit FROM nation, (VALUES ('second', 1), ('minute', 60), ('hour', 3600), ('day', 86400), ('week', 604800), ('month', 0), ('year', 0)) u(unit, s)),
v AS (SELECT k, unit, CASE unit WHEN 'second' THEN 1000 WHEN 'minute' THEN 60000 WHEN 'hour' THEN 3600000 WHEN 'day' THEN 86400000 WHEN 'week' THEN 604800000 END::BIGINT AS step FROM t),
w AS (SELECT *, (floor(({NOW} - k * step) / step + 0.5) * step)::BIGINT AS ms FROM v)
SELECT k::VARCHAR || ' ' || unit || 's ago' AS raw, CASE
  WHEN unit = 'month' THEN strftime(date_trunc('day', make_timestamp({NOW}::BIGINT * 1000)) - to_months(k), '%Y-%m-%dT%H:%M:%S.000Z')
  WHEN unit = 'year' THEN strftime(date_trunc('day', make_timestamp({NOW}::BIGINT * 1000)) - to_years(k), '%Y-%m-%dT%H:%M:%S.000Z')
  ELSE {_ISO.format('ms')} END AS time FROM w""")
def relative_time(spark: SparkSession, d: str) -> DataFrame:
    units = F.explode(F.array(*[F.lit(u) for u in ("second", "minute", "hour", "day", "week", "month", "year")]))
    raw = table(spark, d, "nation", "n_nationkey").select("n_nationkey", units.alias("u")).select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.concat("u", F.lit("s ago"))).alias("raw"))
    return raw.select("raw", dates.relative_time(F.col("raw"), NOW).alias("time"))
