"""Queries over pages and addresses: URL algebra, links, robots, sitemaps, maps, crawls, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.functions import html as H
from webspark.functions import text, urls
from webspark.io import table
from webspark.operators import crawl, links, mapsite, robots, scrape, sitemap
from webspark.plans.catalog import query
from webspark.plans.sqlparts import HOST, HTTP, KEY, ORIGIN, PATH, PORT, SEARCH, percent_encoded, url_struct
from webspark.sources import tables

AGENT = "pagebot/2.0 (+https://bot.example)"


@query(f"""WITH p AS (SELECT id, {url_struct('url')} AS u FROM crawl_results)
SELECT id, lower(u.s) AS scheme, CASE WHEN u.s = '' THEN '' ELSE {HOST} END AS host, CASE WHEN {HTTP} THEN {PORT} ELSE '' END AS port, {HTTP} AS is_http,
  CASE WHEN {HTTP} THEN {PATH} END AS path, CASE WHEN {HTTP} THEN {SEARCH} END AS query FROM p""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    ok = urls.is_http(u)
    return table(spark, d, "crawl_results", "id", "url").select(
        "id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), F.when(ok, urls.port(u)).otherwise("").alias("port"), ok.alias("is_http"), F.when(ok, urls.path(u)).alias("path"), F.when(ok, urls.query(u)).alias("query")
    )


@query(f"WITH p AS (SELECT id, {url_struct('url')} AS u FROM crawl_queue) SELECT id, {KEY} AS key FROM p")
def url_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_queue", "id", "url").select("id", urls.url_key(F.col("url")).alias("key"))


@query(f"""WITH p AS (SELECT id, job_id, {url_struct('url')} AS u FROM crawl_queue), k AS (SELECT id, job_id, {KEY} AS key FROM p)
SELECT job_id, min(id) AS id, key FROM k WHERE key IS NOT NULL GROUP BY job_id, key UNION ALL SELECT job_id, id, NULL FROM k WHERE key IS NULL""")
def dedupe_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawl_queue", "id", "job_id", "url").select("job_id", "id", urls.url_key(F.col("url")).alias("key"))
    return links.keep_first(rows, ["job_id", "key"], ["id"], nulls=True)


@query("""SELECT job_id, min(id) AS id FROM (SELECT job_id, id, CASE WHEN instr(split_part(url, '#', 1), '?') > 0
  THEN split_part(url, '?', 1) || CASE WHEN instr(url, '#') > 0 THEN substr(url, instr(url, '#')) ELSE '' END ELSE url END AS k FROM crawl_queue) GROUP BY job_id, k""")
def dedupe_ignore_query(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawl_queue", "id", "job_id", "url").select("job_id", "id", urls.dedupe_key(F.col("url")).alias("k"))
    return links.keep_first(rows, ["job_id", "k"], ["id"]).select("job_id", "id")


@query(f"""WITH l AS (SELECT id, url, unnest(links) AS link FROM crawl_results), p AS (SELECT id, {url_struct('url')} AS b, {url_struct('link')} AS u FROM l WHERE link IS NOT NULL)
SELECT id, CASE WHEN NOT {HTTP} THEN 'none' WHEN lower(b.h) = {HOST} THEN 'same' WHEN suffix({HOST}, '.' || lower(b.h)) THEN 'below' ELSE 'other' END AS scope, count(*) AS n FROM p GROUP BY ALL""")
def host_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = links.exploded_links(table(spark, d, "crawl_results", "id", "url", "links"))
    return rows.groupBy("id", links.link_scope(F.col("url"), F.col("link")).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT id, unnest(links) AS x, generate_subscripts(links, 1) AS ord FROM crawl_results),
m AS (SELECT id, ord, x || CASE ord % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '/a.b/c' WHEN 2 THEN '.js?v=1.2' ELSE '' END AS link FROM l WHERE x LIKE 'http%' AND x NOT LIKE '%#%')
SELECT id, ord, link FROM m WHERE list_contains(['png', 'jpg', 'jpeg', 'gif', 'svg', 'webp', 'ico', 'css', 'js', 'woff', 'woff2', 'ttf', 'eot', 'mp4', 'mp3', 'zip', 'gz', 'rar', '7z', 'exe', 'dmg'],
  lower(string_split(regexp_extract(link, '^https?://[^/]*([^?#]*)', 1), '.')[-1]))""")
def asset_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to files, after every second link was given the look of one."""
    tail = F.element_at(F.array(F.lit(".PNG"), F.lit("/a.b/c"), F.lit(".js?v=1.2"), F.lit("")), (F.col("ord") % 4 + 1).cast("int"))
    rows = links.exploded_links(table(spark, d, "crawl_results", "id", "links", "url")).where("link like 'http%' and link not like '%#%'")
    return rows.select("id", "ord", F.concat("link", tail).alias("link")).where(urls.has_asset_extension(urls.path(F.col("link"))))


_LINKS = f"""l AS (SELECT id AS page, url AS base, unnest(links) AS link, generate_subscripts(links, 1) AS ord FROM crawl_results WHERE status = 'completed'),
f AS (SELECT page, ord, {url_struct('base')} AS b, {url_struct('trim(link)')} AS u FROM l WHERE link IS NOT NULL AND trim(link) <> '' AND trim(link) NOT LIKE '#%'),
k AS (SELECT page, ord, {HOST} AS host, {HOST.replace('u.', 'b.')} AS base_host, {ORIGIN} || {percent_encoded(PATH)} || u.q AS url, {PATH} AS path FROM f WHERE {HTTP} AND {HTTP.replace('u.', 'b.')})"""


@query(f"""WITH {_LINKS} SELECT page, min(ord) AS ord, url, 1 AS depth FROM k
WHERE host = base_host AND contains(path, '-') AND NOT prefix(path, '/members/') GROUP BY page, url""")
def filter_links(spark: SparkSession, d: str) -> DataFrame:
    rules = links.LinkRules(max_depth=3, include=["*-*"], exclude=["/members/*"])
    return links.filter_links(tables.pages(spark, d), rules)


@query(f"""WITH {_LINKS} SELECT page, min(ord) AS ord, url, 1 AS depth FROM k GROUP BY page, url HAVING NOT EXISTS (FROM crawl_queue q WHERE q.url = k.url)""")
def filter_links_external(spark: SparkSession, d: str) -> DataFrame:
    """With links to other hosts, and without those that any queue holds as they are."""
    return links.filter_links(tables.pages(spark, d), links.LinkRules(allow_external=True), table(spark, d, "crawl_queue", "url"))


@query(f"""WITH p AS (SELECT id, {url_struct('url')} AS u FROM crawl_queue) SELECT id FROM p WHERE {HTTP}
AND regexp_matches({PATH}, '^/.*/.*-') AND NOT suffix({PATH}, '.html') AND NOT prefix({PATH}, '/help/')""")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    rows = table(spark, d, "crawl_queue", "id", "url").where(urls.is_http(u))
    return rows.where(urls.passes_globs(urls.path(u), ["/*/*-*"], ["*.html", "/help/*"])).select("id")


@query()
def resolved_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the queue after the public standard; null for those it doesn't take."""
    u = F.col("url")
    return table(spark, d, "crawl_queue", "id", "url").select("id", urls.resolve(u, u).alias("href"))


_HREFS = """SELECT id, url, unnest(h) AS href, generate_subscripts(h, 1) AS ord FROM (
  SELECT id, url, list_filter(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1), lambda x: replace(x, '&amp;', '&')), lambda x: x <> '') AS h FROM crawl_results WHERE html IS NOT NULL)"""


@query(f"""WITH h AS ({_HREFS}), p AS (SELECT id, ord, href, {url_struct('url')} AS u FROM h),
v AS (SELECT id, ord, href, {ORIGIN} AS o, regexp_replace({HOST}, '[\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g') AS host, {HTTP} AS ok FROM p)
SELECT id, ord, href, CASE WHEN href LIKE 'http%' THEN {percent_encoded('href')} WHEN ok AND regexp_matches(host, '^[a-z0-9.-]+$') THEN regexp_extract(o, '^[a-z]+://') || host || {percent_encoded('href')} END AS url FROM v""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return scrape.page_links(table(spark, d, "crawl_results", "id", "url", "html"))


@query("""SELECT id, CASE WHEN t = '' THEN 'No title available' ELSE t END AS title, CASE WHEN regexp_matches(html, '(?i)<meta\\s[^>]*name="description"') THEN
  replace(regexp_extract(html, '(?i)<meta\\s[^>]*name="description"[^>]*content="([^"]*)"', 1), '&amp;', '&') ELSE 'No description available' END AS description, coalesce(status_code, 0) AS status_code
FROM (SELECT id, html, status_code, trim(regexp_replace(replace(split_part(split_part(html, '<title>', 2), '</title>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM crawl_results WHERE html IS NOT NULL)""")
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawl_results", "id", "url", "html", "status_code").where("html is not null")
    m = pages.select("id", scrape.metadata(pages).alias("m"))
    return m.select("id", "m.title", "m.description", F.col("m.statusCode").alias("status_code"))


@query("""SELECT id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'),
  '\\s+', ' ', 'g')) AS words FROM crawl_results WHERE html IS NOT NULL""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_results", "id", "html").where("html is not null").select("id", text.clean_text(F.col("html")).alias("words"))


@query()
def main_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_results", "id", "html").where("html is not null").select("id", H.main_content(F.col("html")).alias("main"))


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_results", "id", "html").where("html is not null").select("id", H.to_markdown(F.col("html")).alias("markdown"))


@query("""WITH w AS (SELECT DISTINCT url FROM crawl_queue), p AS (SELECT url, arg_min(html, id) AS html FROM (SELECT url, id, coalesce(html, '') AS html FROM crawl_results) GROUP BY url)
SELECT w.url, p.url IS NOT NULL AS found, p.html AS "rawHtml", CASE WHEN p.url IS NOT NULL THEN len(list_filter(regexp_extract_all(p.html, '(?i)<a\\s[^>]*href="([^"]*)"', 1), lambda x: x <> '')) END AS n_links FROM w LEFT JOIN p ON p.url = w.url""")
def scrape_formats(spark: SparkSession, d: str) -> DataFrame:
    """The queue's addresses as stored pages, in two formats; of pages fetched twice the first."""
    stored = table(spark, d, "crawl_results", "id", "url", "html", "status_code").withColumn("html", F.coalesce("html", F.lit("")))
    got = scrape.scrape(table(spark, d, "crawl_queue", "url"), links.keep_first(stored, ["url"], ["id"]), ("rawHtml", "links"))
    return got.select("url", "found", "rawHtml", F.when(F.col("found"), F.size("links")).cast("bigint").alias("n_links"))


_DIRECTIVES = """d AS (
  SELECT origin, pos, lower(trim(split_part(line, ':', 1))) AS name, trim(substr(line, instr(line, ':') + 1)) AS value
  FROM (SELECT origin, unnest(l) AS raw, generate_subscripts(l, 1) AS pos, trim(split_part(raw, '#', 1)) AS line FROM (SELECT origin, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) AS l
    FROM robots_txt WHERE status BETWEEN 200 AND 299 AND body IS NOT NULL)) WHERE instr(line, ':') > 0
), n AS (SELECT *, coalesce(lag(name) OVER (PARTITION BY origin ORDER BY pos), '') AS prior FROM d),
g AS (SELECT *, sum((name = 'user-agent' AND prior <> 'user-agent')::INT) OVER (PARTITION BY origin ORDER BY pos) AS grp FROM n),
s AS (SELECT origin, grp::BIGINT AS grp, coalesce(list(lower(value) ORDER BY pos) FILTER (name = 'user-agent' AND value <> ''), []) AS agents,
  coalesce(list(value ORDER BY pos) FILTER (name = 'allow' AND value <> ''), []) AS allow, coalesce(list(value ORDER BY pos) FILTER (name = 'disallow' AND value <> ''), []) AS disallow,
  arg_max(try_cast(regexp_extract(value, '^[0-9]+[.]?[0-9]*') AS DOUBLE), pos) FILTER (name = 'crawl-delay' AND regexp_matches(value, '^[0-9]')) AS crawl_delay FROM g WHERE grp > 0 GROUP BY ALL)"""


@query(f"WITH {_DIRECTIVES} SELECT origin, grp, array_to_string(agents, ' ') AS agents, array_to_string(allow, ' ') AS allow, array_to_string(disallow, ' ') AS disallow, crawl_delay FROM s")
def robots_groups(spark: SparkSession, d: str) -> DataFrame:
    joined = [F.array_join(c, " ").alias(c) for c in ("agents", "allow", "disallow")]
    return robots.groups(tables.robots_files(spark, d)).select("origin", "grp", *joined, "crawl_delay")


_RULES = f"""{_DIRECTIVES}, c AS (SELECT origin, arg_min({{'a': allow, 'd': disallow, 'w': crawl_delay}}, grp + CASE WHEN list_has_any(agents, ['pagebot', 'pagebot/2.0 (+https://bot.example)']) THEN 0 ELSE 1000000 END) AS r
  FROM s WHERE list_has_any(agents, ['*', 'pagebot', 'pagebot/2.0 (+https://bot.example)']) GROUP BY origin),
rules AS (SELECT origin, coalesce(r.a, []) AS allow, coalesce(r.d, []) AS disallow, r.w AS crawl_delay FROM (SELECT origin FROM robots_txt WHERE status BETWEEN 200 AND 299 AND body IS NOT NULL) LEFT JOIN c USING (origin))"""


@query(f"WITH {_RULES} SELECT origin, array_to_string(allow, ' ') AS allow, array_to_string(disallow, ' ') AS disallow, crawl_delay FROM rules")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = robots.rules_for(tables.robots_files(spark, d), AGENT)
    return rules.select("origin", F.array_join("allow", " ").alias("allow"), F.array_join("disallow", " ").alias("disallow"), "crawl_delay")


_GATED = f"""{_RULES}, q AS (SELECT id, job_id, url, {url_struct('url')} AS u FROM crawl_queue),
o AS (SELECT id, job_id, url, CASE WHEN {HTTP} THEN {ORIGIN} END AS origin, CASE WHEN {HTTP} THEN {PATH} || {SEARCH} ELSE url END AS raw FROM q),
t AS (SELECT o.*, CASE WHEN prefix(raw, '/') THEN raw ELSE '/' || raw END AS path, crawl_delay, coalesce(allow, []) AS allow, coalesce(disallow, []) AS disallow FROM o LEFT JOIN rules ON rules.origin = o.origin),
m AS (SELECT id, job_id, url, crawl_delay, coalesce(list_max(list_transform(list_filter(allow, lambda p: regexp_matches(path, '^' || regexp_replace(regexp_replace(p, '[.+^?()|{{}}\\[\\]\\\\]', '\\\\\\0', 'g'), '[*]', '.*', 'g'))), lambda p: len(p))), -1) AS yes,
  coalesce(list_max(list_transform(list_filter(disallow, lambda p: regexp_matches(path, '^' || regexp_replace(regexp_replace(p, '[.+^?()|{{}}\\[\\]\\\\]', '\\\\\\0', 'g'), '[*]', '.*', 'g'))), lambda p: len(p))), -1) AS no FROM t),
gated AS (SELECT id, job_id, url, crawl_delay, yes >= no AS allowed FROM m)"""


@query(f"WITH {_GATED} SELECT id, allowed FROM gated")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    return crawl.gate(table(spark, d, "crawl_queue", "id", "job_id", "url"), robots.rules_for(tables.robots_files(spark, d), AGENT)).select("id", "allowed")


@query(f"WITH {_GATED} SELECT job_id, id, url, 'failed' AS status, 'robots.txt disallowed' AS error FROM gated WHERE NOT allowed")
def robots_gate(spark: SparkSession, d: str) -> DataFrame:
    return crawl.blocked_results(crawl.gate(table(spark, d, "crawl_queue", "id", "job_id", "url"), robots.rules_for(tables.robots_files(spark, d), AGENT)))


@query(f"WITH {_GATED} SELECT job_id, max(crawl_delay) AS crawl_delay, greatest(1.0, least(10.0, coalesce(max(crawl_delay), 1.0)))::DOUBLE AS wait FROM gated GROUP BY job_id")
def crawl_pace(spark: SparkSession, d: str) -> DataFrame:
    return crawl.pace(crawl.gate(table(spark, d, "crawl_queue", "id", "job_id", "url"), robots.rules_for(tables.robots_files(spark, d), AGENT)))


@query("""
WITH n AS (SELECT origin, unnest(regexp_extract_all(body, '(?im)^[ \\t]*sitemap[ \\t]*:[ \\t]*(\\S+)', 1)) AS url FROM robots_txt WHERE status BETWEEN 200 AND 299)
SELECT origin, url FROM n UNION ALL SELECT origin, origin || '/sitemap.xml' FROM robots_txt WHERE origin NOT IN (SELECT origin FROM n)""")
def sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    return sitemap.entries(table(spark, d, "robots_txt")).select("origin", "url")


_LISTED = "regexp_matches(url, '^https?://[a-z0-9.-]+/[a-zA-Z0-9/._?&=-]*$')"


@query(f"""WITH p AS (SELECT id, url, {url_struct('url')} AS u FROM crawl_queue WHERE {_LISTED}), f AS (SELECT {ORIGIN} AS origin, {ORIGIN} || {PATH} || u.q AS loc, min(id) AS id FROM p GROUP BY 1, 2)
SELECT origin, row_number() OVER (PARTITION BY origin ORDER BY id) AS rank, loc FROM f WHERE origin IN (SELECT origin FROM robots_txt)""")
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """The addresses in the sitemaps of all origins, found from their robots files through an index."""
    return sitemap.walk(sitemap.entries(table(spark, d, "robots_txt")), tables.sitemap_files(spark, d))


def _map_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, d, "crawl_results", "id", "job_id", "url", "links").select(F.struct("job_id", "id").alias("page"), "url", "links")
    found = links.discover_links(pages, include_subdomains=True).select(F.col("page.job_id").alias("site"), F.struct(F.col("page.id").alias("a"), F.col("ord").alias("b")).alias("ord"), "url")
    listed = table(spark, d, "crawl_queue", "id", "job_id", "url").where(F.col("url").rlike(r"^https?://[a-z0-9.\-]+/[a-zA-Z0-9/._?&=\-]*\z"))
    return found, listed.select(F.col("job_id").alias("site"), F.struct(F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("ord"), "url")


_SIDES = f"""l AS (SELECT job_id AS site, id AS a, url AS base, unnest(links) AS link, generate_subscripts(links, 1) AS b FROM crawl_results),
p AS (SELECT site, a, b, {url_struct('base')} AS w, {url_struct('link')} AS u FROM l WHERE link IS NOT NULL),
found AS (SELECT site, a, b, CASE WHEN {PATH} <> '/' THEN rtrim({ORIGIN} || {PATH} || u.q, '/') ELSE {ORIGIN} || {PATH} || u.q END AS url FROM p
  WHERE {HTTP} AND ({HOST} = lower(w.h) OR suffix({HOST}, '.' || lower(w.h))) AND w.h <> ''),
listed AS (SELECT job_id AS site, id AS a, 0::BIGINT AS b, url FROM crawl_queue WHERE {_LISTED}),
sides AS (SELECT *, 0 AS side FROM found UNION ALL SELECT *, 1 FROM listed)"""


@query(f"""WITH {_SIDES} SELECT site, rank, url FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) AS rank FROM (SELECT DISTINCT site, url FROM sides)) WHERE rank <= 100""")
def map_v1(spark: SparkSession, d: str) -> DataFrame:
    found, listed = _map_sides(spark, d)
    return mapsite.map_sorted(found, listed, limit=100)


_MAPPED = f"""{_SIDES}, o AS (SELECT site, split_part(url, '?', 1) AS k, arg_min({{'url': url, 'spot': row(side, a, b)}}, row(side, a, b, url)) AS f FROM sides GROUP BY 1, 2),
m AS (SELECT site, f.url AS url, f.spot AS spot FROM o)"""


@query(f"WITH {_MAPPED} SELECT site, rank, url FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY spot, url) AS rank FROM m) WHERE rank <= 100")
def map_v2(spark: SparkSession, d: str) -> DataFrame:
    found, listed = _map_sides(spark, d)
    return mapsite.map_site(found, listed, limit=100)


@query(f"WITH {_MAPPED} SELECT site, row_number() OVER (PARTITION BY site ORDER BY spot, url) AS rank, url FROM m WHERE url ILIKE '%ME%'")
def map_search(spark: SparkSession, d: str) -> DataFrame:
    found, listed = _map_sides(spark, d)
    return mapsite.map_site(found, listed, search="Me")


@query(f"""WITH {_SIDES} SELECT id AS site, concat_ws('; ', CASE WHEN NOT EXISTS (FROM sides WHERE sides.site = j.id AND contains(lower(url), 'zzz')) THEN 'browser discovery returned no links' END,
  'search relevance ordering is not supported; results are filtered by substring') AS warning FROM crawl_jobs j""")
def map_warnings(spark: SparkSession, d: str) -> DataFrame:
    found, listed = _map_sides(spark, d)
    return mapsite.map_warnings(mapsite.map_sorted(found, listed, "zzz"), table(spark, d, "crawl_jobs").select(F.col("id").alias("site")), searched=True)


_GRAPH = """n AS (SELECT count(*) AS n FROM supplier), e AS (
  SELECT s_suppkey AS i, unnest(CASE WHEN s_suppkey % 4 = 0 THEN [s_suppkey * 7 + 3, s_suppkey * 5 + 1, s_suppkey + 1] ELSE [s_suppkey * 7 + 3, s_suppkey * 5 + 1] END) % n AS t FROM supplier, n)"""


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one site that link to each other: number i to 7i+3 and 5i+1, every fourth to the next;
    every eleventh page is missing."""
    rows = table(spark, d, "supplier", "s_suppkey")
    i, n = F.col("s_suppkey"), F.col("n")
    to = F.when(i % 4 == 0, F.array((i * 7 + 3) % n, (i * 5 + 1) % n, (i + 1) % n)).otherwise(F.array((i * 7 + 3) % n, (i * 5 + 1) % n))
    place = lambda x: F.concat(F.lit("https://graph.example/p"), x.cast("string"))
    counted = rows.join(rows.agg(F.count(F.lit(1)).alias("n")), F.lit(True))
    return counted.where(i % 11 != 5).select(place(i).alias("url"), F.transform(to, place).alias("links"))


@query(f"""WITH RECURSIVE {_GRAPH}, r AS (SELECT 0::BIGINT AS i, 0 AS depth UNION SELECT e.t, r.depth + 1 FROM r JOIN e ON e.i = r.i WHERE r.depth < 4 AND r.i % 11 <> 5)
SELECT 'https://graph.example/p' || i AS url, min(depth)::INT AS depth, CASE WHEN i % 11 = 5 THEN 'failed' ELSE 'done' END AS status FROM r GROUP BY i""")
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of linked pages, breadth first, to a depth of four."""
    start = spark.createDataFrame([("j", "https://graph.example/p0", 0)], "job string, url string, rank bigint")
    return crawl.crawl(start, _graph(spark, d), crawl.CrawlRules(links.LinkRules(max_depth=4))).select("url", "depth", "status")


@query()
def crawl_limited(spark: SparkSession, d: str) -> DataFrame:
    """The same crawl until twelve pages are done."""
    start = spark.createDataFrame([("j", "https://graph.example/p0", 0)], "job string, url string, rank bigint")
    return crawl.crawl(start, _graph(spark, d), crawl.CrawlRules(links.LinkRules(max_depth=10), limit=12)).select("url", "depth", "status")


@query(f"""WITH {_RULES}, j AS (SELECT id AS job, {url_struct('url')} AS u FROM crawl_jobs),
k AS (SELECT job, {ORIGIN} || {PATH} || u.q AS url, {ORIGIN} AS origin, {HOST} AS host FROM j WHERE {HTTP}),
x AS (SELECT k.job, q.id, q.url, {url_struct('q.url')} AS u, k.origin AS home, k.host AS home_host FROM k JOIN crawl_queue q ON q.job_id = k.job WHERE {_LISTED.replace('url', 'q.url')}),
i AS (SELECT job, id, url, {PATH} || {SEARCH} AS path, home, {HOST} = home_host AND NOT regexp_matches({PATH}, '(?i)[.](png|jpg|js|css)$') AS inside FROM x),
t AS (SELECT i.*, coalesce(allow, []) AS allow, coalesce(disallow, []) AS disallow FROM i LEFT JOIN rules ON rules.origin = home WHERE inside),
ok AS (SELECT job, url FROM t WHERE coalesce(list_max(list_transform(list_filter(allow, lambda p: regexp_matches(path, '^' || regexp_replace(regexp_replace(p, '[.+^?()|{{}}\\[\\]\\\\]', '\\\\\\0', 'g'), '[*]', '.*', 'g'))), lambda p: len(p))), -1)
  >= coalesce(list_max(list_transform(list_filter(disallow, lambda p: regexp_matches(path, '^' || regexp_replace(regexp_replace(p, '[.+^?()|{{}}\\[\\]\\\\]', '\\\\\\0', 'g'), '[*]', '.*', 'g'))), lambda p: len(p))), -1))
SELECT DISTINCT job, url FROM (SELECT job, url FROM k UNION ALL SELECT job, url FROM ok)""")
def crawl_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The first level of every job: its address, and what its queue lists as a sitemap would."""
    starts = table(spark, d, "crawl_jobs", "id", "url").where(urls.is_http(F.col("url"))).select(F.col("id").alias("job"), "url")
    _, listed = _map_sides(spark, d)
    sitemap_links = listed.select(F.col("site").alias("job"), F.col("ord.a").alias("ord"), "url")
    return crawl.seeds(starts, sitemap_links, crawl.CrawlRules(user_agent=AGENT), robots.rules_for(tables.robots_files(spark, d), AGENT)).select("job", "url")
