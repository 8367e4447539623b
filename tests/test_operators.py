import pytest
from pyspark.sql import functions as F

from webspark.operators import crawl, extract, jobs, keys, links, mapsite, robots, search, sitemap
from webspark.plans import options
from webspark.sources import tables
from webspark.streaming import queue


def test_links_of_a_page(spark):
    found = ["/a", "/a#x", " /b ", "#top", "", "mailto:x@y", "https://other.example/z", "https://sub.h.example/s", "/i.PNG", "/a.b/c", None, "ftp://h.example/q", "/members/1"]
    pages = spark.createDataFrame([(1, "https://h.example/dir/p", found, 0), (2, "nonsense", ["/a"], 0), (3, "https://h.example/", None, 0), (4, "https://h.example/", ["/deep"], 9)], "page int, url string, links array<string>, depth int")
    got = lambda rules, **kw: sorted((r.page, r.url) for r in links.filter_links(pages, rules, **kw).collect())
    assert got(links.LinkRules(max_depth=5, exclude=["/members/*"])) == [(1, "https://h.example/a"), (1, "https://h.example/a.b/c"), (1, "https://h.example/b")]
    assert (1, "https://sub.h.example/s") in got(links.LinkRules(allow_subdomains=True))
    assert (1, "https://other.example/z") in got(links.LinkRules(allow_external=True))
    assert (4, "https://h.example/deep") in got(links.LinkRules())
    seen = spark.createDataFrame([("https://h.example/a",)], "url string")
    assert (1, "https://h.example/a") not in got(links.LinkRules(), seen=seen)


ROBOTS = """Disallow: /early
User-agent: pagebot
User-agent: otherbot
Disallow: /private
Allow: /private/ok$
Crawl-delay: 2
Crawl-delay: x

User-Agent : *
Disallow: / # all
allow: /*.html
"""


@pytest.mark.parametrize(
    "agent, path, ok",
    [
        ("pagebot/1.0 (x)", "/private/a", False), ("pagebot/1.0 (x)", "/private/ok", True), ("pagebot/1.0 (x)", "/private/ok/", False), ("pagebot/1.0 (x)", "/early", True),
        ("nobody", "/x", False), ("nobody", "/y.html?z", True), ("", "/y.html", True), ("OTHERBOT", "/private", False),
    ],
)
def test_robots(spark, agent, path, ok):
    files = spark.createDataFrame([("https://h.example", ROBOTS)], "origin string, body string")
    rules = robots.rules_for(files, agent)
    row = spark.createDataFrame([(f"https://h.example{path}",)], "url string")
    assert robots.with_permission(row, rules).first().allowed is ok


def test_robots_without_rules(spark):
    files = spark.createDataFrame([("https://a.example", "User-agent: x\nDisallow: /"), ("https://b.example", "")], "origin string, body string")
    got = {r.origin: (r.allow, r.disallow, r.crawl_delay) for r in robots.rules_for(files, "y").collect()}
    assert got == {"https://a.example": ([], [], None), "https://b.example": ([], [], None)}


def test_sitemap_index_with_cycle(spark):
    index = "<sitemapindex><sitemap><loc>/b.xml</loc></sitemap><sitemap><loc>https://h.example/sitemap.xml</loc></sitemap><sitemap><loc> <![CDATA[/c.xml]]> </loc></sitemap></sitemapindex>"
    files = spark.createDataFrame(
        [("https://h.example/sitemap.xml", index), ("https://h.example/b.xml", "<urlset><URL><loc>/p?a=1&amp;b=2</loc></URL><url></url><url><loc>mailto:x</loc></url></urlset>"), ("https://h.example/c.xml", "<urlset><url><loc>/q</loc></url><url><loc>/p?a=1&amp;b=2</loc></url></urlset>")],
        "url string, xml string",
    )
    robots_files = spark.createDataFrame([("https://h.example", 404, None), ("https://n.example", 200, "SITEMAP:/s1.xml # x\nsitemap : https://o.example/s2.xml")], "origin string, status int, body string")
    starts = sitemap.entries(robots_files)
    assert sorted((r.origin, r.ord, r.url) for r in starts.collect()) == [("https://h.example", 1, "https://h.example/sitemap.xml"), ("https://n.example", 1, "https://n.example/s1.xml"), ("https://n.example", 2, "https://o.example/s2.xml")]
    got = sorted((r.rank, r.loc) for r in sitemap.walk(starts, files).collect())
    assert got == [(1, "https://h.example/p?a=1&b=2"), (2, "https://h.example/q")]
    assert sitemap.walk(starts, files, max_depth=0).count() == 0


def test_maps(spark):
    page = spark.createDataFrame([("s", 1, "https://h/a?x=1"), ("s", 2, "https://h/b")], "site string, ord int, url string")
    listed = spark.createDataFrame([("s", 1, "https://h/a"), ("s", 2, "https://h/c#f"), ("s", 3, "https://h/c?y#f")], "site string, ord int, url string")
    urls = lambda df: [r.url for r in df.orderBy("rank").collect()]
    assert urls(mapsite.map_site(page, listed)) == ["https://h/a?x=1", "https://h/b", "https://h/c#f"]
    assert urls(mapsite.map_site(page, listed, sitemap="only", ignore_query=False, search="C", limit=1)) == ["https://h/c#f"]
    assert urls(mapsite.map_sorted(page, listed, limit=2)) == ["https://h/a", "https://h/a?x=1"]


def graph(spark, n=9, missing=(4,)):
    place = lambda i: f"https://g.example/p{i}"
    rows = [(place(i), [place((2 * i + 1) % n), place((2 * i + 2) % n), place(i)]) for i in range(n) if i not in missing]
    return spark.createDataFrame(rows, "url string, links array<string>")


def test_crawl_by_levels(spark):
    start = spark.createDataFrame([("j", "https://g.example/p0", 0)], "job string, url string, rank bigint")
    got = {r.url[-2:]: (r.depth, r.status) for r in crawl.crawl(start, graph(spark), crawl.CrawlRules(links.LinkRules(max_depth=2))).collect()}
    assert got == {"p0": (0, "done"), "p1": (1, "done"), "p2": (1, "done"), "p3": (2, "done"), "p4": (2, "failed"), "p5": (2, "done"), "p6": (2, "done")}


def test_crawl_budget_and_robots(spark):
    start = spark.createDataFrame([("j", "https://g.example/p0", 0)], "job string, url string, rank bigint")
    files = spark.createDataFrame([("https://g.example", "User-agent: *\nDisallow: /p1")], "origin string, body string")
    got = {r.url[-2:]: r.status for r in crawl.crawl(start, graph(spark), crawl.CrawlRules(limit=3), robots.rules_for(files)).collect()}
    assert got == {"p0": "done", "p1": "blocked", "p2": "done", "p5": "done", "p6": "pending"}


def test_claim_and_release(spark):
    rows = [(i, "a" if i % 2 else "b", f"u{i}", 0, "pending" if i > 2 else "done") for i in range(10)]
    q = spark.createDataFrame(rows, "id bigint, job_id string, url string, depth int, status string")
    claimed = jobs.claim(q, 2)
    assert sorted(r.id for r in claimed.collect()) == [3, 4, 5, 6]
    after = jobs.with_status(q, claimed, "processing")
    assert sorted(r.id for r in after.where("status = 'processing'").collect()) == [3, 4, 5, 6]
    assert sorted(r.id for r in jobs.claim(after, 2).collect()) == [7, 8, 9]
    assert jobs.with_status(after, after, "pending", only="processing").where("status = 'pending'").count() == 7


def test_enqueue_takes_each_address_once(spark):
    c = spark.createDataFrame([("a", 2, "x", 1), ("a", 1, "x", 5), ("a", 3, "y", 1), (None, 1, "x", 1), ("b", 1, "y", 1)], "job_id string, ord int, url string, depth int")
    q = spark.createDataFrame([("a", "y")], "job_id string, url string")
    assert sorted(map(tuple, jobs.enqueue(c, q).collect())) == [("a", "x", 5), ("b", "y", 1)]


def test_empty_store(spark):
    q, r = tables.empty(spark, "crawl_queue"), tables.empty(spark, "crawl_results")
    assert jobs.counters(q, r).count() == 0 and jobs.results_page(r).count() == 0
    payload = jobs.terminal_payload(spark.createDataFrame([("j", "u", "failed", None, None, 0, 0, 1, 1, 1, 1)], tables.SCHEMAS["crawl_jobs"]), r).first()
    assert (payload.type, payload.n_data, payload.data) == ("crawl.failed", 0, "[]")


def test_payload_leaves_nulls_out(spark):
    r = spark.createDataFrame([(1, "j", "u", "completed", 200, "m", None, None, ["a", None], '{"t": 1}', "{bad", None, 1)], tables.SCHEMAS["crawl_results"])
    job = spark.createDataFrame([("j", "u", "completed", None, None, 1, 1, 1, 1, 1, 1)], tables.SCHEMAS["crawl_jobs"])
    assert jobs.terminal_payload(job, r).first().data == '[{"url":"u","status":"completed","markdown":"m","links":["a"],"metadata":{"t":1}}]'


def test_caps():
    assert [jobs.cap(x) for x in (None, 0, 5.7, 10**6, float("nan"), float("inf"))] == [100, 100, 5, 1000, 100, 100]


def test_search_chain():
    assert search.parse_chain(" ") == (["ddg", "ddg-media", "browser"], [])
    assert search.parse_chain("x,DDG,ddg,searxng") == (["ddg"], ['unknown search provider "x" skipped', "searxng skipped: SEARXNG_ENDPOINT not configured"])


def test_paging_stops_at_a_dry_page(spark):
    rows = [("q", 1, i, f"https://h/{i}") for i in range(3)] + [("q", 2, i, f"https://h/{i}") for i in range(3)] + [("q", 3, 0, "https://h/9")]
    df = spark.createDataFrame(rows, "query string, page int, pos int, url string")
    assert [r.url for r in search.until_dry(df, 10).orderBy("position").collect()] == ["https://h/0", "https://h/1", "https://h/2"]
    assert search.until_dry(df, 2).count() == 2


def test_tokens(spark):
    now = 1000
    token, key_id, prefix = keys.new_key()
    k = spark.createDataFrame([(key_id, prefix, None, 1, None, None, None), ("old", "wfc-o", None, 1, None, 1000, None)], "id string, prefix string, name string, created_at bigint, last_used_at bigint, expires_at bigint, revoked_at bigint")
    k = k.withColumn("key_hash", keys.token_hash(F.when(F.col("id") == key_id, token).otherwise("wfc-old")))
    t = spark.createDataFrame([(token,), ("wfc-old",), ("boss",), (None,)], "token string")
    got = {r.token: r.allowed for r in keys.authorize(t, k, now, ["boss", " "]).collect()}
    assert got == {token: True, "wfc-old": False, "boss": True, None: False}
    assert all(r.allowed for r in keys.authorize(t, k, now).collect())


def test_repair_loop(spark):
    pages = spark.createDataFrame([(1, "five"), (2, ""), (3, "boom"), (4, "never")], "id int, content string")

    def model(messages):
        page = messages[1]["content"]
        if "boom" in page:
            raise ValueError("no answer")
        if "never" in page:
            return "no json"
        return '```json\n{"n": 5}\n```' if len(messages) > 3 else '{"n": "5"}'

    got = {r.id: (r.data, r.warning, r.attempts) for r in extract.extract_structured(pages, model, {"type": "object", "properties": {"n": {"type": "integer"}}}).collect()}
    assert got[1] == ('{"n": 5}', None, 2)
    assert got[2] == (None, "no content to extract from", 0)
    assert got[3] == (None, "AI extraction failed: no answer", 1)
    assert got[4][0] is None and got[4][2] == 3


def test_options():
    o = options.parse_options('{"limit": "12x", "maxDiscoveryDepth": 0, "sitemap": "odd", "includePaths": ["/a", 1], "scrapeOptions": {"formats": ["html", {"type": "json", "prompt": "p"}]}, "webhook": {"url": ""}}')
    assert (o.limit, o.max_depth, o.sitemap, o.include, o.formats, o.webhook) == (12, 0, "include", ("/a",), ("html", "markdown"), None)
    assert options.parse_options("{broken") == options.CrawlOptions()
    f = options.normalize_formats(["links", "screenshot@fullPage", "links", "video", {"type": "summary"}])
    assert (f.names, f.full_page, f.summary, len(f.warnings)) == (["links", "screenshot", "summary"], True, True, 2)
    with pytest.raises(options.FormatError):
        options.normalize_formats(["nothing"])
    assert options.ModelConfig.from_env({"LLM_TIMEOUT_MS": "5", "LLM_MAX_REPAIRS": "x", "LLM_STRICT_JSON": "ON"}) == options.ModelConfig(1000, 2, 48_000, "on")


def test_streamed_queue_survives_repeats(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    changes = [(1, "processing", 1), (1, "done", 2), (2, "processing", 1), (1, "pending", 3), (2, "processing", 1)]
    spark.createDataFrame(changes, "id bigint, status string, seq bigint").repartition(1).write.parquet(source)
    stream = spark.readStream.schema("id bigint, status string, seq bigint").parquet(source)
    queue.run_queue(spark, stream, state, str(tmp_path / "check")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{state}/v=0").select("id", "status", "seq").collect()))
    assert got == [(1, "done", 2), (2, "processing", 1)]
    again = queue.merge_changes(spark.read.parquet(f"{state}/v=0"), spark.createDataFrame(changes, "id bigint, status string, seq bigint"))
    assert sorted(map(tuple, again.collect())) == got
