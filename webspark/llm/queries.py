"""The queries pN_... of the training-data problems, and their SQL where SQL can say them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.io import table
from webspark.llm import copies, encode, mixing, near, residue, sentences, site_lines, spam, wrappers


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.excess_places(table(spark, d, "crawl_results", "id", "job_id", "markdown"), table(spark, d, "crawl_jobs", "id", "url"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.remove_excess_lines(table(spark, d, "crawl_results", "id", "job_id", "markdown"), table(spark, d, "crawl_jobs", "id", "url"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "crawl_results", "id", "url", "markdown")).select("id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.outside_lines(table(spark, d, "crawl_results", "id", "url", "markdown"))


def p3_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each page's main body as markdown lines."""
    return wrappers.main_bodies(table(spark, d, "crawl_results", "id", "url", "markdown")).select("id", "markdown", "n_outside")


def p3_wrappers(spark: SparkSession, d: str) -> DataFrame:
    """The inferred wrapper of each site as an expression."""
    return wrappers.wrapper_expressions(wrappers.infer(table(spark, d, "crawl_results", "id", "url", "markdown"))[1])


def _p4_tables(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    return [(t, table(spark, d, t, "id", "job_id", "url")) for t in ("crawl_queue", "crawl_results")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [df.withColumn("tbl", F.lit(t)) for t, df in _p4_tables(spark, d)]
    both = reduce(DataFrame.unionByName, parts)
    return copies.copies(both, ["tbl", "job_id"], copies.canonical_url(F.col("url"))).select("tbl", "first_id", "id")


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    parts = [df.withColumn("tbl", F.lit(t)) for t, df in _p4_tables(spark, d)]
    both = reduce(DataFrame.unionByName, parts)
    return copies.collapse(both, ["tbl", "job_id"], copies.canonical_url(F.col("url"))).select("tbl", "job_id", "first_id", "n_copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near.pairs_found(table(spark, d, "crawl_results", "id", "markdown"), "id", "markdown", words=3, threshold=0.6, least=40)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return near.classes(table(spark, d, "crawl_results", "id", "markdown"), "id", "markdown", words=3, threshold=0.6, least=40)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_records(table(spark, d, "crawl_results", "id", "markdown", "status_code")).select("id")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """The table without these records."""
    return residue.without_residue(table(spark, d, "crawl_results"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "ids")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text after encoding and decoding; null texts come back empty."""
    ids = encode.encode_texts(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "ids")
    return encode.decode_ids(ids).select("doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = encode.count_tokens(table(spark, d, "documents", "doc_id", "text", "source"))
    return mixing.mix(docs.select("doc_id", "source", "n_tokens"), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].select("doc_id", "source", "n_tokens", "uses")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_chars(spark: SparkSession, d: str) -> DataFrame:
    """The same mixture with sizes in characters, which SQL can follow."""
    docs = table(spark, d, "documents", "doc_id", "source", "n_chars").select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).alias("n_tokens"))
    return mixing.mix(docs, table(spark, d, "mix_targets"))[0].select("doc_id", "source", "n_tokens", "uses")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents", "doc_id", "text", "lang"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The units themselves, numbered within their text."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return sentences.sentence_texts(docs)


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p3_found, p3_bodies, p3_wrappers, p4_found, p4_pages, p5_found, p5_classes, p6_found, p6_clean, p7_ids, p7_decoded, p8_mix, p8_shares, p8_chars, p9_found, p9_sentences)}

_P4_SQL = r"""
WITH named AS (
  SELECT 'crawl_queue' AS tbl, id, job_id, url FROM crawl_queue
  UNION ALL SELECT 'crawl_results', id, job_id, url FROM crawl_results
), marks AS (
  -- the visible characters alone, and where scheme and query are set off
  SELECT tbl, id, job_id, url IS NULL AS unnamed,
    lower(array_to_string(regexp_extract_all(url, '[^\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]'), '')) AS u FROM named
), ends AS (
  SELECT *, CASE WHEN instr(u, '?') > 0 THEN instr(u, '?') ELSE length(u) + 1 END AS q,
    CASE WHEN regexp_matches(u, '^[^:/?#]*://') THEN instr(u, '://') ELSE 0 END AS s FROM marks
), pieces AS (
  SELECT *, substr(u, 1, greatest(s - 1, 0)) AS scheme, substr(u, q + 1) AS query,
    CASE WHEN s > 0 THEN substr(u, s + 3, q - s - 3) ELSE substr(u, 1, q - 1) END AS place FROM ends
), keys AS (
  SELECT tbl, id, job_id, unnamed, regexp_extract_all(scheme, '[\p{L}\p{N}]+') AS scheme,
    regexp_extract_all(regexp_extract(place, '^[^/#]*'), '[\p{L}\p{N}]+') AS h,
    regexp_extract_all(substr(place, length(regexp_extract(place, '^[^/#]*')) + 1), '[\p{L}\p{N}]+') AS p,
    list_sort(list_filter(list_transform(string_split(query, '&'), lambda x: regexp_extract_all(x, '[\p{L}\p{N}]+')), lambda x: len(x) > 0)) AS q
  FROM pieces
)
"""

_P1_SQL = r"""
WITH jobs AS (
  SELECT id AS job_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(regexp_replace(url, '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g')), '^[^:/?#]*:?//', ''), '^[^/?#]*'), '^.*@', ''), ':\d*$', '') AS source
  FROM crawl_jobs
), lines AS (
  SELECT id, job_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS line_no
  FROM crawl_results WHERE markdown IS NOT NULL
), keys AS (
  SELECT id, source, line_no, regexp_replace(lower(regexp_replace(line, '\]\([^)]*\)', '', 'g')), '[^\p{L}]+', '', 'g') AS k
  FROM lines JOIN jobs USING (job_id) WHERE source <> ''
), often AS (
  SELECT source, k FROM keys WHERE k <> '' GROUP BY source, k HAVING count(DISTINCT id) >= 8
), found AS (SELECT id, line_no FROM keys JOIN often USING (source, k))
"""

_P5_SQL = r"""
WITH words AS (SELECT id, regexp_extract_all(lower(markdown), '[\p{L}\p{N}]+') AS w FROM crawl_results WHERE markdown IS NOT NULL),
sets AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words WHERE len(w) >= 40),
items AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
near AS (SELECT a.id AS id_a, b.id AS id_b FROM items a JOIN items b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)))
"""

ORACLE = {
    "p1_found": _P1_SQL + "SELECT id, line_no FROM found",
    "p1_clean": _P1_SQL
    + """, gone AS (SELECT id, list(line_no) AS l FROM found GROUP BY id)
SELECT r.id, job_id, CASE WHEN l IS NULL THEN markdown ELSE array_to_string(list_filter(string_split(markdown, chr(10)), lambda x, i: NOT list_contains(l, i)), chr(10)) END AS markdown, coalesce(len(l), 0)::INT AS n_removed
FROM crawl_results r LEFT JOIN gone ON gone.id = r.id""",
    "p5_found": _P5_SQL + "SELECT id_a, id_b FROM near",
    "p5_classes": _P5_SQL
    + """, c AS (SELECT id, min(id) OVER (PARTITION BY list_sort(s)) AS class_id FROM sets),
l AS (SELECT DISTINCT a.class_id AS k, b.class_id AS o FROM (SELECT id_a, id_b FROM near UNION ALL SELECT id_b, id_a FROM near) n JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE a.class_id <> b.class_id)
SELECT id, class_id, count(o) AS n_links FROM c LEFT JOIN l ON l.k = c.class_id GROUP BY id, class_id""",
    "p4_found": _P4_SQL
    + """, firsts AS (SELECT *, min(id) OVER (PARTITION BY tbl, job_id, scheme, h, p, q) AS first_id FROM keys WHERE NOT unnamed)
SELECT tbl, first_id, id FROM firsts WHERE id <> first_id""",
    "p4_pages": _P4_SQL
    + """SELECT tbl, job_id, min(id) AS first_id, count(*) AS n_copies FROM keys WHERE NOT unnamed GROUP BY tbl, job_id, scheme, h, p, q
UNION ALL SELECT tbl, job_id, id, 1 FROM keys WHERE unnamed""",
    "p8_chars": """
WITH s AS (SELECT doc_id, source, n_chars AS n FROM documents WHERE n_chars > 0 AND source IS NOT NULL),
h AS (SELECT source, sum(n) AS tokens FROM s GROUP BY source),
t AS (SELECT m.source, target_share, max_repeats, tokens FROM mix_targets m JOIN h USING (source) WHERE target_share > 0 AND max_repeats > 0),
b AS (SELECT sum(target_share) AS share, min(max_repeats * tokens / target_share) AS most FROM t),
w AS (SELECT source, tokens, least(most * share * (target_share / share), max_repeats * tokens) AS wanted FROM t, b),
r AS (SELECT source, floor(wanted / tokens + 1e-12)::INT AS certain, greatest(wanted - floor(wanted / tokens + 1e-12) * tokens, 0) AS rest FROM w),
-- the k largest documents are certain where the scale of the others keeps them below one
k AS (SELECT source, rest, n::DOUBLE AS n, sum(n::DOUBLE) OVER w - n AS larger, sum(n::DOUBLE * n) OVER v - (sum(n::DOUBLE * n) OVER w - n::DOUBLE * n) AS squares
  FROM s JOIN r USING (source) WINDOW w AS (PARTITION BY source ORDER BY n DESC, doc_id ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY source)),
l AS (SELECT source, arg_min((rest - larger) / squares, larger) FILTER ((rest - larger) / squares * n < 1) AS scale FROM k GROUP BY source),
p AS (SELECT doc_id, source, n, certain, rest, least(coalesce(scale, 1e300) * n, 1.0) AS p, (('0x' || substr(md5('8:' || doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM s JOIN r USING (source) LEFT JOIN l USING (source)),
q AS (SELECT *, CASE WHEN p >= 1 THEN 0.0 ELSE u / (1 - u) / greatest(p / (1 - p), 1e-300) END AS rank FROM p),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY rank, doc_id, n ROWS UNBOUNDED PRECEDING) - n AS before FROM q),
u AS (SELECT doc_id, source, n, certain + CASE WHEN before + n <= rest THEN 1 WHEN before < rest AND before + n / 2 <= rest THEN 1 ELSE 0 END AS uses FROM c)
SELECT doc_id, source, n AS n_tokens, uses FROM u WHERE uses > 0""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
