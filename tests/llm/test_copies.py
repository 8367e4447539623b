import random

from pyspark.sql import functions as F

from webspark.llm import copies


def found(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, job_id string, url string").selectExpr("*", "1 AS ws_id", "'x' AS first_id2", "2 AS ws_hash")
    return sorted(((r.job_id, r.first_id, r.id) for r in copies.copies(df, ["job_id"], copies.canonical_url(F.col("url"))).collect()), key=str)


def test_spellings_of_one_page(spark):
    same = [
        "https://www.h.example/a/b?x=1&y=2", "HTTPS://WWW.H.EXAMPLE/A/B/?y=2&x=1", '"https://www.h.example/a/b?x=1&y=2"', "(https://www.h.example//a//b?&&x=1&y=2&)", "«https://www.h.example/a/b?y=2&x=1»",
        "https://www.h.​example/a/b?x=1&y=2#", " https://www.h.example/a_b?x=1&y=2\n", "[https://www.h.example/a.b?x-1&y=2]",
    ]
    other = ["http://www.h.example/a/b?x=1&y=2", "https://www.h.example/a/b?x=1&y=3", "https://www.h.example/a/b", "https://www.h.example/ab?x=1&y=2", "https://www.h.example/a/b?x=1?y=2", "https://www.h.example/a%20b?x=1&y=2"]
    rows = [(i, "j", u) for i, u in enumerate([*same, *other])]
    assert found(spark, rows) == [("j", 0, i) for i in range(1, len(same))]


def test_scope_nulls_and_repeats(spark):
    rows = [(1, "a", "https://h/x"), (2, "b", "https://h/x"), (3, None, "https://h/x"), (4, None, "https://h/X"), (5, "a", None), (6, "a", None), (7, "a", ""), (8, "a", " "), (9, "a", "https://h/x"), (9, "a", "https://h/x")]
    assert sorted(found(spark, rows), key=str) == sorted([("a", 1, 9), ("a", 1, 9), ("a", 7, 8), (None, 3, 4)], key=str)
    assert found(spark, []) == []


def test_counts(spark):
    df = spark.createDataFrame([(1, "a", "https://h/x"), (2, "a", "https://h/x/"), (3, "a", None)], "id bigint, job_id string, url string")
    got = sorted((r.first_id, r.n_copies, r.key is None) for r in copies.collapse(df, ["job_id"], copies.canonical_url(F.col("url"))).collect())
    assert got == [(1, 2, False), (3, 1, True)]


def test_canonical_form_against_plain_python(spark):
    import re

    rng = random.Random(1)
    urls = ["".join(rng.choice("abAB1/?&#:.-_=%​ \"(") for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    urls += ["https://" + u for u in urls]

    def plain(u):
        u = re.sub(r"[\s​]", "", u).lower()
        head, _, query = u.partition("?")
        m = re.match(r"(?:([^:/?#]*)://)?([^/#]*)(.*)", head, re.S)
        run = lambda t: "-".join(re.findall(r"[^\W_]+", t or ""))
        return (run(m[1]), run(m[2]), run(m[3]), tuple(sorted(f for f in map(run, query.split("&")) if f)))

    df = spark.createDataFrame(list(enumerate(urls)), "id bigint, url string")
    canon = {r.id: r.c for r in df.select("id", copies.canonical_url(F.col("url")).alias("c")).collect()}
    by_plain, by_canon = {}, {}
    for i, u in enumerate(urls):
        by_plain.setdefault(plain(u), set()).add(i)
        by_canon.setdefault(canon[i], set()).add(i)
    assert sorted(map(sorted, by_plain.values())) == sorted(map(sorted, by_canon.values()))
