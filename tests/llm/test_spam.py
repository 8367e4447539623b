import random

from webspark.llm import spam

NOUNS = "boat lamp chair stone bridge garden river clock window ladder".split()


def article(rng):
    return "# On things\n\n" + " ".join(
        f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} near {rng.choice(NOUNS)}{rng.randrange(99)} was seen by {rng.randrange(9)} people, and it has been there for {rng.randrange(90)} years." for _ in range(rng.randrange(6, 14))
    )


def pages(spark, extra):
    rng = random.Random(2)
    rows = [(i, f"https://s{i % 5}.example/p", article(rng)) for i in range(300)]
    return spark.createDataFrame([*rows, *[(1000 + i, "https://s1.example/x", t) for i, t in enumerate(extra)]], "id bigint, url string, markdown string").selectExpr("*", "1 AS fw", "'x' AS lang")


def test_spam_and_its_look_alikes(spark):
    rng = random.Random(3)
    words = lambda n: [rng.choice(NOUNS) for _ in range(n)]
    keywords = ", ".join(f"cheap {w}" for w in words(80))
    stuffed = " ".join(f"Buy wooden lamp cheap wooden lamp {w}, wooden lamp." for w in words(25))
    farm = "\n".join(f"* [{w} {rng.randrange(99)}](https://else.example/{i})" for i, w in enumerate(words(60)))
    tags = " ".join(f"#{a}{b}" for a, b in zip(words(60), words(60)))
    explained = "# Links\n\n" + "\n".join(f"- [{w}](https://o.example/{i}): It is the one that they have used for the {w} in the end." for i, w in enumerate(words(15)))
    tables = article(rng) + "\n" + "\n".join(f"| {w} | {rng.randrange(900)} kg |" for w in words(10))
    glossary = "# Words\n\n" + "\n".join(f"- {w}: a thing that is used by the people of the town when it is cold." for w in words(14))
    found = {r.id for r in spam.spam_pages(pages(spark, [keywords, stuffed, farm, tags, explained, tables, glossary])).collect()}
    assert found == {1000, 1001, 1002, 1003}


def test_furniture_is_no_spam(spark):
    nav = "\n".join(f"- [Item{i}](/i{i}?m=1)" for i in range(40))
    assert spam.spam_pages(pages(spark, [nav + "\n\n" + article(random.Random(4)), nav])).count() == 0


def test_nulls_and_empty_tables(spark):
    df = pages(spark, ["", None, "short"])
    assert spam.spam_pages(df).count() == 0
    assert spam.spam_pages(df.where("false")).count() == 0
    assert spam.spam_pages(df.withColumn("url", df.url.substr(1, 0))).count() == 0


def test_distance_is_the_mahalanobis_distance(spark):
    import numpy as np

    df = spam.materialize(spam.with_language(spam.feature_table(pages(spark, []).select("id", "url", "markdown"))), "t")
    model = spam.robust_model(df)
    mu, cov = model["en"]
    row = df.withColumn("d", spam._distance(model)).first()
    x = np.array([row[c] for c in spam.FEATURES]) - mu
    assert abs(row.d - x @ np.linalg.inv(cov) @ x) < 1e-6 * max(1, row.d)
