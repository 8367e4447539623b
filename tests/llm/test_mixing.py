import random

from pyspark.sql import functions as F

from webspark.llm import mixing


def tables(spark, seed=1, docs=600):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaaabbbcd"), rng.choice([5, 20, 50, 80, 300, 2000 if rng.random() < 0.05 else 10])) for i in range(docs)]
    targets = [("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("d", 0.15, 3), ("none", 0.05, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), rows


def test_shares_and_caps(spark):
    sizes, targets, rows = tables(spark)
    chosen, report = mixing.mix(sizes, targets)
    got = {r.source: r for r in report.collect()}
    for s in "abcd":
        assert abs(got[s].used_tokens - got[s].wanted) <= 1000 + 1e-6
        assert got[s].most_uses <= got[s].max_repeats
    assert got["none"].used_docs == 0 and abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    used = [r.doc_id for r in chosen.collect()]
    assert len(used) == len(set(used))


def test_larger_documents_are_likelier(spark):
    rows = [(i, "a", 10 if i % 2 else 40) for i in range(40_000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_shares(sizes, targets, total=200_000)
    chosen = mixing.sample_uses(sizes, plan).collect()
    large, small = sum(r.n_tokens == 40 for r in chosen), sum(r.n_tokens == 10 for r in chosen)
    assert 3.7 < large / small < 4.3
    assert abs(sum(r.n_tokens for r in chosen) - 200_000) <= 20


def test_probabilities_against_plain_python(spark):
    sizes, targets, rows = tables(spark, seed=3)
    rest = {"a": 4000.0, "b": 9000.0, "c": 100.0, "d": 0.0}
    docs = sizes.join(spark.createDataFrame(list(rest.items()), "source string, rest double"), "source")
    got = {r.source: r.scale for r in mixing.inclusion_scale(docs).collect()}
    for s, wanted in rest.items():
        own = [n for _, t, n in rows if t == s]
        total = sum(n * min(1.0, got[s] * n) for n in own)
        assert abs(total - min(wanted, sum(own))) < 1e-6 * max(wanted, 1)


def test_nulls_ties_and_empty_tables(spark):
    sizes = spark.createDataFrame([(1, None, 5), (2, "a", 0), (3, "a", 7), (3, "a", 7), (4, "x", 9)], "doc_id bigint, source string, n_tokens bigint").withColumn("wanted", F.lit(1))
    targets = spark.createDataFrame([("a", 1.0, 2), ("a", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(sizes, targets)
    assert sorted((r.doc_id, r.uses) for r in chosen.collect()) == [(3, 2), (3, 2)]
    assert [r.source for r in report.collect()] == ["a"]
    assert mixing.mix(sizes.where("false"), targets)[0].count() == 0
    assert mixing.mix(sizes, targets.where("false"))[0].count() == 0
