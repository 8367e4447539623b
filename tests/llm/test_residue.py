import random

import numpy as np

from webspark.llm import residue

NAMES = "Morland Tolby Wexham Garrow Pilton Dunmere Ashby Corfe".split()


def rows(n=400, seed=1):
    """Articles, some with residue, some notices; (rows, ids that hold it)."""
    rng = random.Random(seed)
    sentence = lambda: f"The {rng.choice(['crew', 'council', 'keeper', 'baker'])} of {rng.choice(NAMES)} has {rng.choice(['mended', 'painted', 'moved', 'sold'])} {rng.randrange(90)} {rng.choice(['boats', 'lamps', 'walls', 'gates'])} since the winter."
    out, bad = [], set()
    for i in range(n):
        lines = [f"# News from {rng.choice(NAMES)}", *[" ".join(sentence() for _ in range(4)) for _ in range(3)], "Share this page with a friend"]
        code, kind = 200, rng.random()
        if kind < 0.05:
            lines = [rng.choice(["Page not found", "Access denied", "Please enable JavaScript to view"]) + " " + rng.choice(NAMES)]
            code = rng.choice([200, 404, 403, None])
            bad.add(i)
        elif kind < 0.1:
            lines[2] = rng.choice(["Dear {{first_name}}, welcome to", "Hello [Insert company here], welcome to", "Dear %%name%%, welcome to"]) + " " + rng.choice(NAMES)
            bad.add(i)
        elif kind < 0.13:
            words = "lorem ipsum dolor amet varius navis tortis pellor gravis".split()
            lines[1:4] = [" ".join(rng.choice(words) for _ in range(40)).capitalize() + "." for _ in range(3)]
            bad.add(i)
        elif kind < 0.18:
            lines[2] = "In our templates a mark such as `{{ title }}` is replaced.\n```\n<p>{{ title }}</p>\n```"
        elif kind < 0.2:
            code = 404
        out.append((i, "\n\n".join(lines), code))
    return out, bad


def found(spark, data):
    df = spark.createDataFrame(data, "id bigint, markdown string, status_code int").selectExpr("*", "0.5 AS score", "'x' AS size")
    return {r.id for r in residue.residue_records(df).collect()}


def test_held_out_accuracy(spark):
    data, bad = rows(1500)
    got = found(spark, data)
    assert len(got & bad) >= 0.97 * len(bad) and len(got - bad) <= 0.02 * len(got)


def test_clean_table(spark):
    data, bad = rows(600, seed=5)
    df = spark.createDataFrame([*data, (None, "kept", 200)], "id bigint, markdown string, status_code int")
    kept = residue.without_residue(df)
    assert kept.columns == df.columns
    assert {r.id for r in kept.collect()} == {r[0] for r in data} - found(spark, data) | {None}


def test_nulls_blank_and_long_texts(spark):
    data, bad = rows(600, seed=6)
    long = "word " * 200_000 + "\n\nDear {{first_name}}, welcome to Tolby"
    got = found(spark, [*data, (9001, None, 404), (9002, "", 404), (9003, " \n ", 500), (9004, long, None)])
    assert 9004 in got and not got & {9001, 9002, 9003}
    assert found(spark, []) == set()
    assert found(spark, [(1, "Plain words stand here.", 200)]) == set()


def test_scores_are_sums_over_the_passage():
    data, _ = rows(80)
    p = residue.Passages([r[1] for r in data], [r[2] for r in data])
    rng = np.random.default_rng(0)
    w = rng.normal(size=residue.N_WEIGHTS)
    got = p.scores(w)
    for k in range(0, len(p.starts), 37):
        a, b = p.starts[k], p.ends[k]
        plain = w[p.places[a:b]].sum() + w[p.pairs[a : b - 1]].sum() + w[2 * residue.PLACES + p.size[k]] + w[-1]
        assert abs(got[k] - plain) < 1e-6
