import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from webspark.llm import near


def alike(texts, words, threshold, least):
    """The pairs by definition."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= max(least, words):
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def found(spark, texts, **kw):
    df = spark.createDataFrame(texts, "id bigint, markdown string")
    rows = [tuple(r) for r in near.pairs_found(df, "id", "markdown", **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def edited_copies(n, edits, length=240, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(length), edits):
            words[at] = f"own{i}x{at}"
        out.append((i, " ".join(words)))
    return out


def test_group_of_many_edited_copies(spark):
    texts = edited_copies(60, 10) + [(1000 + i, t) for i, t in edited_copies(5, 4, seed=4)]
    expected = alike(texts, 3, 0.6, 40)
    assert len(expected) > 500
    assert found(spark, texts, words=3, threshold=0.6, least=40) == expected


def test_blocks_of_a_common_key(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    texts = edited_copies(60, 10, seed=5)
    assert found(spark, texts, words=3, threshold=0.6, least=40) == alike(texts, 3, 0.6, 40)


def test_small_sets_are_exact(spark):
    # 2 sequences against 3 that hold them: similarity 2/3
    texts = []
    for i in range(300):
        a, b = f"x{i}", f"y{i}"
        texts += [(2 * i, " ".join([a, b] * 25)), (2 * i + 1, " ".join([a, b] * 24 + [a, "end"]))]
    expected = alike(texts, 3, 0.6, 40)
    assert len(expected) == 300
    assert found(spark, texts, words=3, threshold=0.6, least=40) == expected


@pytest.mark.parametrize("pages", [12, 40, 400])
def test_core_with_own_tails(spark, pages):
    """One core, each page with a tail of its own: similarities of about 0.65 to 0.85."""
    rng = random.Random(pages)
    core = [f"c{rng.randrange(10**6)}" for _ in range(300)]
    texts = [(i, " ".join(core + [f"t{i}x{k}" for k in range(rng.randrange(15, 65))])) for i in range(pages)]
    expected = alike(texts, 3, 0.6, 40)
    assert len(expected) > 0.9 * pages * (pages - 1) / 2
    assert found(spark, texts, words=3, threshold=0.6, least=40) == expected


def test_pages_that_share_furniture_only(spark):
    rng = random.Random(9)
    furniture = " ".join(f"f{k}" for k in range(60))
    texts = [(i, furniture + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(80)]
    texts += [(100 + i, t + f" end{i}") for i, t in texts[:5]]
    assert found(spark, texts, words=3, threshold=0.6, least=40) == {(i, 100 + i) for i in range(5)}


def test_nulls_empty_and_long_texts(spark):
    long = " ".join(f"l{k}" for k in range(50_000))
    texts = [(1, None), (2, ""), (3, "too short"), (4, long), (5, long + " tail"), (6, long), (None, "x " * 50)]
    assert found(spark, texts, words=3, threshold=0.6, least=40) == {(4, 5), (4, 6), (5, 6)}
    assert found(spark, [], words=3, threshold=0.6, least=40) == set()


def test_classes_count_links(spark):
    texts = edited_copies(4, 2, seed=8)
    df = spark.createDataFrame([*texts, (10, texts[0][1]), (11, "none " * 3)], "id bigint, markdown string").withColumn("k1", F.lit("x"))
    got = {r.id: (r.class_id, r.n_links) for r in near.classes(df, "id", "markdown", words=3, threshold=0.6, least=40).collect()}
    assert got == {0: (0, 3), 10: (0, 3), 1: (1, 3), 2: (2, 3), 3: (3, 3)}


@pytest.mark.parametrize("small, large", [(60, 100), (95, 158), (96, 160), (383, 638), (39, 65)])
def test_keys_across_bands(small, large):
    """A set and one that holds it, at a similarity of 0.6, each alone in its batch."""
    rng = np.random.default_rng(small)
    for _ in range(40):
        h = rng.integers(0, 2**63, size=large, dtype=np.uint64)
        keys = [set(near.part_keys(np.zeros(len(x), np.int64), np.sort(x), 0.6)[1].tolist()) for x in (h[:small], h)]
        assert len(keys[0] & keys[1]) >= 2
