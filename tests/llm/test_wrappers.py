import random

from webspark.llm import wrappers


def site_pages(n, site="quiet-lamp.example", seed=1, first=0):
    """Pages of one site with a known body; (rows, {(id, line_no) outside})."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows, outside = [], set()
    for k in range(n):
        i, lines = first + k, []

        def add(text, out):
            lines.append(text)
            if out and text:
                outside.add((i, len(lines)))

        if rng.random() < 0.7:
            add("We use cookies. Accept or leave", True)
        for item in ("Home", "News", "Help"):
            add(f"- [{item}](/{item.lower()}?m={rng.randrange(9)})", True)
        add("", False)
        title = f"The {word()} of {word()}"
        add(f"Home > {title}", True)
        add(f"# {title}", False)
        add(f"Written by {word().title()}, {rng.randrange(2000, 2025)}", True)
        for _ in range(rng.randrange(3, 7)):
            add(" ".join(f"A {word()} was {word()} near the {word()}." for _ in range(8)), False)
            if rng.random() < 0.3:
                add("QuietLamp is not liable for anything.", True)
        add(f"- The {word()} is {word()} now.", False)
        if rng.random() < 0.8:
            add("Read next", True)
            for _ in range(3):
                add(f"* [{word()} {word()}](https://www.{site}/a/{rng.randrange(9999)})", True)
        add("© 2024 QuietLamp. All rights reserved.", True)
        rows.append((i, f"https://www.{site}/p{i}", "\n".join(lines)))
    return rows, outside


def outside(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, url string, markdown string").selectExpr("*", "'x' AS site", "1 AS kind")
    got = [tuple(r) for r in wrappers.outside_lines(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_one_site(spark):
    rows, expected = site_pages(60)
    assert outside(spark, rows) == expected


def test_hot_site_is_aligned_in_groups(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "GROUP_PAGES", 10)
    monkeypatch.setattr(wrappers, "FAN", 3)
    rows, expected = site_pages(80, seed=2)
    assert outside(spark, rows) == expected
    df = spark.createDataFrame(rows, "id bigint, url string, markdown string")
    tokens, nodes = wrappers.infer(df)
    got = nodes.collect()
    assert len({r.symbol for r in got}) == len(got) and all(r.total == 80 for r in got)
    assert "TITLE" in wrappers.wrapper_expressions(nodes).first().expression


def test_notices_and_link_lists_are_bodies(spark):
    rows, expected = site_pages(40, seed=3)
    extra = [(1000 + i, "https://www.quiet-lamp.example/e", "Not found\n\nNothing at /x here") for i in range(20)]
    farm = "\n".join(f"* [w{i} v{i}](https://else.example/{i})" for i in range(60))
    assert outside(spark, [*rows, *extra, (2000, "https://www.quiet-lamp.example/f", "# Links\n" + farm)]) == expected


def test_nulls_empty_and_odd_rows(spark):
    rows, expected = site_pages(30, seed=4)
    long = "# Long\n" + "\n".join(f"Sentence number {i} of many stands here." for i in range(5000))
    odd = [(None, None, None), (500, "https://www.quiet-lamp.example/x", None), (501, "nowhere", "# A\n" + "word " * 50), (502, "https://www.quiet-lamp.example/y", ""), (503, "https://www.quiet-lamp.example/z", long)]
    assert outside(spark, [*rows, *odd]) == expected
    assert outside(spark, []) == set()


def test_bodies(spark):
    rows, expected = site_pages(30, seed=5)
    df = spark.createDataFrame([*rows, (900, None, None)], "id bigint, url string, markdown string").selectExpr("*", "9 AS n_outside")
    got = {r.id: (r.markdown, r.n_outside) for r in wrappers.main_bodies(df).collect()}
    for i, _, text in rows:
        lines = text.split("\n")
        assert got[i][0] == "\n".join(l for n, l in enumerate(lines, 1) if (i, n) not in expected)
    assert got[900] == (None, 0)


def test_alignment_keeps_the_order():
    w = wrappers.Wrapper()
    for symbols in ([1, 2, 4], [1, 3, 4], [2, 3, 4, 5], [9, 1]):
        w.align(symbols, {s: [1, 0, 0] for s in symbols}, 1)
    assert w.pages == 4 and set(w.order) == {1, 2, 3, 4, 5, 9}
    assert [w.order.index(s) for s in (9, 1, 3, 4, 5)] == sorted(w.order.index(s) for s in (9, 1, 3, 4, 5))
