"""Problem 2: keyword-stuffed and link-list pages.

Each page becomes a point of density, entropy, repetition and function-word features of its own
text. Per language, location and scatter are estimated robustly: medians and median deviations
first, then concentration steps that keep the closest three quarters of all pages and take their
mean and covariance. Pages whose robust Mahalanobis distance is large and whose deviation points in
a spam-directed direction are flagged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.io import materialize
from webspark.llm.words import ALL_FUNCTION_WORDS, LINK, WORD, language

FEATURES = ("fw", "entropy", "repeat", "sentence", "marks", "linked")
#: The smallest spread taken for a feature, so that one that hardly varies cannot blow up distances.
FLOOR = (0.02, 0.02, 0.02, 0.04, 0.03, 0.03)
#: Pages with fewer words of their own have no statistics.
LEAST_WORDS = 20
#: Share of the pages of a language that a concentration step keeps, and the number of steps.
KEPT, STEPS = 0.75, 3
#: Languages with fewer pages share one estimate.
LEAST_PAGES = 50
#: Squared distance beyond which a page is an outlier: the 0.9999 quantile of chi-square with 6 degrees.
CUTOFF = 27.86
#: Robust standard deviations that a spam-directed feature must lie off.
DIRECTED = 3.0

_SENTENCE_END = frozenset(".!?。！？")
_MARKS = frozenset(",;|/·•#*–=+~_>")


def own_lines(markdown: str, site: str) -> list[str]:
    """Lines of a page apart from its furniture: from the title on, without code blocks and without
    lines that are nothing but links into the site."""
    lines = markdown.split("\n")
    start = next((i for i, l in enumerate(lines) if l.lstrip().startswith("# ")), 0)
    out, code = [], False
    for line in lines[start:]:
        s = line.strip()
        if s.startswith("```"):
            code = not code
            continue
        if code or not s:
            continue
        if "](" in s:
            found = LINK.findall(s)
            if found and all(t.startswith("/") or (site and site in t.lower()) for _, t in found) and not WORD.search(LINK.sub("", s)):
                continue
        out.append(s)
    return out


def page_features(markdown: str | None, site: str = "") -> tuple[str | None, list[float]] | None:
    """(language or null, features) of a page; null if it has fewer than LEAST_WORDS words of its
    own. Whole texts are used.

    fw: share of function words. entropy: of the words, against its maximum. repeat: word pairs
    repeated within stretches of 60 words. sentence: share of words in units with a final mark.
    marks: list marks a word. linked: share of words inside links.
    """
    if not markdown:
        return None
    lines = own_lines(markdown, site)
    words: list[str] = []
    ended = linked = marks = 0
    for line in lines:
        text = line
        if "](" in line:
            for anchor, _ in LINK.findall(line):
                linked += len(WORD.findall(anchor))
            text = LINK.sub(r"\1", line)
        own = WORD.findall(text.lower())
        if not own:
            continue
        words += own
        marks += sum(text.count(m) for m in _MARKS)
        last = max(text.rfind(m) for m in _SENTENCE_END)
        if last >= 0:
            ended += len(own) if last > 0.8 * len(text) else len(WORD.findall(text[:last]))
    n = len(words)
    if n < LEAST_WORDS:
        return None
    counts = np.unique(np.array(words), return_counts=True)[1] / n
    pairs = list(zip(words, words[1:]))
    repeated = total = 0
    for at in range(0, n - 1, 60):
        stretch = pairs[at : at + 60]
        repeated += len(stretch) - len(set(stretch))
        total += len(stretch)
    features = [
        sum(w in ALL_FUNCTION_WORDS for w in words) / n,
        float(-(counts * np.log2(counts)).sum()) / math.log2(n),
        repeated / total,
        ended / n,
        marks / n,
        linked / n,
    ]
    return language(words), features


def feature_table(pages: DataFrame) -> DataFrame:
    """(id, site, lang, n features) of every page with enough words; pages: id, url, markdown."""
    site = F.regexp_extract(F.lower(F.regexp_replace("url", r"[\s\p{Z}\p{Cc}\p{Cf}]+", "")), r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, s, m in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found = page_features(m, s or "")
                if found:
                    rows.append((i, s, found[0], *found[1]))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), *[pa.array(c, pa.float64()) for c in columns[3:]]],
                    ["id", "site", "lang", *FEATURES],
                )

    narrow = pages.where("markdown is not null").select("id", site.alias("site"), "markdown")
    return narrow.mapInArrow(run, f"id {kind}, site string, lang string, {', '.join(f'{c} double' for c in FEATURES)}")


def with_language(points: DataFrame) -> DataFrame:
    """Pages whose own text shows no language take the one most pages of their site have."""
    by_site = points.where("lang is not null").groupBy("site", "lang").agg(F.count(F.lit(1)).alias("n"))
    of_site = by_site.groupBy("site").agg(F.max_by("lang", F.struct("n", "lang")).alias("site_lang"))
    bare = points.where("lang is null").join(of_site, "site", "left").withColumn("lang", F.coalesce("site_lang", F.lit("und"))).drop("site_lang")
    return points.where("lang is not null").unionByName(bare).drop("site")


def _lookup(values: dict[str, list[float]]) -> Column:
    """The array of a language; languages without an estimate take that of all pages."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("lang")), F.array(*[F.lit(float(y)) for y in values["*"]]))


def _distance(model: dict[str, tuple[np.ndarray, np.ndarray]]) -> Column:
    """Squared Mahalanobis distance under the model of the row's language."""
    k = len(FEATURES)
    flat = _lookup({lang: [*mu, *np.linalg.cholesky(np.linalg.inv(cov)).T.ravel()] for lang, (mu, cov) in model.items()})
    x = F.array(*FEATURES)
    # bound once per row: the model and the centred point
    return F.transform(
        F.array(F.struct(flat.alias("m"), x.alias("x"))),
        lambda r: sum(
            (
                F.pow(sum((r["m"][k + i * k + j] * (r["x"][j] - r["m"][j]) for j in range(i, k)), F.lit(0.0)), 2)
                for i in range(k)
            ),
            F.lit(0.0),
        ),
    )[0]


def robust_model(points: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Location and scatter by language, and "*" for all pages together.

    Every figure is an aggregate over all pages of a language: medians and median deviations, then
    STEPS concentration steps. Only these figures (a few numbers a language) reach the driver.
    """
    k = len(FEATURES)
    # each page counts for its language and for all
    both = points.withColumn("g", F.explode(F.array("lang", F.lit("*"))))

    def grouped(df: DataFrame, *aggs: Column) -> dict[str, tuple]:
        return {r[0]: tuple(r)[1:] for r in df.groupBy("g").agg(*aggs).collect()}

    medians = grouped(both, F.count(F.lit(1)), *[F.percentile_approx(c, 0.5, 2000) for c in FEATURES])
    if not medians:
        return {}
    wanted = [g for g, v in medians.items() if g == "*" or v[0] >= LEAST_PAGES]
    centre = {g: np.array(medians[g][1:]) for g in wanted}
    off = both.where(F.col("g").isin(wanted)).withColumn("lang", F.col("g"))
    mads = grouped(off, *[F.percentile_approx(F.abs(F.col(c) - _lookup({g: list(v) for g, v in centre.items()})[i]), 0.5, 2000) for i, c in enumerate(FEATURES)])
    floor = np.array(FLOOR)
    model = {g: (centre[g], np.diag(np.maximum(1.4826 * np.array(mads[g]), floor) ** 2)) for g in wanted}
    products = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(STEPS):
        placed = off.withColumn("d", _distance(model))
        cut = grouped(placed, F.percentile_approx("d", KEPT, 2000))
        near = placed.where(F.col("d") <= _lookup({g: [v[0]] for g, v in cut.items()})[0])
        sums = grouped(near, F.count(F.lit(1)), *[F.avg(c) for c in FEATURES], *[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in products])
        for g, values in sums.items():
            mu = np.array(values[1 : k + 1])
            cov = np.zeros((k, k))
            for (i, j), v in zip(products, values[k + 1 :]):
                cov[i, j] = cov[j, i] = v - mu[i] * mu[j]
            # trimmed pages spread wider than the kept ones; no feature counts as fixed
            cov = 1.6 * cov + np.diag(floor**2)
            model[g] = (mu, cov)
    return model


def spam_pages(pages: DataFrame) -> DataFrame:
    """(id, lang, distance, and the features) of pages that are spam; pages: id, url, markdown.

    Null and empty texts and pages of under LEAST_WORDS words are none. Repeated rows are each
    judged and count like any others. An empty table gives no rows; further columns are ignored.
    """
    points = materialize(with_language(materialize(feature_table(pages.select("id", "url", "markdown")), "p2-features")), "p2-points")
    model = robust_model(points)
    if not model:
        return points.withColumn("distance", F.lit(0.0)).where(F.lit(False))
    z = _lookup({g: [*mu, *np.sqrt(np.diag(cov))] for g, (mu, cov) in model.items()})
    k = len(FEATURES)

    def off(name: str) -> Column:
        i = FEATURES.index(name)
        return (F.col(name) - z[i]) / z[k + i]

    fewer_function_words = off("fw") <= -DIRECTED
    directed = (off("repeat") >= 2 * DIRECTED) | (off("sentence") <= -DIRECTED) | (off("linked") >= DIRECTED)
    return points.withColumn("distance", _distance(model)).where((F.col("distance") > CUTOFF) & fewer_function_words & directed)
