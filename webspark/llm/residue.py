"""Problem 6: template residue and error-page text.

Records are cut into passages. Passages of trusted records (short pages of a failed request, marks
of template languages, the classical filler words) are the positives; all others are unlabelled. A
naive Bayes model of words and word pairs is fitted by expectation-maximisation: positives stay
positive, unlabelled passages get the probability the current model gives them, counts are taken
anew, until it settles. Every passage of every record is then scored, and a record is decided by
its strongest passages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspark.io import materialize
from webspark.llm.words import LINK

#: Records the model is fitted on at most (in expectation), chosen by a hash of the id.
FIT_RECORDS = 8_000
#: Hash places of words and word pairs.
PLACES = 1 << 19
#: Words of a passage, and the step between passages of a longer line.
WIDTH, STEP = 10, 5
#: Rounds of expectation-maximisation.
ROUNDS = 8
#: Tokens' worth of background that smooths both classes, and the largest weight of a feature.
SMOOTH, CLIP = 300.0, 6.0
#: A feature seen less often in the sample says nothing.
LEAST_SEEN = 3
#: Log odds a passage needs for its record to be taken out: more likely residue than not.
DECIDE = 0.0
#: A page of so few lines and words is short; its size is a feature of its passages.
SHORT_LINES, SHORT_WORDS = 4, 40

#: Fixed values of trusted passages: marks of widespread template languages, values of failed
#: rendering as programs print them (case counts), and the classical filler.
TEMPLATE_MARKS = ("{{", "{%", "<%", "${", "#{", "%%", "[[", "{$", "<!--")
FAILED_VALUES = frozenset([("object", "Object"), ("TODO", ":"), ("[", "Insert"), ("NaN",), ("undefined",)])
FILLER = ("lorem", "ipsum")

_TOKEN = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+")
_LEAD = regex.compile(r"^\s*(?:#{1,6}\s+|>\s+|[-*+]\s+)")
_INLINE = regex.compile(r"(`+)[^`].*?\1")


@lru_cache(1 << 17)
def _place(token: str) -> int:
    if token[0].isnumeric():
        token = "0"
    return zlib.crc32(token.encode()) % PLACES


def visible_lines(markdown: str) -> list[str]:
    """Lines of a page that show as text: no code blocks, inline code or link targets. A fence that
    is never closed opens no block."""
    lines = markdown.split("\n")
    fences = [i for i, l in enumerate(lines) if l.lstrip().startswith("```")]
    hidden = set()
    for a, b in zip(fences[0::2], fences[1::2]):
        hidden.update(range(a, b + 1))
    out = []
    for i, line in enumerate(lines):
        if i in hidden or not line.strip():
            continue
        if "`" in line:
            line = _INLINE.sub(" ", line)
        if "](" in line:
            line = LINK.sub(r"\1", line)
        out.append(_LEAD.sub("", line))
    return out


class Passages:
    """The passages of a batch of records, as flat arrays: word and pair places with the passages'
    ranges over them, the passage's record and its size feature, and whether it is trusted."""

    def __init__(self, texts: list[str | None], codes: list[int | None]) -> None:
        places: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        owner: list[int] = []
        size: list[int] = []
        trusted: list[bool] = []
        for r, (text, code) in enumerate(zip(texts, codes)):
            if not text:
                continue
            lines = [t for t in map(_TOKEN.findall, visible_lines(text)) if t]
            n_words = sum(map(len, lines))
            short = len(lines) <= SHORT_LINES and n_words <= SHORT_WORDS
            failed = short and code is not None and code >= 400
            for raw in lines:
                base, n = len(places), len(raw)
                tokens = [t.lower() for t in raw]
                places += [_place(t) for t in tokens]
                hits = [i for i, t in enumerate(raw) if (not t[0].isalnum() and any(m in t for m in TEMPLATE_MARKS)) or (t,) in FAILED_VALUES or tuple(raw[i : i + 2]) in FAILED_VALUES]
                lorem = [i for i, t in enumerate(tokens) if t in FILLER]
                at = 0
                while True:
                    end = min(at + WIDTH, n)
                    starts.append(base + at)
                    ends.append(base + end)
                    owner.append(r)
                    size.append(min(len(lines), SHORT_LINES) if short else 0)
                    trusted.append(failed or any(at <= i < end for i in hits) or len({tokens[i] for i in lorem if at <= i < end}) == 2)
                    if end == n:
                        break
                    at += STEP
        self.places = np.array(places, np.int64)
        self.starts, self.ends = np.array(starts, np.int64), np.array(ends, np.int64)
        self.owner, self.size, self.trusted = np.array(owner, np.int64), np.array(size, np.int64), np.array(trusted, bool)
        pairs = (self.places[:-1] * 31 + self.places[1:] * 17 + 7) % PLACES if len(places) > 1 else np.empty(0, np.int64)
        self.pairs = pairs + PLACES

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Log odds of each passage."""
        if not len(self.starts):
            return np.empty(0)
        word = np.r_[0.0, np.cumsum(weights[self.places])]
        pair = np.r_[0.0, np.cumsum(weights[self.pairs])]
        size = weights[2 * PLACES + self.size]
        return word[self.ends] - word[self.starts] + pair[np.maximum(self.ends - 1, self.starts)] - pair[self.starts] + size + weights[-1]


#: Places of the model: words, pairs, sizes, and last the prior log odds.
N_WEIGHTS = 2 * PLACES + SHORT_LINES + 1 + 1


def fit(sample: list[Passages]) -> np.ndarray:
    """Weights by expectation-maximisation over passages, trusted ones positive throughout."""
    features, rows, base = [], [], 0
    for p in sample:
        lengths = p.ends - p.starts
        for source, counts in ((p.places, lengths), (p.pairs, np.maximum(lengths - 1, 0))):
            index = np.repeat(p.starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()) if len(counts) else np.empty(0, np.int64)
            features.append(source[index].astype(np.int32))
            rows.append((np.repeat(np.arange(len(lengths)), counts) + base).astype(np.int32))
        features.append((2 * PLACES + p.size).astype(np.int32))
        rows.append((np.arange(len(lengths)) + base).astype(np.int32))
        base += len(lengths)
    trusted = np.concatenate([p.trusted for p in sample]) if sample else np.empty(0, bool)
    weights = np.zeros(N_WEIGHTS)
    if not trusted.any():
        weights[-1] = -np.inf
        return weights
    feature, row = np.concatenate(features), np.concatenate(rows)
    total = np.bincount(feature, minlength=N_WEIGHTS).astype(float)
    share = total / total.sum()
    seen = total >= LEAST_SEEN
    # the first guess knows only the size of short pages: the share of trusted passages of that size
    size = np.concatenate([p.size for p in sample])
    rate = np.bincount(size, weights=trusted, minlength=SHORT_LINES + 1) / np.maximum(np.bincount(size, minlength=SHORT_LINES + 1), 1)
    rate[0] = 0.0
    chance = np.where(trusted, 1.0, rate[size])
    # the share of positives is held at twice the trusted one: letting it grow with the guesses
    # makes small samples drift into furniture
    prior = min(2 * trusted.mean(), 0.5)
    for _ in range(ROUNDS):
        positive = np.bincount(feature, weights=chance[row], minlength=N_WEIGHTS)
        negative = total - positive
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = np.log((positive + SMOOTH * share) / (positive.sum() + SMOOTH)) - np.log((negative + SMOOTH * share) / (negative.sum() + SMOOTH))
        weights = np.where(seen, np.clip(odds, -CLIP, CLIP), 0.0)
        weights[-1] = np.log(prior / (1 - prior))
        # a passage's score, as in Passages.scores
        score = np.bincount(row, weights=weights[feature], minlength=base) + weights[-1]
        chance = np.where(trusted, 1.0, 1 / (1 + np.exp(-np.clip(score, -50, 50))))
    return weights


def record_scores(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, score): the strongest passage's log odds of each record with visible text."""
    kind = df.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = Passages(part.column(1).to_pylist(), part.column(2).to_pylist())
                if not len(p.owner):
                    continue
                best = np.full(part.num_rows, -np.inf)
                np.maximum.at(best, p.owner, p.scores(table))
                keep = np.flatnonzero(best > -np.inf)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(best[keep])], ["id", "score"])

    return df.select("id", "markdown", "status_code").mapInArrow(run, f"id {kind}, score double")


def residue_records(df: DataFrame, fit_records: int = FIT_RECORDS) -> DataFrame:
    """(id, score) of records that hold residue or a notice in place of content.

    df: id, markdown, status_code. The model is fitted on about ``fit_records`` records (all, where
    there are fewer), chosen by a hash of the id; every record is scored. Null, empty and blank
    texts hold nothing and are not reported; repeated rows are each judged; without any trusted
    passage nothing is reported. Further columns are ignored.
    """
    rows = df.where("markdown is not null").select("id", "markdown", F.col("status_code").cast("int").alias("status_code"))
    n = rows.count()
    if n == 0:
        return rows.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    chosen = rows if n <= fit_records else rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < fit_records)
    table = chosen.select("markdown", "status_code").toArrow()
    sample = [Passages(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in table.to_batches(max_chunksize=2000)]
    return record_scores(rows, fit(sample)).where(F.col("score") >= DECIDE)


def without_residue(df: DataFrame, **kw) -> DataFrame:
    """``df`` without the records that ``residue_records`` reports; all columns stay. Rows with a
    null id are kept."""
    found = materialize(residue_records(df, **kw).select(F.col("id").alias("ws_id")).distinct(), "p6-found")
    return df.join(found, F.col("id") == F.col("ws_id"), "left_anti")
