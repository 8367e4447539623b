"""Problem 5: near-duplicate records with small edits.

Parity-sketch join. A record is the set of its word sequences (shingles). Sequences are hashed into
the parts of a bit sketch by exclusive or, so equal parts cancel and the Hamming distance of two
sketches never exceeds the symmetric difference of the sets. Records of a size band use the same
partitions into parts; two that are alike agree in some parts that hold two sequences or more, and
these parts are the join keys. A single sequence is no key: a common phrase or a line of furniture
says nothing, while two in one part rarely come together by chance. Records on a key that few have
are paired; on a key that many have they are set against each other in blocks, by a second, dense
sketch whose Hamming distance rules out most pairs without loss. What is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.io import materialize

#: Size bands: upper ends grow by 4; a partition of a band has a part for every PER_PART sequences of
#: its largest set, so a part holds 1 to 4 of a text's. Parts are keys up to PARTS of a partition, and
#: there are partitions enough for KEYS parts in all.
FIRST_BAND, BAND_RATIO, PER_PART, PARTS, KEYS = 96, 4, 4, 80, 160
#: Sequences that a part needs to be a key; and the size below which a set has a key for each sequence.
TOGETHER, TINY = 2, 40
#: Bits of the dense sketch.
DENSE_BITS = 1024
#: Texts on a key with no more distinct texts than this are paired there and then.
COMMON = 16
#: Texts of a common key that one task compares with as many others; larger groups are split.
BLOCK = 4096
#: Bytes of text shingled at once (a longer text alone), some 40 bytes of memory for each; and powers of
#: the hash's base that a worker keeps.
SLICE_BYTES, KEPT_POWERS = 2_000_000, 1 << 24
#: Agreeing uncommon keys that a pair needs; two different sets above a similarity of one half
#: share two sequences at least, so the tiny ones do too.
AGREE = 2

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _scramble(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        base = int(_M1) | 1
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[str | None], words: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch: (index of the text, hash), sorted, and each text's number
    of words. Words are runs of letters and digits of the lower-cased text; texts with fewer than
    ``least`` words, null and empty ones have no shingles. Whole texts are used, whatever length."""
    lowered = [t.lower() if t else "" for t in texts]
    # a blank between texts keeps their words apart
    raw = (" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(raw, dtype=np.uint32)
    inside = _alnum()[code]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    n = len(code)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    word = _scramble((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, count=len(lowered))
    text_end = 1 + np.cumsum(lengths)
    owner = np.searchsorted(text_end, start, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    if len(word) < words:
        return np.empty(0, np.int64), np.empty(0, np.uint64), counts
    m = len(word) - words + 1
    h = word[:m].copy()
    for k in range(1, words):
        h = _scramble(h * _M1 + word[k : k + m] + np.uint64(k))
    whole = (owner[:m] == owner[words - 1 :]) & (counts[owner[:m]] >= least)
    doc, h = owner[:m][whole], h[whole]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[first], h[first], counts


def _bounds(doc: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    if not len(doc):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)]


def set_keys(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text with shingles: its index, size and two 64-bit keys of the set."""
    b = _bounds(doc)
    if len(b) == 1:
        e = np.empty(0, np.uint64)
        return np.empty(0, np.int64), np.empty(0, np.int64), e, e
    k1 = _scramble(np.add.reduceat(_scramble(h + _M1), b[:-1]))
    k2 = _scramble(np.add.reduceat(_scramble(h * _M3 + _M2), b[:-1]))
    return doc[b[:-1]], np.diff(b), k1, k2


def _bands(size: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, int]]:
    """(number, member mask, parts of a whole partition) of every band that is met. A text belongs
    to its own band and, when a larger partner may lie in the next one, to that too."""
    upper, k, low = FIRST_BAND, 0, 0
    while len(size) and threshold * low <= size.max():
        member = ((size >= low) & (size < upper)) | ((size < low) & (size >= threshold * low))
        if member.any():
            yield k, member, upper // PER_PART
        low, upper, k = upper, upper * BAND_RATIO, k + 1


def part_keys(doc: np.ndarray, h: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text among those with shingles, key) of every part with TOGETHER shingles or
    more and a parity that isn't zero, and of every shingle of the tiny sets.

    Two sets at a similarity of 0.6 agree in 13 to 29 such parts on average, in more above it.
    """
    b = _bounds(doc)
    size = np.diff(b)
    place = np.repeat(np.arange(len(size)), size)
    tiny = size[place] < TINY
    where, keys = [place[tiny]], [_scramble(_scramble(h[tiny] ^ _M2) + _M3)]
    for k, member, total in _bands(size, threshold):
        inside = member[place]
        p, x = place[inside], h[inside]
        used = min(PARTS, total)
        for way in range(-(-KEYS // used)):
            part = (_scramble(x + np.uint64((97 * k + way + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(total)).astype(np.int64)
            keep = part < used
            spot = p[keep] * PARTS + part[keep]
            order = np.argsort(spot, kind="stable")
            spot, value = spot[order], _scramble(x[keep][order] ^ _M2)
            c = _bounds(spot)
            if len(c) == 1:
                continue
            parity, held, spot = np.bitwise_xor.reduceat(value, c[:-1]), np.diff(c), spot[c[:-1]]
            live = (held >= TOGETHER) & (parity != 0)
            parity, spot = parity[live], spot[live]
            label = ((spot % PARTS) + PARTS * (100 * k + way) + 1).astype(np.uint64)
            where.append(spot // PARTS)
            keys.append(_scramble(parity + _scramble(label * _M1)))
    return np.concatenate(where), np.concatenate(keys)


def dense_sketches(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The parity bits of each text with shingles, one row of DENSE_BITS / 64 numbers each."""
    b = _bounds(doc)
    size = np.diff(b)
    place = np.repeat(np.arange(len(size)), size)
    bit = (_scramble(h ^ _M3) % np.uint64(DENSE_BITS)).astype(np.int64)
    odd = np.bincount(place * DENSE_BITS + bit, minlength=len(size) * DENSE_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(size), DENSE_BITS), axis=1, bitorder="little").view(np.int64)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES of text, one row at least."""
    size = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), float))
    part = (np.cumsum(size) // SLICE_BYTES).astype(np.int64)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
    yield from zip(cuts, cuts[1:])


def _over_texts(make: Callable[[np.ndarray, np.ndarray, pa.Array], pa.RecordBatch | None], words: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _slices(batch.column(1)):
                part = batch.slice(at, end - at)
                doc, h, _ = shingle_sets(part.column(1).to_pylist(), words, least)
                out = make(doc, h, part.column(0))
                if out is not None and out.num_rows:
                    yield out
            if len(_POWERS[0]) > KEPT_POWERS:
                _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    return run


def sketch_table(df: DataFrame, words: int, least: int) -> DataFrame:
    """(id, k1, k2, n, sketch) of every record with enough words; df: id, text."""

    def make(doc: np.ndarray, h: np.ndarray, ids: pa.Array) -> pa.RecordBatch | None:
        which, size, k1, k2 = set_keys(doc, h)
        if not len(which):
            return None
        dense = dense_sketches(doc, h)
        width = dense.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(which) * width + 1, width), pa.int32()), pa.array(dense.reshape(-1)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), _i64(k1), _i64(k2), pa.array(size), lists], ["id", "k1", "k2", "n", "sketch"])

    kind = df.schema[0].dataType.simpleString()
    return df.mapInArrow(_over_texts(make, words, least), f"id {kind}, k1 bigint, k2 bigint, n bigint, sketch array<bigint>")


def key_table(df: DataFrame, words: int, least: int, threshold: float) -> DataFrame:
    """(key, k1): the part keys of every text, copies once per batch."""

    def make(doc: np.ndarray, h: np.ndarray, ids: pa.Array) -> pa.RecordBatch | None:
        _, _, k1, _ = set_keys(doc, h)
        where, keys = part_keys(doc, h, threshold)
        if not len(keys):
            return None
        own = k1[where]
        order = np.lexsort((own, keys))
        keys, own = keys[order], own[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
        return pa.RecordBatch.from_arrays([_i64(keys[first]), _i64(own[first])], ["key", "k1"])

    return df.mapInArrow(_over_texts(make, words, least), "key bigint, k1 bigint")


def _thin(most: int) -> Callable:
    """Map-side combining: one row per key and text, and of a key on more than ``most`` texts only
    most + 1 rows, enough to show that it is common. So no key, however hot, sends a reducer more
    than most + 1 rows per map task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1_000_000:
                yield _combined(held, most)
                held, rows = [], 0
        if held:
            yield _combined(held, most)

    return run


def _sorted_pairs(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
    own = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return key[first], own[first]


def _combined(held: list[pa.RecordBatch], most: int) -> pa.RecordBatch:
    key, own = _sorted_pairs(held)
    b = _bounds(key)
    rank = np.arange(len(key)) - np.repeat(b[:-1], np.diff(b))
    keep = rank <= most
    return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(own[keep])], ["key", "k1"])


def _pairs(most: int) -> Callable:
    """Of one shuffle partition: pairs of texts on the same uncommon key, (a, b, 1), a < b, and for
    each common key one row (key, null, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        key, own = _sorted_pairs(held)
        del held
        b = _bounds(key)
        n = np.diff(b)
        common = key[b[:-1][n > most]]
        yield pa.RecordBatch.from_arrays([pa.array(common), pa.nulls(len(common), pa.int64()), pa.array(np.zeros(len(common), np.int64))], ["a", "b", "c"])
        ok = (n > 1) & (n <= most)
        starts, lengths = b[:-1][ok], n[ok]
        for length in np.unique(lengths):
            at = starts[lengths == length]
            i, j = np.triu_indices(int(length), 1)
            step = max(1, 2_000_000 // len(i))
            for s in range(0, len(at), step):
                rows = at[s : s + step, None]
                a, z = own[rows + i].ravel(), own[rows + j].ravel()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z), pa.array(np.ones(len(a), np.int64))], ["a", "b", "c"])

    return run


def _agreeing(keys: DataFrame, most: int) -> DataFrame:
    thin = keys.mapInArrow(_thin(most), "key bigint, k1 bigint")
    pairs = thin.repartition("key").mapInArrow(_pairs(most), "a bigint, b bigint, c bigint")
    return pairs.groupBy("a", "b").agg(F.sum("c").alias("c"))


def _close(slack: float, threshold: float) -> Callable:
    """Of groups (key, lo, hi, block, k1, n, sketch) whole within a partition: the pairs (a, b),
    a < b, across blocks lo and hi (or within one) that size and dense sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                now = tuple(cell[:, x].tolist())
                if group and now != last:
                    yield from _compared(group, last, slack, threshold)
                    group = []
                last = now
                group.append(batch.slice(x, y - x))
        if group:
            yield from _compared(group, last, slack, threshold)

    return run


def _compared(group: list[pa.RecordBatch], cell: tuple[int, int, int], slack: float, threshold: float) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(group).combine_chunks()
    block, own, n = (rows.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5))
    sketch = rows.column(6).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(own), -1)
    left, right = np.flatnonzero(block == cell[1]), np.flatnonzero(block == cell[2])
    right = right[np.argsort(n[right], kind="stable")]
    left = left[np.argsort(n[left], kind="stable")]
    half = sketch.shape[1] // 2
    for s in range(0, len(left), 64):
        x = left[s : s + 64]
        # sizes too far apart are out; both sides are in order of size
        y = right[np.searchsorted(n[right], threshold * n[x[0]] - 1e-6) : np.searchsorted(n[right], n[x[-1]] / threshold + 1e-6, side="right")]
        if not len(y):
            continue
        # half of the bits rule out most pairs already
        far = np.zeros((len(x), len(y)), np.uint16)
        for w in range(half):
            far += np.bitwise_count(sketch[x, w][:, None] ^ sketch[y, w][None, :])
        near = far <= slack * (n[x][:, None] + n[y][None, :])
        if cell[1] == cell[2]:
            near &= own[x][:, None] < own[y][None, :]
        i, j = np.nonzero(near)
        rest = np.bitwise_count(sketch[x[i], half:] ^ sketch[y[j], half:]).sum(1, dtype=np.int64)
        near = far[i, j] + rest <= slack * (n[x[i]] + n[y[j]])
        i, j = i[near], j[near]
        a, b = own[x[i]], own[y[j]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _on_common(keys: DataFrame, common: DataFrame, texts: DataFrame, slack: float, threshold: float) -> DataFrame:
    """(a, b): the pairs of texts on the same common key that the dense sketches don't rule out.
    keys: key, k1; common: key. Groups of more than BLOCK texts are split into blocks, each pair of
    blocks a group of its own, so that no task holds a whole hot group."""
    held = materialize(keys.join(common, "key", "left_semi").distinct(), "p5-common")
    blocks = held.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = held.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "k1"
    )
    full = cells.join(texts.groupBy("k1").agg(F.min("n").alias("n"), F.any_value("sketch").alias("sketch")), "k1")
    grouped = full.select("key", "lo", "hi", "block", "k1", "n", "sketch").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return grouped.mapInArrow(_close(slack, threshold), "a bigint, b bigint").distinct()


def _hamming(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)


def _set_column(words: int) -> Callable:
    def make(doc: np.ndarray, h: np.ndarray, ids: pa.Array) -> pa.RecordBatch | None:
        which, size, k1, k2 = set_keys(doc, h)
        if not len(which):
            return None
        offsets = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, _i64(h))
        return pa.RecordBatch.from_arrays([_i64(k1), _i64(k2), lists], ["k1", "k2", "s"])

    return make


def class_links(df: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: id, k1, k2 - each record's class of equal shingle sets. links:
    a1, a2, b1, b2, similarity - classes whose Jaccard similarity is ``threshold`` or more.

    Records with fewer than ``least`` words (or fewer than ``words``), null and empty texts belong
    to no class. Repeated rows and copies share a class and are compared once. Pairs agreeing in
    AGREE keys on at most COMMON texts are candidates; a key's rows are thinned before the shuffle, so
    a common key costs a bounded number of rows. All texts on a common key are set against each other
    there, in blocks, by their dense sketches, and one such key is enough; so no link hangs on the
    bound. A pair right at 0.6 shares 13 keys or more on average, so that it has fewer than two in at
    most 2 of 100,000 cases; a threshold far below 0.6 needs more keys.
    """
    docs = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    least = max(least, words)
    members = materialize(sketch_table(docs, words, least), "p5-sketches")
    texts = members.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.any_value("sketch").alias("sketch"))
    texts = materialize(texts, "p5-texts")
    ratio = (1 - threshold) / (1 + threshold) + 1e-9
    keys = key_table(docs, words, least, threshold)
    agree = materialize(_agreeing(keys, COMMON).where((F.col("c") >= (AGREE if threshold > 0.5 else 1)) | F.col("b").isNull()), "p5-agree")
    common = agree.where("b is null").select(F.col("a").alias("key"))
    pairs = agree.where("b is not null").select("a", "b")
    if common.limit(1).count():
        pairs = pairs.unionByName(_on_common(keys, common, texts, ratio, threshold)).distinct()
    a = texts.select(F.col("k1").alias("a"), F.col("k2").alias("a2"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("id").alias("ia"))
    b = texts.select(F.col("k1").alias("b"), F.col("k2").alias("b2"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("id").alias("ib"))
    slack = F.lit(ratio)
    alike = (
        pairs.join(a, "a").join(b, "b")
        .where((F.least("na", "nb") >= F.lit(threshold - 1e-9) * F.greatest("na", "nb")) & (_hamming(F.col("sa"), F.col("sb")) <= slack * (F.col("na") + F.col("nb"))))
        .select("a", "a2", "b", "b2", "na", "nb", "ia", "ib")
    )
    alike = materialize(alike, "p5-alike")
    wanted = alike.select(F.col("ia").alias("id")).union(alike.select("ib")).distinct()
    sets = docs.join(wanted, "id", "left_semi").mapInArrow(_over_texts(_set_column(words), words, least), "k1 bigint, k2 bigint, s array<bigint>").dropDuplicates(["k1", "k2"])
    sets = materialize(sets, "p5-sets")
    shared = F.size(F.array_intersect("s", "t"))
    links = (
        alike.join(sets.select(F.col("k1").alias("a"), F.col("k2").alias("a2"), "s"), ["a", "a2"])
        .join(sets.select(F.col("k1").alias("b"), F.col("k2").alias("b2"), F.col("s").alias("t")), ["b", "b2"])
        .withColumn("similarity", shared / (F.col("na") + F.col("nb") - shared))
        .where(F.col("similarity") >= threshold)
        .select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2", "similarity")
    )
    return members.select("id", "k1", "k2"), materialize(links, "p5-links")


def pairs_found(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two records alike enough, copies expanded."""
    members, links = class_links(df, id_col, text_col, **kw)
    m1 = members.select(F.col("id").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    m2 = members.select(F.col("id").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    across = links.join(m1, ["a1", "a2"]).join(m2, ["b1", "b2"]).select("x", "y")
    inside = m1.join(m2, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b")


def classes(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """(id, class_id, n_links): each record's class of copies (smallest id in it) and the number of
    other classes it is linked to; copies are not expanded into pairs."""
    members, links = class_links(df, id_col, text_col, **kw)
    first = members.groupBy("k1", "k2").agg(F.min("id").alias("class_id"))
    ends = links.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionAll(links.select("b1", "b2"))
    count = ends.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(first, ["k1", "k2"]).join(count, ["k1", "k2"], "left").select("id", "class_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
