"""Problem 7: encoding the whole corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised straight from the rank file: each token's bytes are mapped
to printable characters, its score is its negative rank, and normalisation is the identity. Texts
are cut into pre-tokens by the vocabulary's pattern; each pre-token, byte-mapped, is encoded by
that model, whose piece ids are the ranks. Decoding is the inverse mapping. Nothing is trained.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank files this operator takes, by name.
RANK_FILES = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
#: Distinct pre-tokens a worker remembers; beyond that it starts anew (memory only, no effect on ids).
CACHE_ENTRIES = 200_000
#: Characters whose pre-tokens are held at once, beyond a single text.
PART_CHARACTERS = 2_000_000


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """The place of a rank file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(RANK_FILES[name])


@lru_cache(1)
def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others take
    the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model file: pieces in rank order, then the unknown piece.

    Field numbers are those of the public sentencepiece_model.proto: pieces 1 (piece 1, score 2,
    type 3), trainer_spec 2 (model_type 3, vocab_size 4, unk/bos/eos/pad ids 40 to 43),
    normalizer_spec 3 (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    chars = byte_characters()
    ordered = sorted(ranks.items(), key=lambda item: item[1])
    if [r for _, r in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0..n-1")
    pieces = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in ordered]
    pieces.append(_field(1, _field(1, "\u2047".encode()) + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ordered)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Text to ids and back for one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda item: item[1])]
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.cache: dict[str, list[int]] = {}

    def encode_all(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text the ids of its pre-tokens. All pre-tokens a batch brings anew go to the model
        in one call."""
        find, cache = self.find, self.cache
        words = [find(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in cache]
        if new:
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
                new = list(dict.fromkeys(chain.from_iterable(words)))
            mapped = [w.encode().decode("latin-1").translate(self.table) for w in new]
            cache.update(zip(new, self.model.encode(mapped, num_threads=1)))
        get = cache.__getitem__
        return [list(map(get, ws)) for ws in words]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text; null and empty give an empty list. Strings of special tokens are
        ordinary text."""
        return list(chain.from_iterable(self.encode_all([text])[0]))

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids; inverse of encode for every text."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace") if ids is not None and len(ids) else ""


@lru_cache(4)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _settings(vocabulary: str, path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or vocabulary_path(vocabulary), pattern or public_tokenizers.PATTERN


def _in_parts(encoder: Encoder, texts: list[str | None]) -> Iterator[list[list[int]]]:
    """The batch's texts, some million characters at a time."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t) if t else 0
        if size > PART_CHARACTERS:
            yield from encoder.encode_all(part)
            part, size = [], 0
    yield from encoder.encode_all(part)


def encode_texts(df: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k", path: str | None = None, pattern: str | None = None, out: str = "ids") -> DataFrame:
    """``df`` with a column of token ids; null and empty texts give an empty list.

    A narrow map over Arrow batches: no shuffle, whole texts whatever their length. ``path``
    is the rank file on the workers (default: that of the installed package); an existing column
    of the name ``out`` is replaced.
    """
    where = _settings(vocabulary, path, pattern)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(*where)
        for texts in batches:
            ids = [list(chain.from_iterable(w)) for w in _in_parts(encoder, texts.to_pylist())]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, count=int(ends[-1])))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return df.withColumn(out, encode(F.col(text_col)))


def count_tokens(df: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k", path: str | None = None, pattern: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text (0 for null and empty), without moving the ids."""
    where = _settings(vocabulary, path, pattern)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(*where)
        for texts in batches:
            yield pa.array([sum(map(len, w)) for w in _in_parts(encoder, texts.to_pylist())], pa.int64())

    return df.withColumn(out, count(F.col(text_col)))


def decode_ids(df: DataFrame, ids_col: str = "ids", vocabulary: str = "byte_bpe_50k", path: str | None = None, out: str = "text") -> DataFrame:
    """``df`` with the text of a column of ids; null and empty lists give the empty text."""
    where = _settings(vocabulary, path, None)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(*where)
        for ids in batches:
            yield pd.Series([encoder.decode(i) for i in ids], index=ids.index, dtype=object)

    return df.withColumn(out, decode(F.col(ids_col)))
