import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from webspark.llm import encode  # noqa: E402


@pytest.fixture(scope="module")
def both():
    path = encode.vocabulary_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return encode.Encoder(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(both):
    mine, public = both

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80))
    def check(text):
        ids = mine.encode(text)
        assert ids == public.encode_ordinary(text) and mine.decode(ids) == text

    check()
    for text in ("<|endoftext|> is text", "a" * 5000, "  \r\n\t x", "😀é𝔘\u0000"):
        assert mine.encode(text) == public.encode_ordinary(text)
    assert mine.encode(None) == mine.encode("") == []


def test_column(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 100_000, 5), (3, "again", 5)], "doc_id bigint, text string, ids int")
    got = [(r.doc_id, len(r.ids)) for r in encode.encode_texts(df).select("doc_id", "ids").collect()]
    assert got[:2] == [(1, 0), (2, 0)] and got[2][1] >= 100_000
    n = [r.n_tokens for r in encode.count_tokens(df).collect()]
    assert n == [g[1] for g in got]
    back = [r.text for r in encode.decode_ids(encode.encode_texts(df)).collect()]
    assert back == ["", "", "word " * 100_000, "again"]
    assert encode.encode_texts(df.where("false")).count() == 0
