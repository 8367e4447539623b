import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webspark.functions import urls

BASE = urls.parse_url("https://h.example/a/b?x=1#f")


@pytest.mark.parametrize(
    "raw, href",
    [
        ("c", "https://h.example/a/c"), ("/c", "https://h.example/c"), ("?q", "https://h.example/a/b?q"), ("#z", "https://h.example/a/b?x=1#z"),
        ("../x/./y", "https://h.example/x/y"), ("//o.test/p", "https://o.test/p"), ("", "https://h.example/a/b?x=1"), ("https:x", "https://h.example/a/x"),
        ("HTTP://WWW.Ex.COM:80/A/../B?é=ü#F", "http://www.ex.com/B?%C3%A9=%C3%BC#F"), ("http://bücher.de/ä", "http://xn--bcher-kva.de/%C3%A4"), ("http://h/a|b", "http://h/a|b"),
        (" https://h.example\n/p ", "https://h.example/p"), ("https://h?x", "https://h/?x"), ("..", "https://h.example/"), ("https://u:p@h.example:8443/x?", "https://h.example:8443/x?"),
        ("mailto:a@b", None), ("http://h:99999/", None), ("http://a b/", None),
    ],
)
def test_resolving_after_the_standard(raw, href):
    url = urls.parse_url(raw, BASE)
    assert (url and url.href) == href


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_normal_form_is_stable(raw):
    url = urls.parse_url("https://h.example/" + raw)
    assert url is not None and urls.parse_url(url.href).href == url.href


def test_columns(spark):
    rows = [("HTTPS://User@Www.H.example:443/A/b/?q#f",), ("http://h.example",), ("http://h.example:8080/x/#",), ('"https://h.example/"',), ("mailto:x@y",), (None,), ("",)]
    u = F.col("u")
    got = spark.createDataFrame(rows, "u string").select(urls.is_http(u), urls.origin(u), urls.url_key(u), urls.discovery_form(u), urls.dedupe_key(u)).collect()
    assert [tuple(r) for r in got[:3]] == [
        (True, "https://www.h.example", "www.h.example/A/b?q", "https://www.h.example/A/b/?q", "HTTPS://User@Www.H.example:443/A/b/#f"),
        (True, "http://h.example", "h.example/", "http://h.example/", "http://h.example"),
        (True, "http://h.example:8080", "h.example/x", "http://h.example:8080/x", "http://h.example:8080/x/#"),
    ]
    assert all(not r[0] and r[1] is None and r[2] is None for r in got[3:])


def test_resolve_keeps_plain_addresses_out_of_python(spark):
    df = spark.createDataFrame([("https://a.example/x?y=1#z", None), ("/p é", "https://a.example/q"), ("javascript:x", "https://a.example/"), (None, None)], "v string, b string")
    assert [r[0] for r in df.select(urls.resolve(F.col("v"), F.col("b"))).collect()] == ["https://a.example/x?y=1#z", "https://a.example/p%20%C3%A9", None, None]


def test_globs(spark):
    df = spark.createDataFrame([("/blog/a",), ("/blog",), ("/x.y",), ("/xzy",)], "p string")
    keep = lambda **kw: [r[0] for r in df.where(urls.passes_globs(F.col("p"), **kw)).collect()]
    assert keep(include=["/blog/*"]) == ["/blog/a"]
    assert keep(exclude=["/x.y", "/blog*"]) == ["/xzy"]
    assert keep() == ["/blog/a", "/blog", "/x.y", "/xzy"]
