import gzip

import pytest

from pagegrain.functions.charsets import decode_bytes, declared_charset, inflate_bytes, sniffed_charset
from pagegrain.functions.urls import decode_data, join_url, parse_url, referer


@pytest.mark.parametrize(
    ("base", "href", "joined"),
    [
        ("http://a.com/x/y?z", "../q", "http://a.com/q"),
        ("http://a.com", "b c?d e#f g", "http://a.com/b%20c?d%20e#f%20g"),
        ("HTTP://EXAMPLE.com:80/a/./b/../c", "", "http://example.com/a/c"),
        ("http://a.com/", "//b.org/x", "http://b.org/x"),
        ("https://a.com/x?y", "#f", "https://a.com/x?y#f"),
        ("file:///a/b.html", "c.html", "file:///a/c.html"),
        ("http://a.com/", "mailto:x@y", "mailto:x@y"),
        ("http://a.com/", "http:foo", "http://a.com/foo"),
        ("http://1.2.3/", "", "http://1.2.0.3/"),
        ("http://[::1]:8080/x", "y", "http://[::1]:8080/y"),
        ("not a url", "x y", "x y"),
        (None, "x", "x"),
        ("http://a.com/", "http://bad host/", "http://bad host/"),
        ("http://a.com/a/b", "\\c\\d", "http://a.com/c/d"),
        ("http://a.com/", " \n/x\ty ", "http://a.com/xy"),
    ],
)
def test_join(base, href, joined):
    assert join_url(base, href) == joined


@pytest.mark.parametrize("bad", ["", "x", "http://", "http://a b/", "http://a:99999/", "http://[1/", "http://256.256.256.256/"])
def test_failures(bad):
    assert parse_url(bad) is None


def test_referer():
    import pandas as pd

    rows = [("https://u:p@a.com/x#f", "https://a.com/y"), ("https://a.com/x", "https://b.com/"), ("https://a.com/", "http://a.com/"), (None, "https://a.com/")]
    got = referer.plain(pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows])).tolist()
    assert got == ["https://a.com/x", "https://a.com/", None, None]


def test_data_urls():
    assert decode_data("data:,a%20b") == ("text/plain;charset=US-ASCII", "a b", None)
    assert decode_data("data:text/html;base64, SG k=")[1] == "Hi"
    assert decode_data("data:x")[2] and decode_data("data:;base64,A")[2] and decode_data("http://x")[0] is None


def test_charsets():
    assert declared_charset('text/html; Charset="KOI8-R" ;x') == "KOI8-R" and declared_charset("text/html;charset=") is None
    assert sniffed_charset(b"<meta charset='latin1'>") == "latin1" and sniffed_charset(b" " * 1100 + b"charset=x") is None
    assert decode_bytes(b"\xe9\x81", "a/b;charset=latin1") == ("é\x81", "windows-1252")
    assert decode_bytes(b"\xef\xbb\xbfx", "a/b;charset=koi8-r") == ("x", "utf-8")
    assert decode_bytes(b"\xff", "a/b;charset=nope") == ("�", "utf-8")
    assert decode_bytes(None) == (None, None)


def test_inflate():
    packed = gzip.compress(b"ab") + gzip.compress(b"cd")
    assert inflate_bytes(packed, " GZIP ") == (b"abcd", None)
    assert inflate_bytes(packed[:-4], "gzip")[1] and inflate_bytes(b"x", "br")[1] and inflate_bytes(b"x", "zstd") == (b"x", None)


def test_plain_addresses_are_parted_as_the_helper_parts_them(spark):
    """Expressions and helper agree on plain addresses and on those that only look plain; most real ones are plain."""
    import random

    from pyspark.sql import functions as F

    from pagegrain.functions import urls

    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    hosts = ["a.com", "www.a-b.co.uk", "x1.example.org", "A.com", "a..com", "a.1", "1.2.3.4", "xn--nxasmq6b.com", "a.xn--p1ai", "localhost", "-a.com", "a-.com", "a_b.com", "a.com:80", "a.com:8080", "u:p@a.com", "é.com", "a.c0m", "0x1.com", "com"]
    paths = ["", "/", "/a/b", "/a/./b", "/a/../b", "/..", "/a..b/.c", "//x", "/a b", "/%41", "/a,b~c-d_e", "/é", "?q=1", "/?q=a&b=c", "/?", "/a?", "/a?x y", "/a#f", "/a/b?x=1#f", "/a#f/../g", "/#", "/a;b", "/x/?a=/./b", "\\a", "/a/.", "/A.Z", "/a\n", "\n"]
    rows = [(pick("http://", "https://", "https://", "ftp://", "HTTP://", "http:", "//", "") + pick(*hosts) + pick(*paths), pick("http://", "https://", "", "/", "/", "") + pick(*hosts, "", "", "") + pick(*paths)) for _ in range(6000)] + [(None, "x"), ("http://a.com/b", None), ("", "")]
    df = spark.createDataFrame(rows, "base string, href string").repartition(3)
    got = df.select("base", "href", urls.url_parse(F.col("base")).alias("p"), urls.resolve(F.col("base"), F.col("href")).alias("r"), urls.join_or_null(F.col("base"), F.col("href")).alias("j"), urls._is_plain(F.col("base")).alias("plain")).collect()
    for r in got:
        assert tuple(r.p) == urls._parts(r.base), r.base
        assert r.r == urls.join_url(r.base, r.href), (r.base, r.href)
        b = urls.parse_url(r.base)
        u = urls.parse_url(r.href, b) if b is not None else None
        assert r.j == (None if u is None else str(u)), (r.base, r.href)
    assert 100 < sum(r.plain for r in got) < 3000
    real = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(urls._is_plain(F.col("url")).alias("plain"))
    assert real.filter("not plain").count() <= 0.05 * real.count()
