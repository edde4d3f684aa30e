import json
import random

import pytest
from pyspark.sql import functions as F

from pagegrain.functions.html import flatten, parse
from pagegrain.functions.page import node_rows
from pagegrain.operators import markup, views
from pagegrain.operators.documents import parse_pages


def shape(html):
    def one(n):
        return "".join(f"<{c.name}>{one(c)}</{c.name}>" if c.kind == "element" else c.text if c.kind == "text" else "" for c in n.children)

    return one(parse(html)).removeprefix("<html><head></head><body>").removesuffix("</body></html>")


@pytest.mark.parametrize(
    ("html", "tree"),
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<table><tr><td>1<td>2</table>x", "<table><tbody><tr><td>1</td><td>2</td></tr></tbody></table>x"),
        ("<table>foo<tr><td>1</table>", "foo<table><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<p><b>x<br><p>y", "<p><b>x<br></br></b></p><p><b>y</b></p>"),
        ("<a href=1>x<a href=2>y", "<a>x</a><a>y</a>"),
        ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
        ("<noscript><p>q</p></noscript>x", ""),
        ("a &amp; b &lt; c &unknown; &copy", "a & b < c &unknown; ©"),
        ("<div>x</span></div>y", "<div>x</div>y"),
        ("text < 3", "text < 3"),
    ],
)
def test_tree(html, tree):
    if "noscript" in html:
        assert all(n["name"] != "p" for n in node_rows(html))
    else:
        assert shape(html) == tree


def found(html, *names):
    return [n for n in node_rows(html) if n["name"] in names]


def told(spark, pages, *columns):
    """What expressions over nodes say of some pages, in their order."""
    df = parse_pages(spark.createDataFrame(list(enumerate(pages)), "k int, html string"))
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def test_attributes():
    (p,) = found('<p CLASS=a class=b x y="1&amp;2" z=\'q\' href="?a=1&copy=2">', "p")
    assert {a["name"]: a["value"] for a in p["attrs"]} == {"class": "a", "x": "", "y": "1&2", "z": "q", "href": "?a=1&copy=2"}


def test_raw_text_and_templates():
    html = '<title>a &amp; b</title><script>var a="</p>&amp;";</script><template><a href=x>t</a></template><p>z'
    rows = node_rows(html)
    below = lambda n: "".join(r["text"] for r in rows[n["id"] + 1 : n["last"] + 1] if r["kind"] == "text")
    assert [below(n) for n in found(html, "title", "script")] == ["a & b", 'var a="</p>&amp;";'] and found(html, "a") == []


def test_preorder_bounds():
    rows = flatten(parse("<div><p>a</p><p>b</p></div><i>c</i>"))
    for me, parent, last, *_ in rows:
        below = {r[0] for r in rows if r[0] > me and r[0] <= last}
        assert all(parent < me for _ in [0]) and all(rows[b][1] >= me for b in below)


def test_parse_serialise_parse_is_stable(spark):
    rng = random.Random(1)
    tags = ["p", "b", "i", "div", "ul", "li", "table", "tr", "td", "a", "h1", "span", "br", "select", "option"]
    pages = ["".join(rng.choice(["<{}>", "</{}>", "t{} ", "&amp;{}"]).format(rng.choice(tags)) for _ in range(25)) for _ in range(200)]
    whole = markup.outer_html(F.col("nodes"), F.col("nodes")[0])
    once = [h for (h,) in told(spark, pages, whole) if "<table" not in h and "<a>" not in h]  # nested anchors and moved rows may settle in a second pass
    assert len(once) > 20 and [h for (h,) in told(spark, once, whole)] == once


ODD = [None, "", " ", "<", "</", "<!", "<!--", "<p", '<p a="', "&#x110000;", "\0", "<b>" * 3000, "</p>" * 100, "<table>" * 200, "<div>" * 5000 + "x"]


def test_odd_input(spark):
    for html in ODD:
        assert found(html, "html") and found(html, "body")
    got = told(spark, ODD, markup.text_of(F.col("nodes")), F.length(markup.dom_of(F.col("nodes"))))
    assert [t for t, _ in got][-1] == "x" and all(n > 0 for _, n in got)


def test_text_view(spark):
    pages = [
        "<title>T</title><p>a  b</p><div>c<br>d <i>e</i></div><pre> x\n y </pre><script>no</script>",
        "<details><summary>S</summary>hid</details><video>no</video><canvas>no</canvas>z", "a \u3000b", "<p>a</p> <p> b</p>c<pre>d\n</pre>e<pre>\n f<br>g</pre>", "<i>a</i> <b>b</b><i>c</i>",
    ]
    assert [t for (t,) in told(spark, pages, markup.text_of(F.col("nodes")))] == ["a b\nc\nd e\n x\n y", "Sz", "a b", "a\nb\nc\nd\ne\n f\ng", "a bc"]


def test_signals(spark):
    pages = ["<nav>x</nav><header>y</header><div hidden>z</div>", "<section><header>y</header></section>", "<img alt=' '><img alt=x>", "<details><p>no</details><video>v</video>"]
    assert told(spark, pages, *markup.signals_of(F.col("nodes"))) == [(False, False), (True, False), (False, True), (False, False)]


def test_dom_is_nested_json(spark):
    html = '<!doctype html><p a="1" b=\'"\'>x<!--c--><b>y</b>z'
    (dom,) = [json.loads(d) for (d,) in told(spark, [html], markup.dom_of(F.col("nodes")))]
    body = dom[1]["children"][1]["children"]
    assert dom[0] == {"type": "doctype"} and body == [{"type": "element", "name": "p", "attrs": {"a": "1", "b": '"'}, "children": [{"type": "text", "value": "x"}, {"type": "comment", "value": "c"}, {"type": "element", "name": "b", "attrs": {}, "children": [{"type": "text", "value": "y"}]}, {"type": "text", "value": "z"}]}]


def test_selectors(spark):
    html = "<div class='a b' id=i><p class=b>1<b x=1>2</b></p><span><p>3</p></span></div><p>4</p>"
    inner = lambda s, scope=None: F.transform(markup.selected(F.col("nodes"), s, scope), lambda n: markup.inner_html(F.col("nodes"), n))
    cases = [("p", None), ("div > p", None), (".a p, b[x=1]", None), ("#i.b p.b", None), ("[x]", "span"), ("p", "span"), ("*", "p")]
    (got,) = told(spark, [html], *(inner(s, scope) for s, scope in cases))
    assert list(map(list, got)) == [['1<b x="1">2</b>', "3", "4"], ['1<b x="1">2</b>'], ['1<b x="1">2</b>', "2", "3"], ['1<b x="1">2</b>'], [], ["3"], ["2"]]


def test_roles(spark):
    html = "<nav aria-label=Main><a href=x>Home <img alt=pic></a><a>no</a></nav><h2 aria-level=4>T</h2><section><header>h</header></section><footer role=Banner>f</footer>"
    df = parse_pages(spark.createDataFrame([(1, html)], "k int, html string"))
    got = [(r.role, r.name, r.level) for r in views.roles(df, "k").orderBy("id").collect()]
    assert got == [("navigation", "Main", None), ("link", "Home", None), ("img", "pic", None), ("heading", "T", 4), ("sectionheader", None, None), ("banner", None, None)]
