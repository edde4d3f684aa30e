"""Selectors, subtrees and columns of nodes against a look at each node's ancestors."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagegrain.functions import css
from pagegrain.functions.page import node_rows
from pagegrain.operators import documents, markup, views

SELECTORS = ["a", "div a", "div > a", "ul li a", ".x", "li.x > a.y", "#m .x a", "div div div", "[href]", "ul[class=x] > li a, p", "*", "li *", "a a", "html body .y", "[class] > [id]", "ul > li > ul > li"]


def random_page(rng):
    out, open_tags = [], []
    for _ in range(rng.randint(0, 60)):
        if open_tags and rng.random() < 0.4:
            out.append(f"</{open_tags.pop()}>")
            continue
        tag = rng.choice(["div", "ul", "li", "a", "p", "span", "section"])
        attrs = rng.choice(["", ' class="x"', ' class="y  x"', ' class="xy"', ' id="m"', ' href="/q"', ' class="\ty" id="n"'])
        out.append(f"<{tag}{attrs}>" + rng.choice(["", "word ", "&amp;", "<!--c-->"]))
        open_tags.append(tag)
    return "".join(out)


def matches(rows, n, parts):
    combinator, simples = parts[-1]
    if n["kind"] != "element":
        return False
    attrs = {a["name"]: a["value"] for a in n["attrs"]}
    for kind, name, value in simples:
        fits = {"tag": n["name"] == name, "cls": name in attrs.get("class", "").split(), "id": attrs.get("id") == name, "attr": name in attrs and value in (None, attrs[name])}[kind]
        if not fits:
            return False
    if len(parts) == 1:
        return True
    up = n["parent"]
    while up >= 0:
        if matches(rows, rows[up], parts[:-1]):
            return True
        up = -1 if combinator == ">" else rows[up]["parent"]
    return False


def wanted(html, selectors, scope=None):
    rows = node_rows(html)
    found = lambda s: [n for n in rows if any(matches(rows, n, c.parts) for c in css.parse_query(s))]
    out = found(selectors)
    if scope is not None:
        root = next(iter(found(scope)), None)
        out = [n for n in out if root is not None and root["id"] < n["id"] <= root["last"]]
    return [n["id"] for n in out]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(i, "http://h/", random_page(rng)) for i in range(80)] + [(900, "http://h/", None), (901, "http://h/", "")]
    return rows, documents.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()


def test_selectors_equal_a_walk_up_the_ancestors(pages):
    rows, df = pages
    made = df.select("page_id", *[markup.selected_ids(F.col("nodes"), s).alias(f"s{k}") for k, s in enumerate(SELECTORS)], *[markup.selected_ids(F.col("nodes"), s, "li.x, div").alias(f"t{k}") for k, s in enumerate(SELECTORS)])
    got, html, some = {r.page_id: r for r in made.collect()}, {i: h for i, _, h in rows}, 0
    for i, r in got.items():
        for k, s in enumerate(SELECTORS):
            assert r[f"s{k}"] == wanted(html[i], s), (i, s)
            assert r[f"t{k}"] == wanted(html[i], s, "li.x, div"), (i, s)
            some += len(r[f"s{k}"])
    assert some > 1000


def test_subtrees_and_flags(pages):
    _, df = pages
    for r in df.select("nodes", F.transform("nodes", lambda n: documents.text_content(F.col("nodes"), n)).alias("texts"), F.transform("nodes", lambda n: F.size(documents.below(F.col("nodes"), n))).alias("sizes")).collect():
        for n, text, size in zip(r.nodes, r.texts, r.sizes, strict=True):
            under = [m for m in r.nodes if n.id < m.id <= n.last]
            assert size == len(under)
            assert text == (n.text if n.kind in ("text", "comment") else "".join(m.text for m in under if m.kind == "text"))
            assert n.sectioned == any(m.name in ("article", "aside", "main", "nav", "section") for m in r.nodes if m.id < n.id <= m.last)


def test_a_closed_details_element():
    rows = node_rows("<details>a<summary>s</summary><summary>t</summary></details><details open><p>q</p></details>")
    told = {(n["name"] or n["text"]): (n["unpainted"], n["shown"]) for n in rows}
    assert told["a"] == (True, False) and told["s"] == (False, True) and told["t"] == (False, False) and told["q"] == (False, True)


def test_long_pages_take_time_in_proportion(spark):
    def seconds(n):
        html = "<ul class='x'>" + "".join(f"<li class='a b'><div><a href='/p{i}'>link {i} <b>t</b></a></div></li>" for i in range(n)) + "</ul>"
        df = documents.parse_pages(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")).cache()
        df.count()
        began = time.perf_counter()
        assert markup.select(df, "ul.x li > div a", "page_id").agg(F.count("outer_html"), F.sum(F.length("inner_html"))).first()[0] == n
        assert views.links(df, "page_id").agg(F.count("text")).first()[0] == n
        return time.perf_counter() - began

    seconds(500)
    few, many = min(seconds(2000) for _ in range(2)), seconds(20_000)
    assert many < 25 * max(few, 0.4)
