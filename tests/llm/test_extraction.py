import pytest
from pyspark.sql import functions as F

from pagegrain.llm import extraction as e
from pagegrain.storage import stash


def tree_of(html):
    return e.PageTree(html).top


def text(html):
    page = e.PageTree(html)
    return e.main_text(page.up, page.bits, page.texts, None, None)[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<nav>m</nav><article><h1>T &amp; x</h1><p><b>foo<br><p>b<i>a</i>r</article><footer>f</footer>", "T & x foo bar"),
        ("<article><p>a</p><div class='ad-box'>x</div><aside>y</aside><form>z</form><section id=comments>w</section><p>b</article>", "a b"),
        ("<body><header>h</header><div class=sidebar>s</div><p>only\n body&nbsp;text</p><div role=alert>n</div>", "only body text"),
        ("<main><article>one</article><article>two</article></main><article>three</article>", "one two"),
        ("<article>real</article><article class=comment>no</article>", "real"),
        ("<article><header><h1>Head</h1></header>x<script>y</script>z<p hidden>q</article>", "Head xz"),
        ("<article><p class=adventure>in</p><p class='addition'>side</p></article>", "in side"),
        ("<body><div id=header>h</div><div id=main><p>a</p><ins class=adsbygoogle>x</ins></div>", "a"),
        ("<article><div class=header>kept</div>a</article>", "kept a"),
        (None, ""),
        ("", ""),
    ],
)
def test_main_text(html, want):
    assert text(html) == want


def best(a, b):
    """The size of the largest matching, by trying all order-preserving pairings of children."""
    if a.label != b.label:
        return 0

    def pair(x, y):
        if not x or not y:
            return 0
        return max(pair(x[1:], y), pair(x, y[1:]), best(x[0], y[0]) + pair(x[1:], y[1:]) if x[0].label == y[0].label else 0)

    return 1 + (a.label == "#" and a.text == b.text) + pair(a.children, b.children)


def test_matching_is_largest():
    import random

    rng = random.Random(6)
    for _ in range(60):
        make = lambda: tree_of("".join(rng.choice(["<p>", "<div>", "</div>", "<b>x</b>", "y", "z"]) for _ in range(7)))
        a, b = make(), make()
        assert e.weight(a, b) == best(a, b)
        pairs = e.align(a, b)
        assert all(p.label == q.label for p, q in pairs) and sum(1 + (p.label == "#" and p.text == q.text) for p, q in pairs) == best(a, b)


def test_wrappers_decide(spark):
    """Hosts whose pages have no article: the slot that varies is the content, constant blocks are template."""
    story = lambda k: f"<h2>Summary</h2><p>Story {k} of {'abcdefgh'[k % 8] * 5} told at some greater length than the notice of the hour</p><p>Subscribe to us</p><p>By <b>{k}</b></p>"
    page = lambda k: f"<div><p>Share this now</p><p>It is {k} o'clock</p></div><div id=x><div>{story(k)}</div></div><div>All rights</div>"
    rows = [(k, f"http://A.example/{k}", page(k)) for k in range(8)] + [(20 + k, "http://few.example/", page(k)) for k in range(2)]
    rows += [(30 + k, "http://copies.example/", page(1)) for k in range(9)] + [(40, None, page(1)), (41, "http://a.example/x", None), (None, "http://a.example/y", "")]
    rows += [(50 + k, "http://art.example/", f"<article><p>one promo</p></article><article>{story(k)}</article>") for k in range(5)]
    pages = spark.createDataFrame([(*r, "mine", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r for r in e.main_texts(pages).collect()}
    told = lambda k: f"Summary Story {k} of {'abcdefgh'[k] * 5} told at some greater length than the notice of the hour By {k}"
    assert [got[k].text for k in range(8)] == [told(k) for k in range(8)] and got[3].n_chars == len(told(3)) and got[3].n_template == 1
    whole = lambda k: f"Share this now It is {k} o'clock {told(k).replace(' By', ' Subscribe to us By')} All rights"
    assert got[20].text == whole(0) and got[30].text == got[40].text == whole(1)
    assert got[50].text == told(0).replace(" By", " Subscribe to us By") and got[41].text == got[None].text == ""
    assert {r.host for r in got.values()} == {1} and set(got[1].asDict()) == {"page_id", "url", "host", "text", "n_chars", "n_template"}
    assert e.main_texts(pages.limit(0)).count() == 0


def test_references_beyond_broadcast_give_the_same(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("salt", F.lit("mine"))
    want = {r.page_id: r for r in e.main_texts(pages).collect()}
    monkeypatch.setattr(e, "BROADCAST_BYTES", 0)
    got = {r.page_id: r for r in e.main_texts(pages).collect()}
    assert got == want and {r.salt for r in got.values()} == {"mine"}


def test_every_page_of_a_host_is_read_through_its_wrapper(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("url", F.lit("http://one.example/"))
    refs = e.references(pages)
    aligned = stash(e.align_pages(pages, refs), "aligned")
    wrapper = e.induce_wrappers(aligned, refs).first()
    page = e.PageTree(refs.first().html)
    assert [page.trees[i].label for i in wrapper.content] == ["article"] and wrapper.n_pages > 200
    mapped = aligned.filter(F.array_contains("ref", wrapper.content[0]))
    assert mapped.count() == aligned.count()


def test_classes_say_so_with_whole_words_only():
    html = "<article><p class='search-results'>a</p><section id='related-work'>b</section><p id=share-price>c</p><div class='widget-factory'>d</div><p class=Ad>x</p><p>end</p></article>"
    assert text(html) == "a b c d end"
    assert text("<div class='menu-page'><article>kept</article></div>") == "kept" == text("<div class='comments-off'><article>kept</article></div>")
    assert text("<article><figure><figcaption>f</figcaption></figure><label>l</label></article>") == "f l"
    assert text("<article><b>a</b> <i>b</i><p>c\n\td</p></article>") == "a b c d"


def test_very_deep_and_very_long_pages():
    deep = lambda k: "<div>" * 20_000 + f"same<p>{k}</p>"
    a, b = e.PageTree(deep("x")), e.PageTree(deep("y"))
    assert len(e.align(a.top, b.top)) > 20_000 and text(deep("x")) == "same x"
    assert text("<article>" + "<p>word word</p>" * 50_000 + "</article>") == "word word " * 49_999 + "word word"


def test_long_lists_align_by_equal_subtrees(monkeypatch):
    page = lambda k: tree_of("".join(f"<p>{'same' if i % 3 else k} {i}</p>" for i in range(1500)))
    found = [(p, q) for p, q in e.align(page("a"), page("b")) if p.text and p.text == q.text]
    assert sorted(p.text for p, q in found) == sorted(f"same {i}" for i in range(1500) if i % 3) and all(p.text == q.text for p, q in found)


def test_long_lists_are_matched_as_short_ones(monkeypatch):
    import random

    rng = random.Random(3)
    for _ in range(60):
        make = lambda: tree_of("".join(rng.choice(["<p>a</p>", "<p>b<b>x</b></p>", f"<p>{rng.random()}<b>x</b></p>", "<hr>", "<div><p>a</p><p>b</p></div>", "<div><p>a</p>c</div>", "t<br>"]) for _ in range(rng.randrange(6))))
        a, b = make(), make()
        want = e.weight(a, b)
        with monkeypatch.context() as m:
            m.setattr(e, "TABLE_CELLS", 1)
            assert e.weight(a, b) == want == best(a, b)
            x, y = a.children, b.children
            nodes = e._preorder(a), e._preorder(b)
            kinds = e.Kinds(e._texts(nodes[0]) & e._texts(nodes[1]))
            kinds.number(nodes[0])
            kinds.number(nodes[1])
            pairs = e._Long(x, y, kinds).pairs() if x and y else []
        at = sorted((x.index(p), y.index(q)) for p, q in pairs)
        assert all(i < k and j < n for (i, j), (k, n) in zip(at, at[1:]))
        assert 1 + sum(e.weight(p, q) for p, q in pairs) == want


def test_long_lists_of_varying_blocks_align():
    block = lambda k, i: f"<div><p>Story {k} {i}</p><p>Read more {i % 7}</p></div>"
    page = lambda k: tree_of("<hr>" + "".join(block(k, i) for i in range(1100)) + ("<hr><p>Late</p>" if k == "a" else "<p>Late</p><hr>"))
    found = [p.text for p, q in e.align(page("a"), page("b")) if p.text and p.text == q.text]
    assert sorted(found) == sorted([f"Read more {i % 7}" for i in range(1100)] + ["Late"])


def test_deep_pages_align():
    page = lambda k: tree_of("<div><i>a</i>" * 450 + f"same<p>{k}</p>")
    assert [p.text for p, q in e.align(page("x"), page("y")) if p.text == q.text].count("same") == 1
    found = [(p.text, q.text) for p, q in e.align(_chain(3000, "x"), _chain(3000, "x")) if p.text]
    assert found == [("x", "x")]


def _chain(depth, text):
    top = e.Tree("#", text, 0)
    for _ in range(depth):
        above = e.Tree("div", "", 0)
        above.children += [e.Tree("hr", "", 0), top]
        top = above
    return top


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='menu'><article><p>Long text here of it</p></article></div>", "Long text here of it"),
        ("<article><p>Take:</p><ul class='menu'><li>2 eggs</li><li>milk</li></ul></article>", "Take: 2 eggs milk"),
        ("<article><p>A <span class='alert'>sharp</span> and <b class='promo'>bold</b> word.</p></article>", "A sharp and bold word."),
        ("<article><p>text</p><div class='reader-comments'><p>nice</p></div><section class='comments-area'>x</section><div id=respond>y</div></article>", "text"),
        ("<article>text<div class=advert-wrapper>buy</div><div class='sponsored-content'>s</div><ul class='main-menu'><li><a href=x>Home</a></ul><div id=gdpr>c</div></article>", "text"),
        ("<article>the long article y</article><main>comment</main>", "the long article y"),
        ("<main>the long text of it</main><article>card</article>", "the long text of it"),
        ("<div class='comments-open'><p>whole text</p></div>", "whole text"),
        ("<article><section><h2>A</h2><p>x <a href=#>edit</a></p></section><section><h2>B</h2><p>y <a href=#>edit</a></p></section><section><h2>C</h2><p>z <a href=#>edit</a></p></section></article>", "A x edit B y edit C z edit"),
        ("<article><p>real</p><div><i>ann</i><p>nice</p><a href=#>Reply</a></div><div><i>bob</i><p>bad</p><a href=#>Reply</a></div><div><i>cid</i><p>so</p><a href=#>Reply</a></div></article>", "real"),
    ],
)
def test_structure_is_held_against_class_words(html, want):
    assert text(html) == want


def test_a_text_that_a_host_shares_stays_in_its_articles(spark):
    rows = [(k, f"http://h.example/{k}", f"<nav>Home</nav><article><p>{'abcdefghij'[k] * 9} is told here at length</p><p>The committee meets every Monday at ten.</p></article>") for k in range(10)]
    got = {r.page_id: r.text for r in e.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{'abcdefghij'[k] * 9} is told here at length The committee meets every Monday at ten." for k in range(10)}


def _planted(rng, host, k):
    """A page without articles or telling class words, and the words of its story and of all else."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrs") for _ in range(7))
    story = [" ".join(word() for _ in range(rng.randint(12, 30))) for _ in range(rng.randint(3, 9))]
    menu = "".join(f"<li><a href=/{i}>section {host} {i}</a></li>" for i in range(6))
    comments = "".join(f"<div><i>{word()}</i><p>{' '.join(word() for _ in range(8))}</p><a href=#>Reply</a></div>" for _ in range(rng.choice([0, 3, 4, 6])))
    advert = f"<p>buy {host} things at the {host} shop now and save a lot</p>"
    body = "".join(f"<p>{p}</p>" for p in story)
    shapes = [
        f"<div><ul>{menu}</ul></div><div>{body}</div><div>{comments}</div><div>{advert}</div><div>all rights of {host}</div>",
        f"<table><tr><td><ul>{menu}</ul></td><td>{body}{advert}{comments}</td></tr></table><p>made by {host}</p>",
        f"<div>{advert}<ul>{menu}</ul></div><section><section>{body}</section><section>{comments}</section></section>",
    ]
    return f"<body>{shapes[host % 3]}</body>", " ".join(story).split()


def test_wrappers_find_planted_stories(spark):
    """Precision and recall over hosts where nothing but the pages' common structure tells stories from menus, adverts and comments."""
    import random
    from collections import Counter

    rng, want, rows = random.Random(8), {}, []
    for host in range(9):
        for k in range(14):
            html, want[host * 100 + k] = _planted(rng, host, k)
            rows.append((host * 100 + k, f"http://h{host}.example/{k}", html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text.split(), r.n_template) for r in e.main_texts(pages).collect()}
    alone = {r.page_id: r.text.split() for r in e.main_texts(pages, min_pages=1000).collect()}
    hit = sum(sum((Counter(got[i][0]) & Counter(w)).values()) for i, w in want.items())
    precision, recall = hit / sum(len(t) for t, _ in got.values()), hit / sum(map(len, want.values()))
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)
    assert sum(got[i][0] != alone[i] for i in want) > len(want) / 2


def test_pages_of_many_differing_posts_align_soon():
    import random
    import time

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    page = lambda posts: e.PageTree("<body>" + "".join("<div>" + "".join(f"<p>{t}</p>" for t in p) + "</div>" for p in posts)).top
    posts = [[word() for _ in range(20)] for _ in range(400)]
    edited = [[t if rng.random() < 0.5 else word() for t in p] for p in posts]
    began = time.perf_counter()
    same = sum(p.label == "#" and p.text == q.text for p, q in e.align(page(posts), page(edited)))
    assert same == sum(t == u for p, q in zip(posts, edited, strict=True) for t, u in zip(p, q, strict=True)) and time.perf_counter() - began < 6
