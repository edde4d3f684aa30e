import re

import pytest

from pagegrain.llm import decontamination as d
from tests.llm.conftest import CLASHING, EDGE


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            size = min(n, len(b))
            grams = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if size else set()
            for k in range(len(w) - size + 1):
                if size and tuple(w[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    found.add(item)
        out.append((i or -1, len(w), len(hit), ",".join(sorted(str(f) for f in found if f is not None))))
    return sorted(out)


ITEMS = [(10, "One two, three four five six seven eight nine ten eleven"), (2, "Same WORDS here!"), (3, None), (4, ""), (2, "Same WORDS here!"), (None, "漢字"), (5, "same words")]


@pytest.mark.parametrize("most", [1 << 20, 8])
def test_equals_brute_force(spark, docs_of, most):
    docs = [*EDGE, (20, "zero one two three-four FIVE six seven eight nine ten eleven twelve"), (21, "one two three four five six seven eight nine"), (22, "eleven ten one two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    hits = d.find_hits(docs_of(docs, CLASHING).select("doc_id", "text"), bench, broadcast_bytes=most).collect()
    got = sorted((r.doc_id or -1, r.hits.n_words, sum(s.end - s.start for s in r.hits.hit_words), ",".join(sorted(map(str, r.hits["items"])))) for r in hits)
    assert got == brute(docs, ITEMS)


def test_removal(spark, docs_of):
    bench = spark.createDataFrame([(1, "same words here")], "item_id long, text string")
    docs = docs_of([*EDGE, (9, "keep, Same--words here; this")], CLASHING)
    kept = d.decontaminate(docs, bench)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 5, 6] and kept.columns == docs.columns
    cut = {r.doc_id: r.text for r in d.decontaminate(docs, bench, "spans").collect()}
    assert cut[9] == "keep, ; this" and cut[4] == "again" and cut[1] is None and cut[6] == EDGE[7][1]
    assert d.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0 and d.contamination(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        d.decontaminate(docs, bench, "nothing")


def test_every_internal_name_passes_through(spark, docs_of):
    bench = spark.createDataFrame([("q1", "same words here"), ("q2", "same words here"), (None, "漢字")], "item_id string, text string")
    names = ["own", "hits", "_hits", "id", "text_hash", "spans", "items", "size", "hash", "windows", "Near", "k"]
    docs = docs_of(EDGE, [(c, f"mine {c}") for c in names])
    for most in (1 << 20, 0):
        for out in (d.decontaminate(docs, bench, broadcast_bytes=most), d.decontaminate(docs, bench, "spans", broadcast_bytes=most)):
            assert out.columns == docs.columns and all(r[c] == f"mine {c}" for r in out.collect() for c in names)
        got = {r.doc_id: r.n_items for r in d.contamination(docs, bench, broadcast_bytes=most).collect()}
        assert got[4] == 2 and got[6] == 0 and got[1] == 0


def test_many_items_may_share_a_window():
    table = d.WindowSet([(str(k), "the very same question is asked by each of these items") for k in range(16_000)], 10)
    assert [len(o) for o in table.tables[10][2]] == [16_000, 16_000]


@pytest.mark.parametrize("short_bytes", [1 << 20, 0])
def test_one_word_items_through_the_join(spark, docs_of, monkeypatch, short_bytes):
    """A word that is an item and in every document many times goes through the join once a document, with its places."""
    docs = [(k, "the " * (1 + k % 40) + f"own{k} cat the sat on the mat " * (k % 3) + "end") for k in range(120)] + [(500, "the " * 50_000)]
    items = [(1, "the"), (2, "cat"), (3, "sat on the"), (4, "nowhere"), (5, "the cat the sat on the mat own7 cat the sat")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    made = []
    real = d.stash
    monkeypatch.setattr(d, "stash", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    monkeypatch.setattr(d, "BROADCAST_BYTES", short_bytes)
    hits = d.find_hits(docs_of(docs).select("doc_id", "text"), bench, broadcast_bytes=0).collect()
    got = sorted((r.doc_id or -1, r.hits.n_words, sum(s.end - s.start for s in r.hits.hit_words), ",".join(sorted(map(str, r.hits["items"])))) for r in hits)
    assert got == brute(docs, items)
    near = dict(made)["near"]
    assert near.count() == 121 and max(len(r.near) for r in near.collect()) <= 4
