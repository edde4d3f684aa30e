import random

import pytest

from pagegrain.llm import substrings
from tests.llm.conftest import CLASHING, EDGE


def brute(rows, size):
    words = [(t or "").encode().split() if t else [] for _, t in rows]
    seen = {}
    for k, w in enumerate(words):
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append((k, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + size))
    return [b" ".join(x for i, x in enumerate(w) if i not in g).decode() for w, g in zip(words, gone, strict=True)]


@pytest.mark.parametrize(("size", "shard"), [(9, 2048), (12, 2048), (12, 2), (35, 2048)])
def test_equals_brute_force(docs_of, size, shard):
    rng = random.Random(size)
    passages = [[f"w{rng.randint(0, 40)}" for _ in range(rng.randint(size - 3, 3 * size))] for _ in range(6)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edited"
            parts += p[rng.randint(0, 5) :] + [f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 20))]
        rows.append((d, " ".join(parts)))
    rows += [(900, "a " * 50), (901, " ".join("abcdefghij"[i % 10] for i in range(80)))]
    got = {r.doc_id: r.text for r in substrings.remove_repeats(docs_of(rows), size, shard).collect()}
    assert [got[d] for d, _ in rows] == brute(rows, size)


def test_edges(docs_of, spark):
    rows = [*EDGE, (8, "same words here again " * 20), (8, "same words here again " * 20)]
    out = substrings.remove_repeats(docs_of(rows, CLASHING))
    got = sorted((r.doc_id or 0, r.text, r.n_words, r.n_removed) for r in out.collect())
    want = sorted((d or 0, t, len((x or "").encode().split()), len((x or "").encode().split()) - len(t.encode().split())) for (d, x), t in zip(rows, brute(rows, 35), strict=True))
    assert got == want
    assert substrings.remove_repeats(docs_of(rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs_of(rows), 8)


def test_automaton_counts():
    a = substrings.SuffixAutomaton()
    a.add(list("abab"), 1)
    a.add(list("xab"), 3)
    a.close()
    assert list(a.statistics(list("abab"))) == [1, 2, 1, 2]
    assert list(a.statistics(list("xabx"), 3)) == [1, 2, 3, 1]
    assert list(a.statistics(list("ab"), 6)) == [0, 0]


def test_common_phrases_are_cut_again_with_the_same_result(docs_of):
    """One phrase in ever new contexts: its shard is cut by longer anchors, whatever the bound."""
    rng = random.Random(3)
    word = lambda: f"v{rng.randint(0, 10**6)}"
    phrase = [word() for _ in range(12)]
    near = [[word() for _ in range(14)] for _ in range(4)]
    rows = [(d, " ".join([word() for _ in range(9)] + rng.choice(near)[rng.randint(0, 6) :] + phrase + rng.choice(near)[: rng.randint(2, 14)] + [word() for _ in range(9)])) for d in range(120)]
    want = brute(rows, 24)
    assert want != [t for _, t in rows]
    for bound in (2048, 20, 2):
        got = {r.doc_id: r.text for r in substrings.remove_repeats(docs_of(rows), 24, bound).collect()}
        assert [got[d] for d, _ in rows] == want


def test_every_internal_name_passes_through(docs_of):
    names = ["own", "row_id", "row_no", "_spans", "spans", "anchor", "Digest", "a", "b"]
    out = substrings.remove_repeats(docs_of(EDGE, [(c, f"mine {c}") for c in names])).collect()
    assert len(out) == len(EDGE) and all(r[c] == f"mine {c}" for r in out for c in names)
