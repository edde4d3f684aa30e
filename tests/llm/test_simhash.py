import random
import re

import numpy as np
import pytest
import xxhash

from pagegrain.llm import simhash
from pagegrain.llm.components import connected_components
from tests.llm.conftest import CLASHING, EDGE


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_equals_brute_force(real_docs):
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = set(zip([d for d, _ in rows], [f"{f:016x}" for f in fps], components(fps, [d for d, _ in rows]), strict=True))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(real_docs).collect()} == want
    assert {r.doc_id for r in simhash.deduplicate(real_docs).collect()} == {c for _, _, c in want}


@pytest.mark.parametrize(("seed", "large"), [(1, 1024), (2, 1024), (2, 16)])
def test_links_of_random_and_crowded_fingerprints(spark, seed, large, monkeypatch):
    monkeypatch.setattr(simhash, "_LARGE", large)  # the bound beyond which keys are cut before their shuffle
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for center in (rng.getrandbits(64), 0):
        for _ in range(700):
            x = center
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node % (1 << 64): r.root for r in connected_components(simhash.links(table)).collect()}
    want = components(fps, list(range(len(fps))))
    groups = {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(roots.get(f, f"own{f}"))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_large_groups_are_cut(monkeypatch):
    monkeypatch.setattr(simhash, "_LARGE", 16)
    rng = np.random.default_rng(0)
    free = [b for b in range(64) if not simhash.KEYS[0][1] >> b & 1]
    fps = np.unique(np.array([sum(1 << free[b] for b in rng.choice(32, rng.integers(0, 5), replace=False)) for _ in range(400)], np.uint64))
    passes = lambda x: np.bitwise_count(x) <= 3
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in simhash._group(fps, free, passes):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() >= 1
            root[find(x)] = find(y)
    want = components([int(f) for f in fps], list(range(len(fps))))
    assert len({find(int(f)) for f in fps}) == len(set(want))


def test_edges(docs_of):
    out = simhash.near_duplicates(docs_of(EDGE, CLASHING)).collect()
    got = sorted((r.doc_id or -1, r.component_id) for r in out)
    assert got == [(-1, None), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 6), (7, 4)]
    kept = simhash.deduplicate(docs_of(EDGE, CLASHING))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5, 6] and "row_key" in kept.columns
    assert simhash.near_duplicates(docs_of(EDGE).limit(0)).count() == 0 and simhash.deduplicate(docs_of(EDGE).limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0


def test_every_internal_name_passes_through(docs_of):
    from tests.llm.conftest import EDGE

    names = ["own", "_row_key", "row_key", "key", "fp", "_id", "_key", "component_id", "K", "c"]
    out = simhash.deduplicate(docs_of(EDGE, [(c, f"mine {c}") for c in names]))
    assert out.columns[5:] == names and all(r[c] == f"mine {c}" for r in out.collect() for c in names) and out.count() > 0
