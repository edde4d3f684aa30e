"""Operator 12 against numpy's full eigendecomposition and exact integers."""

import numpy as np
import pytest

from pagegrain.llm import whitening


def reference(vectors, components=4):
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = [list(u) for u in sorted(set(map(tuple, x)))]
    n, d = len(fit), len(fit[0])
    sums = [sum(u[i] for u in fit) for i in range(d)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    white = (np.array(x, float) - np.array([s / n for s in sums])) @ q
    return n, [sum((n * a - s) ** 2 for a, s in zip(u, sums, strict=True)) for u in x], white, values, values / (np.square(centred).sum() / n)


def check(df, rows, d):
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    assert got.keys() == {i for i, _ in usable}
    n, deviation, white, values, share = reference([v for _, v in usable])
    k = min(4, d)
    for at, (i, _) in enumerate(usable):
        assert got[i].keys() == set(range(1, k + 1))
        for c in range(k):
            r = got[i][c + 1]
            assert (r.n, r.deviation) == (n, deviation[at])
            assert r.explained == pytest.approx(share[c], rel=1e-9, abs=1e-12) and (r.identity_error is None or r.identity_error < 1e-9)
    for c in range(k):
        if values[c] > 1e-9 * values[0]:
            mine = np.array([got[i][c + 1].whitened for i, _ in usable])
            want = white[:, c] / np.sqrt(values[c])
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
    return got


@pytest.mark.parametrize("d", [1, 3, 5, 40, 90])
def test_equals_the_full_eigendecomposition(spark, d):
    rng = np.random.default_rng(d)
    base = rng.normal(size=(300, d)) * np.linspace(2, 0.5, d)
    rows = [(i, v) for i, v in enumerate(base.tolist())]
    rows += [(1000 + k, rows[0][1]) for k in range(50)] + [(2000, None), (2001, [float("nan")] * d), (2002, [None] * d), (2003, [float("inf")] + [0.0] * (d - 1)), (2004, [-0.0] * d)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows, d)


def test_flat_spectrum_is_certified(spark):
    """Leading eigenvalues within some percent of each other still come out to double precision."""
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(4000, 64)) * 0.4).astype(np.float32).tolist())]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), rows, 64)


def test_few_directions(spark):
    """Components without variance are null; the others are whole."""
    line = [(i, [float(i), 2.0 * i, 0.0, 1.0, 1.0]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 80 and all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in got)
    assert sum(r.explained for r in got if r.vec_id == 0) == pytest.approx(1)
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)}


def test_wide_numbers_lengths_and_names(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [3e11, 2.0]), (4, [1e300, 0.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()}
    n, deviation, *_ = reference([v for _, v in rows[:3]])
    assert [got[i, 1].deviation for i in (1, 2, 3)] == [x if x < 1 << 63 else None for x in deviation]
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 8
    mixed = spark.createDataFrame([(1, [1.0], "a", "b"), (2, [2.0], "a", "b"), (3, [1.0, 2.0], "a", "b"), (4, [3.0, 1.0], "a", "b"), (5, [], "a", "b"), (None, [1.0], "a", "b")], "vec_id long, embedding array<float>, own string, x string")
    made = whitening.whiten(mixed)
    assert made.columns[:3] == ["vec_id", "own", "x"] and {(r.own, r.x) for r in made.collect()} == {("a", "b")}
    assert sorted((r.vec_id or 0, r.component, r.n) for r in made.collect()) == [(0, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]
    assert whitening.whiten(mixed.limit(0)).count() == 0
