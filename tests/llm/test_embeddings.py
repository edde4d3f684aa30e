import numpy as np
import pytest

from pagegrain.llm import embeddings


def brute(rows, threshold):
    ok = [(k, i, np.array(v, np.float64)) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, (k, _, x) in enumerate(ok):
        for m, _, y in ok[:a]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[k].add(m)
                links[m].add(k)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, stack = {k}, [k]
        while stack:
            for m in links[stack.pop()] - seen:
                seen.add(m)
                stack.append(m)
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i if i is not None else -1, len(links[k]), least, i is not None and least == i))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [4096, 16])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    for center in range(3):
        c = rng.normal(size=8)
        rows += [(1000 * (center + 1) + k, (3 * (c + rng.normal(size=8) * 0.25)).astype(np.float32).tolist()) for k in range(40)]
    rows += [(5000 + k, rows[0][1]) for k in range(5)] + [(6000, [0.0] * 8), (6001, None), (6002, []), (6003, [float("nan")] + [1.0] * 7), (6004, [None] + [1.0] * 7), (6005, [float("inf")] * 8), (None, rows[0][1]), (6006, [1.0, 2.0]), (6007, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links string, degree int")
    assert told(embeddings.near_duplicates(df, block=block)) == brute(rows, 0.9)


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert told(embeddings.near_duplicates(df)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        embeddings.near_duplicates(df, 0.0)


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantise(u)
    product = s[:, None] * s[None, :] * (q.astype(int) @ q.astype(int).T)
    assert (np.abs(product - u @ u.T) <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()
    wide = rng.integers(-127, 128, size=(5, 3000)).astype(np.int8)
    assert (embeddings._products(wide, wide) == wide.astype(int) @ wide.astype(int).T).all()


def test_clustered_rows_are_dealt_a_few_times(spark):
    """Blocks that grow in number with the rows do not make a row go to more tiles."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(60, 32))

    def dealt(n):
        x = (centers[np.arange(n) % 60] + rng.normal(size=(n, 32)) * 0.2).astype(np.float32)
        df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "u long, embedding array<float>, times long")
        df = df.selectExpr("*", "xxhash64(embedding) AS h1", "xxhash64(1, embedding) AS h2")
        return embeddings._dealt(df, n, 0.9, 256).count()

    few, many = dealt(1500), dealt(12_000)
    assert np.log(many / few) / np.log(8) <= 1.2 and many <= 4 * 12_000


def test_no_magnitude_hurts_another_vector(spark):
    """Tiny, huge, subnormal and mixed vectors link by direction, and the links of all others stay as they are without them."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=4) + 4 * (i % 5 - 2) * np.eye(4)[i % 4]).tolist()) for i in range(100)]
    odd = [(1000, [1e-200] * 4), (1001, [2e-200] * 4), (1002, [1e200] * 4), (1003, [1e200, 1e200, 1e200, 0.9e200]), (1004, [5e-324] * 4), (1005, [5e-324, 0.0, 0.0, 0.0]), (1006, [1e308, -1e308, 1e-308, 5e-324]), (1007, [1.0, -1.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows + odd]
    with_odd = told(embeddings.near_duplicates(spark.createDataFrame(rows + odd, schema)))
    assert with_odd == brute(scaled, 0.9)
    assert [r[1] for r in with_odd if r[0] == 1000][0] >= 4
    alone = {r[0]: r[1] for r in told(embeddings.near_duplicates(spark.createDataFrame(rows, schema)))}
    near_odd = {i for i, v in scaled[:100] if any(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9 for _, w in scaled[100:])}
    assert sum(alone.values()) and {r[0]: r[1] for r in with_odd if r[0] < 1000 and r[0] not in near_odd} == {i: n for i, n in alone.items() if i not in near_odd}
    assert told(embeddings.near_duplicates(spark.createDataFrame(rows + odd, schema), block=16)) == with_odd
