"""Operator 9: near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one class with a multiplicity. Classes are dealt to cells (nearest of some four times the
root of their number of pivots, so cells grow with the rows) and neighbouring cells to blocks of about
``BLOCK`` classes; a larger cell is several blocks. Two blocks meet in a tile only where a link between them
is possible: by the triangle inequality on angles, a vector goes to the tiles of a cell only if its angle to
the pivot is at most the cell's radius plus the threshold's angle. So every pair that can link meets in
exactly one tile, and on clustered data a vector goes to a few tiles, however many there are; on data
without any structure the tiles are those of all pairs of blocks, as an exact join of that kind must be.

Vectors are first scaled by powers of two, exactly, so that those of tiny, huge or subnormal components link by their
direction like any other. In a tile each unit vector u is held as s * q with q in int8, and e = |u - s q| is computed. The
product of two differs from the true cosine by at most e_u + (1 + e_u) e_v. Integer products are exact
in the float32 matrix product (slices of at most 1,000 dimensions keep sums under 2**24). Only pairs
whose bound reaches the threshold are recomputed in double precision from the original components.
A tile returns a degree and one link of a spanning forest for each class, never its pairs.

Cases: a vec_id that is null, and a vector that is null, empty or zero or holds null or non-finite
components, links with nothing: n_links 0, component_id its own vec_id, kept if that is not null.
Vectors of different lengths do not link; lengths of up to ``BLOCK`` classes share one job, a tile each. Equal vectors link with each other. Rows that share a
vec_id but not a vector are one vector in several places: their links add. An empty table gives no rows.
Other columns, labels too, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm.components import connected_components
from pagegrain.storage import stash

THRESHOLD = 0.9
BLOCK = 16_384
PIVOTS_PER_ROOT = 4
PIVOT_BYTES = 32 << 20
_SUB = 1024
_LEADERS = 2048
_EXACT_DIMS = 1000


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def unscaled(x: np.ndarray) -> np.ndarray:
    """Vectors (not zero, finite) times the power of two that takes each one's largest component to between 1/2 and 1.

    No cosine changes, and no square or product can overflow or vanish that counts in double precision. Powers are taken
    in two steps, as that of a subnormal number is none itself.
    """
    power = -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1]
    half = power // 2
    return np.ldexp(np.ldexp(x, half), power - half)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, e): int8 values, scales and error norms of unit vectors."""
    s = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / s[:, None]).astype(np.int8)
    return q, s, np.linalg.norm(unit - s[:, None] * q, axis=1) + 1e-12


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows."""
    total = np.zeros((len(a), len(b)), np.float32 if a.shape[1] <= _EXACT_DIMS else np.float64)
    for d in range(0, a.shape[1], _EXACT_DIMS):
        total += a[:, d : d + _EXACT_DIMS].astype(np.float32) @ b[:, d : d + _EXACT_DIMS].astype(np.float32).T
    return total


class Quantised:
    """Vectors (not zero, finite) of one length with their int8 forms."""

    def __init__(self, x: np.ndarray):
        self.x = unscaled(x)
        self.norm = np.linalg.norm(self.x, axis=1)
        self.q, self.s, self.e = quantise(self.x / self.norm[:, None])

    def close_pairs(self, rows: np.ndarray, other: Quantised, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of these rows and of the other's columns with cosine >= threshold in double precision."""
        sa, ea, sb, eb = self.s[rows], self.e[rows], other.s[columns], other.e[columns]
        # In float32 the scaling itself is off by some units in the last place of a number of at most 1.
        least = (threshold - ea - (1 + ea) * eb.max() - 1e-5) / sa
        product = _products(self.q[rows], other.q[columns])
        if least.min() > 0 and float(product.max()) * sb.max() < least.min():
            none = np.zeros(0, np.int64)
            return none, none
        i, j = np.nonzero(product * sb.astype(np.float32)[None, :] >= least.astype(np.float32)[:, None])
        sure = sa[i] * sb[j] * np.einsum("nd,nd->n", self.q[rows[i]].astype(np.int32), other.q[columns[j]].astype(np.int32)) + ea[i] + (1 + ea[i]) * eb[j] >= threshold
        i, j = rows[i[sure]], columns[j[sure]]
        cosine = np.einsum("nd,nd->n", self.x[i], other.x[j]) / (self.norm[i] * other.norm[j])
        return i[cosine >= threshold], j[cosine >= threshold]


class _Forest:
    """Least-root components of numbered items, joined by arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def _tile(threshold: float):
    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("u")
        blocks = table.column("block").to_numpy()
        x, times = Quantised(_matrix(table.column("embedding"))), table.column("times").to_numpy()
        own = int(blocks.min())
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        left = np.flatnonzero(blocks == own) if not same else np.arange(len(blocks))
        right = left if same else np.flatnonzero(blocks != own)
        # Rows of like scales next to each other: most parts are ruled out by their largest product alone.
        left, right = left[np.argsort(x.s[left], kind="stable")], right[np.argsort(x.s[right], kind="stable")]
        degree, forest = np.zeros(len(blocks), np.int64), _Forest(len(blocks))
        for p in range(0, len(left), _SUB):
            for q in range(p if same else 0, len(right), _SUB):
                i, j = x.close_pairs(left[p : p + _SUB], x, right[q : q + _SUB], threshold)
                if same and p == q:
                    i, j = i[i < j], j[i < j]
                np.add.at(degree, i, times[j])
                np.add.at(degree, j, times[i])
                forest.join(i, j)
        found = np.flatnonzero(degree)
        keys = table.column("u").to_numpy()
        return pa.table({"u": pa.array(keys[found]), "v": pa.array(keys[forest.root[found]]), "degree": pa.array(degree[found])})

    return links


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = unscaled(x)
    return np.arccos(np.clip(x @ pivots.T / np.linalg.norm(x, axis=1)[:, None], -1, 1))


def _neighbours_together(unit: np.ndarray, threshold: float) -> np.ndarray:
    """An order of unit vectors in which close ones follow each other: each goes to the first of some leaders that links with it."""
    leader = np.full(len(unit), _LEADERS)
    for k in range(_LEADERS):
        left = np.flatnonzero(leader == _LEADERS)
        if not len(left):
            break
        leader[left[unit[left] @ unit[left[0]] >= threshold]] = k
        leader[left[0]] = k
    return np.argsort(leader, kind="stable")


def _assign(pivots: np.ndarray):
    """Cell and angle of each class; the pivots have its length."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SUB):
                batch = whole.slice(at, _SUB)
                angle = _angles(_matrix(batch.column("embedding")), pivots)
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "angle"])

    return assign


class Blocks:
    """Which blocks each cell's classes lie in: a run of small neighbouring cells shares one, a large cell has several."""

    def __init__(self, sizes: np.ndarray, block: int):
        self.first, self.count = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block))
        n, held = 0, 0
        for c, size in enumerate(sizes.tolist()):
            if held and held + size > block:
                n, held = n + 1, 0
            self.first[c] = n
            if size > block:
                n, held = n + self.count[c], 0
            else:
                held += size
        self.total = int(n + (held > 0))


def _deal(pivots: np.ndarray, radius: np.ndarray, blocks: Blocks, threshold: float):
    """Each class once for each tile in which it may find a link."""
    reach = np.arccos(min(1.0, threshold)) + radius + 1e-6
    last = blocks.first + blocks.count - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                near = _angles(_matrix(batch.column("embedding")), pivots) <= reach[None, :]
                cell = batch.column("cell").to_numpy()
                near[np.arange(len(cell)), cell] = True
                block = blocks.first[cell] + batch.column("draw").to_numpy() % blocks.count[cell]
                # +1 where a near cell's blocks begin, -1 behind their end: the running sum is over 0 in blocks to meet.
                edges = np.zeros((len(cell), blocks.total + 1), np.int32)
                i, c = np.nonzero(near)
                np.add.at(edges, (i, blocks.first[c]), 1)
                np.add.at(edges, (i, last[c] + 1), -1)
                row, other = np.nonzero(np.cumsum(edges, axis=1)[:, :-1] > 0)
                a, b = np.minimum(block[row], other), np.maximum(block[row], other)
                keep = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(block[row].astype(np.int32)), *(batch.column(k).take(keep) for k in ("u", "times", "embedding"))],
                    ["a", "b", "block", "u", "times", "embedding"],
                )

    return deal


def _dealt(classes: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """The rows of the tiles of one length's ``n`` classes."""
    d = len(classes.first().embedding)
    wanted = max(1, min(n, int(PIVOTS_PER_ROOT * n**0.5), PIVOT_BYTES // (8 * d)))
    chosen = classes.orderBy("h1", "h2").limit(wanted).select("embedding").collect()
    pivots = unscaled(np.array([r.embedding for r in chosen], np.float64))
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    pivots = pivots[_neighbours_together(pivots, threshold)]
    kind = classes.schema["embedding"].dataType.simpleString()
    placed = classes.select("u", "times", "embedding", F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)).alias("draw"))
    placed = stash(placed.mapInArrow(_assign(pivots), f"u long, times long, embedding {kind}, draw long, cell int, angle double"), "cells")
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():
        sizes[r.cell], radius[r.cell] = r.n, r.r
    return placed.mapInArrow(_deal(pivots, radius, Blocks(sizes, block), threshold), f"a int, b int, block int, u long, times long, embedding {kind}").withColumn("d", F.lit(d))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold is over 0 and at most 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = F.col("vec_id").isNotNull() & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    rows = rows.select("vec_id", F.coalesce(valid, F.lit(False)).alias("valid"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")
    classes = rows.filter("valid").groupBy("h1", "h2").agg(F.min("vec_id").alias("u"), F.count("*").alias("times"), F.first("embedding").alias("embedding"))
    classes = stash(classes, "vectors")
    d = F.size("embedding")
    sizes = stash(classes.groupBy(d.alias("d")).agg(F.count("*").alias("n")), "lengths")
    large = sizes.filter(F.col("n") > block).collect()  # at most one for ``block`` classes
    rest = classes.filter(~d.isin([r.d for r in large])) if large else classes
    tiles = rest.select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("block"), "u", "times", "embedding", d.alias("d"))
    for r in large:
        tiles = tiles.unionByName(_dealt(classes.filter(d == r.d), r.n, threshold, block))
    tiles = stash(tiles.groupBy("d", "a", "b").applyInArrow(_tile(threshold), "u long, v long, degree long"), "tiles")
    degree = tiles.groupBy("u").agg(F.sum("degree").alias("degree"))
    roots = connected_components(tiles.select("u", "v")).withColumnRenamed("node", "u")
    own = classes.groupBy("u").agg(F.sum(F.col("times") - 1).alias("equal"))
    told = own.join(degree, "u", "left").join(roots, "u", "left")
    told = told.select("u", (F.col("equal") + F.coalesce("degree", F.lit(0))).alias("n"), F.coalesce("root", "u").alias("root"))
    told = classes.select("h1", "h2", "u").join(told, "u").select("h1", "h2", "n", "root", F.lit(True).alias("valid"))
    out = rows.drop("embedding").join(told, ["h1", "h2", "valid"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS r FROM embeddings UNION SELECT links.y, r FROM reach JOIN links ON reach.x = links.x),
least AS (SELECT x AS vec_id, min(r) AS component_id FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.x = e.vec_id)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id)
"""
