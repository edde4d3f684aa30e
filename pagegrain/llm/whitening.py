"""Operator 12: embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, x = floor(256 c); the fit list is each different x once. No covariance matrix is ever formed: a pass
multiplies the centred fit list into a block of at most ``BLOCK`` columns, X'(X Q) / n, as partial sums of the tasks that Spark adds by
entry, so what the driver gets is one block. Between passes the driver works on that block alone. Each round
filters the block with the Chebyshev polynomial of ``DEGREE`` that is small on the unwanted part of the spectrum (from 0 to the
block's least Ritz value) and grows fast above it; QR and Rayleigh-Ritz follow. It ends when the residuals |V q - e q| of the wanted
pairs are certified to be under ``TOLERANCE`` times the largest eigenvalue or cannot fall further in double precision.

The mean is exact: per-dimension sums are integers. ``deviation`` is exact too, in wider integers where 64 bits could overflow.

Cases: a null vector, or one with a null or non-finite entry, gives no rows; nor does an empty vector. Vectors of different
lengths are different spaces, each fitted on its own. Repeated rows and repeated vec_ids each get their rows; a null vec_id
stays null. A component without variance (all vectors equal, or fewer directions than components) has whitened null and explained 0, and is
left out of identity_error, which is null if no component has any. A deviation beyond 64 bits is null. Entries beyond 2**62
count as that. Other columns pass through ``whiten`` under any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pagegrain.llm.columns import REST, quoted, unpack
from pagegrain.sources.pages import spread
from pagegrain.storage import stash

COMPONENTS = 4
BLOCK = 32
DEGREE = 10
TOLERANCE = 1e-13
#: Residuals that no longer halve are as small as they get; above this they are no answer.
ENOUGH = 1e-9
MAX_ROUNDS = 60
_ROWS = 4096
_LIMIT = 1 << 62


def scaled(embedding: Column) -> Column:
    """floor(256 c) of each entry as long (never a negative zero); null where a vector or an entry is null or not finite."""
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * 256, F.lit(float(_LIMIT))), F.lit(-float(_LIMIT)))).cast("long")
    return F.when(embedding.isNotNull() & F.forall(embedding, number), F.transform(embedding, whole))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _sums(d: int):
    """Per dimension: the sum of the entries' upper and lower halves (neither can overflow), and the largest magnitude."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, most, n = np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            most = np.maximum(most, np.abs(x).max(axis=0, initial=0))
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array(most), pa.array(np.full(d, n))], ["i", "high", "low", "most", "n"])

    return sums


def _products(mean: np.ndarray, q: np.ndarray):
    """A task's share of X'(X Q), X centred, entry by entry, and of the sum of all squares behind them."""
    d, k = q.shape

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros((d, k)), 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = _matrix(batch.column("x").slice(at, _ROWS), d) - mean
                total += x.T @ (x @ q)
                squares += float(np.einsum("nd,nd->", x, x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * k + 1)), pa.array(np.append(total.ravel(), squares))], ["i", "share"])

    return products


@dataclass
class Fit:
    """What whitening needs of a fit list: its size, sums and mean, the directions with their eigenvalues, and the trace of V."""

    n: int
    sums: list[int]
    most: int
    mean: np.ndarray
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float | None = None


class _Passes:
    """Products of the centred covariance with blocks of columns, each a job over the fit list."""

    def __init__(self, fit: DataFrame, n: int, mean: np.ndarray):
        self.fit, self.n, self.mean, self.made, self.trace = fit, n, mean, 0, 0.0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        told = self.fit.mapInArrow(_products(self.mean, q), "i long, share double").groupBy("i").agg(F.sum("share").alias("total"))
        told = told.toArrow().sort_by("i").column("total").to_numpy()
        self.made += 1
        self.trace = float(told[-1]) / self.n
        return told[:-1].reshape(q.shape) / self.n


def _filtered(passes: _Passes, q: np.ndarray, top: float, cut: float, degree: int) -> np.ndarray:
    """p(V) q for the Chebyshev polynomial that stays within 1 on [0, cut], scaled to about 1 at ``top`` so that nothing overflows."""
    half = cut / 2
    first = half / (half - top)
    sigma, before = first, q
    now = (passes(q) - half * q) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (passes(now) - half * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def _rayleigh_ritz(passes: _Passes, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), their vectors, and V times these."""
    q, _ = np.linalg.qr(q)
    v = passes(q)
    small = q.T @ v
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], q @ turn[:, ::-1], v @ turn[:, ::-1]


def fit_directions(vectors: DataFrame, d: int, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE, tolerance: float = TOLERANCE, seed: int = 0) -> Fit:
    """Leading directions of the different vectors ``x`` (array<long> of length ``d``, at least one)."""
    told = vectors.mapInArrow(_sums(d), "i long, high long, low long, most long, n long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = told.groupBy("i").agg(whole("high"), whole("low"), F.max("most").alias("most"), F.sum("n").alias("n")).orderBy("i").collect()
    n, sums = rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]
    passes = _Passes(vectors, n, np.array([float(Fraction(s, n)) for s in sums]))
    k = min(d, max(block, 2 * components))
    values, q, v = _rayleigh_ritz(passes, np.random.default_rng(seed).standard_normal((d, k)))
    wanted, before = min(components, k), np.inf
    for _ in range(MAX_ROUNDS):
        residual = float(np.linalg.norm(v[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
        scale = max(float(values[0]), 0.0)
        # A block of all dimensions is solved by Rayleigh-Ritz at once; without variance there is nothing to solve.
        if k == d or residual <= tolerance * scale or residual > before / 2 and residual <= ENOUGH * scale:
            break
        before = residual
        cut = float(np.clip(values[-1], scale * 1e-6, scale * (1 - 1e-6)))
        values, q, v = _rayleigh_ritz(passes, _filtered(passes, q, scale, cut, degree))
    else:
        raise ArithmeticError(f"no convergence: residual {residual:.3g} for a largest eigenvalue of {values[0]:.3g}")
    real = np.where(values[:wanted] > 1e-12 * max(passes.trace, 0.0), values[:wanted], 0.0)
    fit = Fit(n, sums, max(r.most for r in rows), passes.mean, q[:, :wanted], real, passes.trace, residual, passes.made)
    kept = real > 0
    if kept.any():
        w = fit.directions[:, kept] / np.sqrt(real[kept])
        fit.identity_error = float(np.abs(w.T @ passes(w) - np.eye(int(kept.sum()))).max())
    return fit


def _told(fit: Fit, d: int):
    wide = fit.n * fit.most + max(map(abs, fit.sums), default=0)
    exact = d * wide * wide < 1 << 63
    sums = np.array(fit.sums, np.int64 if exact else object)
    share = [float(e) / fit.trace if fit.trace > 0 else 0.0 for e in fit.eigenvalues]
    k = len(share)

    def deviations(x: np.ndarray) -> list[int | None]:
        off = fit.n * (x if exact else x.astype(object)) - sums
        total = (off * off).sum(axis=1).tolist()
        return total if exact else [t if t < 1 << 63 else None for t in total]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.where(fit.eigenvalues > 0, np.sqrt(np.where(fit.eigenvalues > 0, fit.eigenvalues, 1)), np.nan)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                x = _matrix(batch.column("x"), d)
                white = (x - fit.mean) @ fit.directions / scale
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(REST).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), fit.n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(rows)), pa.array(white.ravel(), mask=np.isnan(white.ravel())), pa.array(share * len(x), pa.float64()), pa.array([fit.identity_error] * len(rows), pa.float64()),
                    ],
                    [REST, *_NEW],
                )

    return told


_NEW = ("component", "n", "deviation", "whitened", "explained", "identity_error")
_TYPES = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE, tolerance: float = TOLERANCE) -> DataFrame:
    """The other columns of each usable row, once for each component, with component, n, deviation, whitened, explained and identity_error."""
    kept = [c for c in vectors.columns if c.lower() not in (embedding.lower(), *_NEW)]
    own = (F.struct(*map(quoted, kept)) if kept else F.lit(True)).alias(REST)
    rows = spread(vectors.select(own, quoted(embedding).alias("embedding"))).select(REST, scaled(F.col("embedding")).alias("x")).filter("size(x) > 0")
    rows = stash(rows, "scaled")
    different = stash(rows.select("x").distinct(), "fit")
    schema, out = StructType([StructField(REST, rows.schema[REST].dataType), *StructType.fromDDL(_TYPES).fields]), None
    for d in sorted(r.d for r in different.select(F.size("x").alias("d")).distinct().collect()):
        fit = fit_directions(different.filter(F.size("x") == d), d, components, block, degree, tolerance)
        told = rows.filter(F.size("x") == d).mapInArrow(_told(fit, d), schema)
        out = told if out is None else out.unionByName(told)
    out = rows.sparkSession.createDataFrame([], schema) if out is None else out
    return unpack(out, kept, **{c: F.col(c) for c in _NEW})


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
