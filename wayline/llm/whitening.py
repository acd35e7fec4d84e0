"""Whitening of embeddings by shifted CholeskyQR.

Vectors become whole numbers, floor(64 * c) + 1000000, and equal ones count once in the fit. Their rows, centred by exact sums,
make a tall matrix A. Each pass over the rows sums a Gram matrix of Q = A R1^-1 R2^-1 ... (triangular solves, row by row, in
tasks), whose Cholesky factor is the next R; the first factor is shifted, so that no Gram matrix of badly scaled rows can fail.
After a few passes Q is orthogonal to rounding, and the singular values and right vectors of R = ... R2 R1 are those of A, without
the loss that squaring A's condition would bring. Only sums of d x d numbers reach the driver; d is the vectors' length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stage

SCALE, OFFSET = 64.0, 1_000_000
PASSES = 6
#: Entries from here on have no exact long; rows with one are left out like those with infinite ones.
LARGEST = 2.0**61
BATCH = 4096


@dataclass(frozen=True)
class Whitening:
    """What fit() found: how many distinct vectors, their sums, and a column per component."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def _usable(vectors: str):
    return F.expr(f"`{vectors}` is not null and size(`{vectors}`) > 0 and forall(`{vectors}`, c -> c is not null and abs(c) < {LARGEST / SCALE}d)")


def _whole(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c.astype(np.float64)).astype(np.int64) + OFFSET


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, BATCH):
            yield b.slice(k, BATCH)


def _packed(vectors: DataFrame, column: str) -> DataFrame:
    """(dim, x): each vector as bytes, its numbers less OFFSET in the least width that holds them all, so equal vectors are equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            col = b.column(0)
            sizes = col.value_lengths().to_numpy(zero_copy_only=False)
            x, at = _whole(col.flatten().to_numpy(zero_copy_only=False)) - OFFSET, np.concatenate([[0], np.cumsum(sizes)])
            low, high = np.minimum.reduceat(x, at[:-1]) if len(sizes) else x, np.maximum.reduceat(x, at[:-1]) if len(sizes) else x
            width = np.full(len(sizes), 8)
            for w in (4, 2, 1):
                width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
            rows = [x[at[k] : at[k + 1]].astype(f"<i{width[k]}").tobytes() for k in range(len(sizes))]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(rows, pa.binary())], names=["dim", "x"])

    return vectors.select(F.col(column).cast("array<double>")).mapInArrow(run, "dim int, x binary")


def _unpacked(col: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The vectors of a batch as rows of whole numbers, those of one width at a time."""
    rows = col.to_pylist()
    for w in (1, 2, 4, 8):
        if own := [r for r in rows if len(r) == w * d]:
            yield np.frombuffer(b"".join(own), f"<i{w}").reshape(-1, d).astype(np.int64) + OFFSET


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: longs where they suffice, else Python's whole numbers."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 2**61 and max(map(abs, sums)) < 2**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a R^-1 for an upper triangle R, column by column."""
    q = np.empty_like(a)
    for k in range(a.shape[1]):
        q[:, k] = (a[:, k] - q[:, :k] @ r[:k, k]) / r[k, k]
    return q


def _gram(fit: DataFrame, d: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of q^T q, q = make(rows). A task gives its own sum; those are added up by a shuffle of d * (d + 1) / 2 keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in _pieces(batches):
            for x in _unpacked(b.column(0), d):
                q = make(x)
                total = total + q.T @ q
        if not np.isscalar(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    found = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    side = max(r.i for r in found) + 1
    out = np.zeros((side, side))
    for r in found:
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def _sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """How many rows, and the exact sum of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in _pieces(batches):
            for x in _unpacked(b.column(0), d):
                n += len(x)
                part = x.sum(axis=0) if np.abs(x).max() < 2**48 else x.astype(object).sum(axis=0)
                total = [a + int(c) for a, c in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in [n, *total]])], names=["k", "v"])

    rows = fit.select("x").mapInArrow(run, "k int, v string").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r.k: int(r.v) for r in rows}
    return found[-1], tuple(found[k] for k in range(d))


def fit(vectors: DataFrame, column: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors of a column; null ones and those with null or non-finite entries are left out.

    A table holds vectors of one length. If lengths differ, the most frequent among distinct vectors counts (the longer of equals).
    Components whose eigenvalue is zero to rounding are not given, so constant or dependent columns lead to fewer. None without
    any usable vector. The number of rows has no bound; d * d numbers must fit in the driver.
    """
    listed = stage(_packed(vectors.where(_usable(column)).select(column), column).distinct(), "whitening")
    best = listed.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if best is None:
        return None
    d = best.dim
    rows = listed.where(F.col("dim") == d)
    n, sums = _sums(rows, d)

    def centred(x: np.ndarray) -> np.ndarray:
        return _centred(x, n, sums).astype(np.float64) / n

    r, factors, eps = np.eye(d), [], np.finfo(float).eps

    def orthogonal(x: np.ndarray) -> np.ndarray:
        q = centred(x)
        for f in factors:
            q = _solve(q, f)
        return q

    for k in range(PASSES):
        g = _gram(rows, d, orthogonal)
        if k == 0:
            trace = float(np.trace(g))
            if trace == 0:
                break
        if k > 1 and np.abs(g - np.eye(d)).max() < 64 * d * eps:
            break
        shift = 0.0 if k else 11 * (n * d + d * (d + 1)) * (eps / 2) * np.linalg.norm(g, 2)
        if k == PASSES - 1:
            break
        try:
            factor = np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:  # dependent columns: their directions stay short, and get no component
            factor = np.linalg.cholesky(g + 64 * d * eps * np.linalg.norm(g, 2) * np.eye(d)).T
        r, factors = factor @ r, [*factors, factor]
    values, base = np.linalg.eigh(g)  # Q^T Q as measured last: the identity, or short of it in dependent directions
    _, sigma, vt = np.linalg.svd(np.sqrt(np.maximum(values, 0))[:, None] * base.T @ r)
    kept = min(components, int((sigma > 64 * d * eps * sigma[0]).sum())) if trace else 0
    v, e = vt[:kept].T.copy(), sigma[:kept] ** 2 / n
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    error = float(np.abs(_gram(rows, d, lambda x: centred(x) @ v / np.sqrt(e)) / n - np.eye(kept)).max()) if kept else 0.0
    discard(listed)
    return Whitening(n, sums, v, e, trace / n, error)


def whiten(vectors: DataFrame, model: Whitening | None, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """A row per usable vector and component: keep, component (from 1, by falling eigenvalue), n, deviation, whitened, explained,
    identity_error. deviation is the exact sum of (n * x - S)^2, null where that exceeds a long. Repeated rows, also of one id, each
    get their rows; other columns are ignored."""
    fields = {c: vectors.schema[c].dataType.simpleString() for c in keep}
    names = [f"__k{k}" for k in range(len(keep))]
    schema = ", ".join([*(f"{a} {t}" for a, t in zip(names, fields.values())), "component int, n long, deviation long, whitened double, explained double, identity_error double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        d, c = len(model.sums), len(model.eigenvalues)
        scale, share = np.sqrt(model.eigenvalues), model.eigenvalues / model.trace
        for b in _pieces(batches):
            m = b.num_rows
            whole = _centred(_whole(b.column(len(keep)).flatten().to_numpy(zero_copy_only=False)).reshape(m, d), model.n, model.sums)
            exact = whole.dtype != object and int(np.abs(whole).max(initial=0)) ** 2 * d < 2**63
            far = (whole * whole).sum(axis=1) if exact else [t if t < 2**63 else None for t in (whole.astype(object) ** 2).sum(axis=1)]
            out = (whole.astype(np.float64) / model.n) @ model.components / scale
            each = pa.array(np.repeat(np.arange(m), c))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(each) for k in range(len(keep))), pa.array(np.tile(np.arange(1, c + 1), m), pa.int32()), pa.array(np.full(m * c, model.n)), pa.array(far, pa.int64()).take(each), pa.array(out.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * c, model.identity_error))],
                names=[*names, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    picked = vectors.where(_usable(column)).where(F.size(column) == (len(model.sums) if model else -2))
    picked = picked.select(*[F.col(c).alias(a) for c, a in zip(keep, names)], F.col(column).cast("array<double>").alias("__v"))
    return picked.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep)))
