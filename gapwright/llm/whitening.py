"""Whitening of embeddings by shifted CholeskyQR."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000  # of the whole numbers that stand for entries
COMPONENTS = 8
MOST_PASSES = 8
ROWS = 4096  # looked at together
EPS = float(np.finfo(float).eps)
MOST = 1 << 60  # of an entry's whole number


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers: ``floor(SCALE * c) + OFFSET``, those beyond
    ``MOST`` as that."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -MOST, MOST).astype(np.int64).reshape(len(column), -1) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part[name])


@dataclass
class Fit:
    """What the fit list gives: its size, its sums by dimension (Python's
    whole numbers), and unit eigenvectors (columns) of its covariance by
    falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n``: whole parts are taken off exactly."""
    near = np.array([s // n for s in sums], np.int64)
    return (x - near).astype(np.float64) - np.array([s % n / n for s in sums])


def width(rows: DataFrame, vector_col: str) -> int:
    """The number of entries that most usable vectors have, the larger of two."""
    found = rows.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _summed(rows: DataFrame, vector_col: str, sized: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray | None:
    """Sum over all rows of a square or flat array made from blocks of rows.
    A task adds up its blocks; tasks are added row by row of that array."""
    spark_kind = "long" if kind is np.int64 else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, vector_col):
            part = sized(x)
            total = part if total is None else total + part
        if total is not None:
            flat = pa.array(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), flat], ["at", "v"])

    parts = rows.select(vector_col).mapInArrow(run, f"at int, v {spark_kind}")
    found = parts.groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # one number for each pair of dimensions
    if not len(found):
        return None
    out = np.zeros(len(found), kind)
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


def _upper(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with ``R' R = gram + shift``; the shift grows by
    tens until there is one."""
    shifts = [shift] if shift else [0.0]
    scale = float(np.trace(gram)) or 1.0
    for _ in range(40):
        try:
            return np.linalg.cholesky(gram + shifts[-1] * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shifts.append(max(10 * shifts[-1], EPS * scale))
    raise ArithmeticError("the Gram matrix is not finite")


def fit(rows: DataFrame, vector_col: str, dimensions: int) -> Fit:
    """By repeated passes over the centred rows X: a pass adds up the Gram
    matrix of ``X inverse(R)`` by triangular solves, takes its Cholesky factor (shifted in
    the first pass, and wherever there would be none) and composes it with R,
    until the rows so solved are orthonormal. Then ``X = Q R``, and the
    singular value decomposition of R has the eigenvectors of the covariance
    and the roots of its eigenvalues, small ones as exact as large ones.

    Dimensions that never change are left out and get zeros, so that R can be
    inverted. Where other dimensions depend on each other, the shift keeps R
    regular and the eigenvalues left over are next to nothing."""
    d = dimensions
    told = _summed(rows, vector_col, lambda x: np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), np.int64) if d else None
    if told is None:
        return Fit(0, [0] * d, np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    n, sums = int(told[0]), [(int(a) << 32) + int(b) for a, b in zip(told[1 : d + 1], told[d + 1 :], strict=True)]
    gram = _gram(rows, vector_col, n, sums, None)
    varies = np.flatnonzero(np.diag(gram) > 0.25)  # of whole numbers: a dimension with two of them has 0.5 or more
    size = len(varies)
    if not size:
        return Fit(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 1)
    gram = gram[np.ix_(varies, varies)]
    trace = float(np.trace(gram)) / n
    # the shift of shifted CholeskyQR for n rows and `size` columns
    share = min(11 * EPS * size * (n + size + 1), 1e-3)
    r = _upper(gram, share * float(np.linalg.norm(gram, 2)))
    passes = 1
    while passes < MOST_PASSES:
        gram = _gram(rows, vector_col, n, sums, (varies, r))
        passes += 1
        off = float(np.abs(gram - np.eye(size)).max())
        r = _upper(gram, 0.0) @ r
        if off < 1e-8:
            break
    _, roots, rows_of = np.linalg.svd(r)
    vectors = np.zeros((d, size))
    vectors[varies] = rows_of.T
    return Fit(n, sums, vectors, roots**2 / n, trace, passes)


def _solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``x inverse(r)`` by forward substitution, a column of all rows at a time."""
    out = np.empty_like(x)
    for k in range(len(r)):
        out[:, k] = (x[:, k] - out[:, :k] @ r[:k, k]) / r[k, k]
    return out


def _gram(rows: DataFrame, vector_col: str, n: int, sums: list[int], factor: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    def part(x: np.ndarray) -> np.ndarray:
        off = centred(x, n, sums)
        if factor is not None:
            off = _solved(off[:, factor[0]], factor[1])
        return off.T @ off

    flat = _summed(rows, vector_col, part, np.float64)
    side = int(round(len(flat) ** 0.5))
    return flat.reshape(side, side)


def _kept_components(found: Fit, components: int) -> int:
    """Components with an eigenvalue that is not rounding."""
    if not len(found.values):
        return 0
    least = found.values[0] * (len(found.values) * EPS * 16) ** 2  # of R's singular values, 16 times their rounding
    return int(min(components, (found.values > least).sum()))


def _projector(found: Fit, count: int) -> np.ndarray:
    return found.vectors[:, :count] / np.sqrt(found.values[:count])


def whitened(rows: DataFrame, found: Fit, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """``rows`` without the vector, with ``deviation`` (sum over dimensions of
    ``(n x - S)^2``, exact, null where it does not fit a long) and
    ``whitened``, an array of the row's place on each component over the root
    of its eigenvalue."""
    count = _kept_components(found, components)
    projector, n, sums = _projector(found, count), found.n, found.sums

    def exact(x: np.ndarray) -> list[int | None]:
        if n * int(np.abs(x).max(initial=0)) >= 1 << 62:
            whole = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
        else:
            off = n * x - np.array(sums, np.int64)
            most, d = int(np.abs(off).max(initial=0)), max(x.shape[1], 1)
            if most * most * d < 1 << 63:
                return (off * off).sum(axis=1).tolist()
            high, low = np.divmod(off, 1 << 24)  # squares in three parts
            if most * most // (1 << 48) * d >= 1 << 62 or d > 1 << 14:
                high, low = high.astype(object), low.astype(object)
            a, b, c = (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)
            whole = [(int(p) << 48) + (int(q) << 25) + int(s) for p, q, s in zip(a, b, c, strict=True)]
        return [w if w < 1 << 63 else None for w in whole]

    passed = [c for c in rows.columns if c not in (vector_col, "deviation", "whitened")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, vector_col):
            places = centred(x, n, sums) @ projector
            cells = pa.FixedSizeListArray.from_arrays(pa.array(places.ravel()), count).cast(pa.list_(pa.float64())) if count else pa.array([[]] * len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in passed), pa.array(exact(x), pa.int64()), cells], [*passed, "deviation", "whitened"])

    schema = rows.select(*passed).schema.add("deviation", "long")
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(*passed, vector_col).mapInArrow(run, f"{text}, whitened array<double>")


def identity_error(rows: DataFrame, found: Fit, vector_col: str, components: int = COMPONENTS) -> float:
    """Largest entry of the covariance of what ``whitened`` gives, minus the
    identity, measured over all rows."""
    count = _kept_components(found, components)
    if not count:
        return 0.0
    projector, n, sums = _projector(found, count), found.n, found.sums

    def part(x: np.ndarray) -> np.ndarray:
        places = centred(x, n, sums) @ projector
        return np.concatenate([places.sum(axis=0), (places.T @ places).ravel()])

    flat = _summed(rows, vector_col, part, np.float64)
    mean_place, square = flat[:count] / n, flat[count:].reshape(count, count) / n
    return float(np.abs(square - np.outer(mean_place, mean_place) - np.eye(count)).max())


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vectors`` without the vector, a row for each component: ``component``
    (from 1), ``n`` (vectors of the fit list), ``deviation``, ``whitened``,
    ``explained`` (share of the component's eigenvalue in the trace) and
    ``identity_error``.

    Rows whose vector is null, holds a null, NaN or infinite entry, or has
    another number of entries than most vectors (the larger number, if two are
    met as often) are left out. Repeated rows count as often as they occur.
    Components whose eigenvalue is nothing but rounding have no scale and give no
    rows, so a table of equal vectors gives none, and so does an empty table.
    Other columns pass through; those named like a result are replaced.

    What the driver holds is the sums, a Gram matrix and R: numbers for pairs
    of dimensions, whatever the rows. Every task adds up its own rows first.
    """
    made = {"component", "n", "deviation", "whitened", "explained", "identity_error"}
    rows = vectors.drop(*(made & set(vectors.columns) - {vector_col})).where(usable(F.col(vector_col)))
    d = width(rows, vector_col)
    rows = rows.where(F.size(vector_col) == d)
    found = fit(rows, vector_col, d)
    error = identity_error(rows, found, vector_col, components)
    count = _kept_components(found, components)
    shares = [float(v / found.trace) for v in found.values[:count]]
    placed = whitened(rows, found, vector_col, components)
    each = placed.select("*", F.posexplode("whitened").alias("_at", "_place")).drop("whitened")
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("_at") + 1) if shares else F.lit(0.0)
    columns = [c for c in placed.columns if c not in ("deviation", "whitened")]
    return each.select(
        *columns, (F.col("_at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation",
        F.col("_place").alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
