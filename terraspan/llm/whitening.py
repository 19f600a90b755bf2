"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become whole numbers, so sums and the scatter are exact: a first pass adds up the
vectors, a second one the products of vectors centred by the whole part of their mean; the
fraction that is left of the mean is settled afterwards in whole numbers too. The
covariance is rounded once. Its Cholesky factor, columns chosen by the largest diagonal
left, is turned from the right until all columns are orthogonal: their squared norms are
the eigenvalues, the columns scaled to length one the components.

Tasks send one partial sum for each pair of dimensions; what reaches the driver depends on
the number of dimensions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .batches import without

SCALE, OFFSET = 1024, 100_000
LARGEST = 1 << 50  # whole numbers are held to this size
COMPONENTS = 8
BLOCK_ENTRIES = 1 << 20  # entries of vectors worked on at once
SWEEPS = 60
_LONG = (1 << 63) - 1
_WHOLE = pa.decimal128(38, 0)


@dataclass
class Whitening:
    """What was learned: n vectors, their sums, and per component its direction and eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimensions by components
    eigenvalues: np.ndarray
    trace: float

    @property
    def middle(self) -> np.ndarray:
        """Whole part of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """What the whole part leaves of the sums, from 0 to n - 1."""
        return [s % self.n for s in self.sums]


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each vector (0 where null, empty or with an entry that is null or not finite), its offset, all entries."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries turn into nan
    starts = np.cumsum(lengths) - lengths
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    return np.where(bad[starts + lengths] > bad[starts], 0, lengths), starts, entries


def _blocks(column: pa.Array, dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers) of the usable vectors of a batch, in blocks of bounded size."""
    lengths, starts, entries = _usable(column)
    rows = np.flatnonzero(lengths == dimensions) if dimensions else np.zeros(0, np.int64)
    step = max(1, BLOCK_ENTRIES // max(1, dimensions))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        scaled = np.clip(entries[starts[some, None] + np.arange(dimensions)] * SCALE, -LARGEST, LARGEST)
        yield some, np.floor(scaled).astype(np.int64) + OFFSET


def _total(vectors: DataFrame, partial: Callable[[Iterator[pa.Array]], dict]) -> dict[tuple[int, int], int]:
    """Whole numbers by pair of keys, as ``partial`` adds them up over the vectors of a task, summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(batch.column(0) for batch in batches)
        i, j = zip(*found) if found else ((), ())
        values = pa.array([Decimal(int(v)) for v in found.values()], _WHOLE)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], names=["i", "j", "value"])

    rows = vectors.mapInArrow(run, "i int, j int, value decimal(38,0)")
    return {(r["i"], r["j"]): int(r["value"]) for r in rows.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}


def commonest_length(vectors: DataFrame) -> int:
    """Length of most usable vectors, the larger one of two; 0 if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, count = np.unique(_usable(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(count)], names=["length", "n"])

    lengths = vectors.mapInArrow(run, "length long, n long").filter("length > 0").groupBy("length").agg(F.sum("n").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return first["length"] if first else 0


def exact_sums(vectors: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Number of usable vectors and the sum of each dimension."""

    def partial(columns: Iterator[pa.Array]) -> dict:
        total, count = [0] * dimensions, 0
        for rows, x in (block for column in columns for block in _blocks(column, dimensions)):
            count += len(rows)
            high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
            total = [t + (h << 26) + v for t, h, v in zip(total, high, low)]
        return {(-1, 0): count} | {(i, 0): t for i, t in enumerate(total)}

    got = _total(vectors, partial)
    return got.get((-1, 0), 0), [got.get((i, 0), 0) for i in range(dimensions)]


def _products(z: np.ndarray) -> np.ndarray:
    """z'z in whole numbers."""
    largest = int(np.abs(z).max(initial=0))
    rows = (1 << 53) // max(1, largest * largest)  # so many rows are exact in floating point
    if rows < 64:
        z = z.astype(object)
        return z.T.dot(z)
    out = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), rows):
        part = z[at : at + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def exact_scatter(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the whole numbers with divisor n, each entry rounded once."""
    dimensions = len(sums)
    held = Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    middle, rest = held.middle, held.rest

    def partial(columns: Iterator[pa.Array]) -> dict:
        scatter = np.zeros((dimensions, dimensions), object)
        for column in columns:
            for _, x in _blocks(column, dimensions):
                scatter += _products(x - middle)
        return {(int(i), int(j)): scatter[i, j] for i, j in zip(*np.triu_indices(dimensions))}

    got = _total(vectors, partial)
    out = np.zeros((dimensions, dimensions))
    for (i, j), value in got.items():
        out[i, j] = out[j, i] = (n * value - rest[i] * rest[j]) / (n * n)
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """Columns a with a a' = v, as many as v has rank; triangular in the order in which rows were chosen."""
    left = v.copy()
    floor = len(v) * np.finfo(float).eps * left.diagonal().max(initial=0.0)
    done = np.zeros(len(v), bool)
    columns = []
    for _ in range(len(v)):
        at = int(np.argmax(np.where(done, -np.inf, left.diagonal())))
        pivot = left[at, at]
        if not pivot > floor:
            break
        column = np.where(done, 0.0, left[:, at] / np.sqrt(pivot))
        column[at] = np.sqrt(pivot)
        columns.append(column)
        left -= np.outer(column, column)
        done[at] = True
    return np.column_stack(columns) if columns else np.zeros((len(v), 0))


def one_sided_jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and components of a a': pairs of columns are turned until all are orthogonal."""
    rank = a.shape[1]
    size = rank + rank % 2
    columns = np.zeros((size, len(a)))
    columns[:rank] = a.T
    ring = np.arange(size)
    for _ in range(SWEEPS):
        largest = 0.0
        for _ in range(size - 1):  # a tournament: every column meets every other one once a sweep
            p, q = ring[: size // 2], ring[size // 2 :][::-1]
            one, two = columns[p], columns[q]
            alpha, beta, gamma = (one * one).sum(axis=1), (two * two).sum(axis=1), (one * two).sum(axis=1)
            scale = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), scale, out=np.zeros_like(scale), where=scale > 0)
            largest = max(largest, float(cosine.max()))
            turn = cosine > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            tangent = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, tangent)
            sin = cos * tangent
            columns[p], columns[q] = cos[:, None] * one - sin[:, None] * two, sin[:, None] * one + cos[:, None] * two
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if largest < 1e-15:
            break
    values = (columns * columns).sum(axis=1)
    order = np.argsort(-values, kind="stable")[:rank]
    values = values[order]
    return values, (columns[order] / np.sqrt(np.where(values > 0, values, 1.0))[:, None]).T


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> Whitening | None:
    """Learn from all usable vectors; None if there are none.

    Directions in which the vectors do not vary are no components, so there may be fewer than asked for.
    """
    only = vectors.select(F.col(f"`{embedding}`").alias("_v"))
    dimensions = commonest_length(only)
    n, sums = exact_sums(only, dimensions)
    if not n:
        return None
    covariance = exact_scatter(only, n, sums)
    values, directions = one_sided_jacobi(pivoted_cholesky(covariance))
    return Whitening(n, sums, np.ascontiguousarray(directions[:, :components]), values[:components], float(covariance.trace()))


def _project(model: Whitening, x: np.ndarray) -> np.ndarray:
    fraction = np.array([r / model.n for r in model.rest])
    return ((x - model.middle) - fraction) @ model.components / np.sqrt(model.eigenvalues)


def _deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2; null beyond a long."""
    z, rest = x - model.middle, model.rest
    if len(rest) * (model.n * (int(np.abs(z).max(initial=0)) + 1)) ** 2 < _LONG:
        y = model.n * z - np.array(rest, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = model.n * z.astype(object) - np.array(rest, object)
    return [int(s) if s <= _LONG else None for s in (y * y).sum(axis=1)]


def whiten(vectors: DataFrame, model: Whitening | None, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``whitened`` (one double per component) and ``deviation`` (long); every row is kept.

    Both are null where the vector is null or empty, holds an entry that is null or not
    finite, or has another length than those the model was learned from, and everywhere
    without a model. The deviation is also null where it exceeds a long. Columns that
    already bear one of these names are replaced.
    """
    kept = without(vectors, ["whitened", "deviation"])
    out = T.StructType([*kept.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    if model is None:
        return kept.select("*", F.lit(None).cast(out["whitened"].dataType).alias("whitened"), F.lit(None).cast("long").alias("deviation"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for batch in batches:
            whitened, deviation = [None] * batch.num_rows, [None] * batch.num_rows
            for rows, x in _blocks(batch.column(batch.schema.names.index(embedding)), len(model.sums)):
                for i, w, d in zip(rows.tolist(), _project(model, x), _deviations(model, x)):
                    whitened[i], deviation[i] = w, d
            columns = [*batch.columns, pa.array(whitened, schema.field("whitened").type), pa.array(deviation, pa.int64())]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return kept.mapInArrow(run, out)


def identity_error(whitened: DataFrame, components: int, n: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components))
        for batch in batches:
            w = batch.column(0).drop_null().flatten().to_numpy().reshape(-1, components)
            total[:components] += w.T @ w
            total[components] += w.sum(axis=0)
        i, j = np.divmod(np.arange(total.size), max(1, components))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

    sums = np.zeros((components + 1, components))
    for r in whitened.select("whitened").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        sums[r["i"], r["j"]] = r["value"]
    mean = sums[components] / n  # zero but for rounding, as the vectors were centred before
    return float(np.abs(sums[:components] / n - np.outer(mean, mean) - np.eye(components)).max(initial=0.0))


def whitened_components(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, of another length than most, or that hold a null or
    non-finite entry have no rows and are not learned from. Entries beyond 2**50 / 1024
    count as that. Repeated vectors count each time, ids may repeat or be null; other columns
    are not read. Components without variance are left out: equal vectors, a single one
    or none give no rows.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    model = fit_whitening(rows, components)
    made = whiten(rows, model).filter("whitened IS NOT NULL").select("vec_id", "whitened", "deviation")
    k = 0 if model is None else len(model.eigenvalues)
    error = identity_error(made, k, model.n) if k else 0.0
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]) if k else F.array().cast("array<double>")
    long_rows = made.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return long_rows.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
