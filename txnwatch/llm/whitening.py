"""Whitening of vectors by polarisation covariance.

Entries become whole numbers x = floor(scale * c) + shift. The fit list is every distinct x vector
once. Covariances come from squares alone: for every dimension i and every pair (i, j) the exact
sums of squares of centred x_i and of centred x_i + x_j are aggregated, and

    cov(i, j) = (var(x_i + x_j) - var(x_i) - var(x_j)) / 2

Values are centred before they are squared, at each dimension's mean rounded to a whole number
(so numbers stay whole and small); what the rounding leaves is a whole number r = S - n * centre
per dimension and is taken off the sums exactly: n * sum(y^2) - r^2 is n^2 times the variance.
The d * (d + 1) / 2 sums are all that reaches the driver, which calls ``eigh`` on the matrix.
Rows are then projected where they are.

Vectors of different lengths are different spaces and are whitened apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.tables import kept

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Entries handled at a time in a task, and sums that whole numbers of 64 bits hold for sure.
SLAB, SAFE = 1 << 20, float(1 << 62)
SUMS = "size int, i int, j int, total decimal(38,0)"


def whole_vectors(
    lists: pa.ListArray, scale: float = SCALE, shift: int = SHIFT
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the sound vectors of a list column, by length and some rows at a time."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * scale) + 0.0
        bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < SAFE))])
    sound = (bad[offsets[1:]] == bad[offsets[:-1]]) & (sizes > 0)
    if lists.null_count:
        sound &= lists.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sound]):
        rows = np.flatnonzero(sound & (sizes == size))
        for start in range(0, len(rows), max(1, SLAB // size)):
            some = rows[start : start + max(1, SLAB // size)]
            yield some, scaled[offsets[some, None] + np.arange(size)].astype(np.int64) + shift


def _packed(x: np.ndarray, shift: int) -> Iterator[pa.Array]:
    """Rows as bytes, each in the narrowest of three widths that holds its distance to ``shift``."""
    y = x - shift
    reach = np.abs(y).max(axis=1)
    narrow, middle = reach < 1 << 15, reach < 1 << 31
    for rows, kind in ((narrow, "<i2"), (middle & ~narrow, "<i4"), (~middle, "<i8")):
        if rows.any():
            data = np.ascontiguousarray(y[rows].astype(kind))
            edges = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
            buffers = [None, pa.py_buffer(edges), pa.py_buffer(data)]
            yield pa.Array.from_buffers(pa.binary(), len(data), buffers)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, distances to the shift) of a batch of packed vectors, some rows at a time."""
    sizes = batch.column(0).to_numpy()
    widths = pc.binary_length(batch.column(1)).to_numpy() // sizes
    for size in np.unique(sizes):
        for width in (2, 4, 8):
            rows = np.flatnonzero((sizes == size) & (widths == width))
            for start in range(0, len(rows), max(1, SLAB // size)):
                some = batch.column(1).take(pa.array(rows[start : start + max(1, SLAB // size)]))
                raw = b"".join(some.to_pylist())
                yield int(size), np.frombuffer(raw, f"<i{width}").reshape(-1, size).astype(np.int64)


def fit_list(vectors: DataFrame, column: str, scale: float, shift: int) -> DataFrame:
    """(size, packed) of every distinct x vector, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_vectors(batch.column(0), scale, shift):
                for packed in _packed(x, shift):
                    size = pa.array(np.full(len(packed), x.shape[1], np.int32))
                    yield pa.RecordBatch.from_arrays([size, packed], ["size", "packed"])

    read = vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v"))
    return read.where("v IS NOT NULL").mapInArrow(run, "size int, packed binary").distinct()


def _square_sums(y: np.ndarray) -> np.ndarray:
    """Exact sums over rows of squares: entry (i, j) that of y_i + y_j, entry (i, i) of y_i."""
    size = y.shape[1]
    if 4.0 * float(np.abs(y).max(initial=0)) ** 2 * len(y) >= SAFE:
        y = y.astype(object)
    columns = np.ascontiguousarray(y.T)
    out = np.zeros((size, size), y.dtype)
    for i in range(size):
        both = columns[i] + columns[i + 1 :]
        if y.dtype == object:
            out[i, i + 1 :] = (both * both).sum(axis=1) if both.size else 0
        else:
            out[i, i + 1 :] = np.einsum("ij,ij->i", both, both)
        out[i, i] = (columns[i] * columns[i]).sum()
    return out


def _aggregated(
    fit: DataFrame, sums: Callable[[int, np.ndarray], tuple[list, list, list]]
) -> dict[int, dict[tuple[int, int], int]]:
    """Exact sums over the fit list per vector length: each task adds up its own, Spark adds
    those by place. The result has as many numbers as one task's, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, y in _unpacked(batch):
                part = sums(size, y).astype(object)
                totals[size] = totals[size] + part if size in totals else part
        for size, total in totals.items():
            i, j = np.triu_indices(total.shape[0], m=total.shape[1])
            numbers = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
            place = [pa.array(k.astype(np.int32)) for k in (np.full(len(i), size), i, j)]
            yield pa.RecordBatch.from_arrays([*place, numbers], ["size", "i", "j", "total"])

    rows = fit.mapInArrow(run, SUMS).groupBy("size", "i", "j").agg(F.sum("total")).collect()
    out: dict[int, dict[tuple[int, int], int]] = {}
    for size, i, j, total in rows:
        out.setdefault(size, {})[i, j] = int(total)
    return out


class Whitening:
    """What rows of one vector length are whitened with."""

    def __init__(self, n: int, sums: list[int], shift: int, squares: dict[tuple[int, int], int],
                 components: int):
        size = len(sums)
        self.n = n
        self.centre = [(2 * s + n) // (2 * n) for s in sums]  # relative to the shift
        self.rest = [s - n * c for s, c in zip(sums, self.centre)]
        self.middle = np.array(self.centre, np.int64)
        self.shift = shift

        def spread(i: int, j: int) -> int:
            """n^2 times the variance of x_i + x_j, or of x_i."""
            rest = self.rest[i] + (self.rest[j] if i != j else 0)
            return n * squares[i, j] - rest * rest

        alone = [spread(i, i) for i in range(size)]
        self.covariance = np.empty((size, size))
        for i in range(size):
            self.covariance[i, i] = alone[i] / (n * n)
            for j in range(i + 1, size):
                twice = spread(i, j) - alone[i] - alone[j]
                self.covariance[i, j] = self.covariance[j, i] = twice / (2 * n * n)
        values, vectors = np.linalg.eigh(self.covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        trace = float(np.trace(self.covariance))
        # directions without spread can't be scaled to spread one
        self.k = int((values[:components] > trace * 1e-12).sum()) if trace > 0 else 0
        values, vectors = values[: self.k], vectors[:, : self.k]
        places = (np.abs(vectors).argmax(axis=0), np.arange(self.k))
        self.project = vectors * np.where(vectors[places] < 0, -1.0, 1.0) / np.sqrt(values)
        self.explained = values / trace if trace > 0 else values
        self.identity_error = 0.0

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of distances to the shift, projected; the centre is taken off before."""
        rest = np.array([r / self.n for r in self.rest])
        return ((y - self.middle).astype(float) - rest) @ self.project

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2; null where a bigint can't hold it."""
        y = y - self.middle
        reach = self.n * (float(np.abs(y).max(initial=0)) + 1)
        if reach * reach * y.shape[1] >= SAFE:
            y = y.astype(object)
        far = self.n * y - np.array(self.rest, y.dtype)
        return [int(v) if v < 1 << 63 else None for v in (far * far).sum(axis=1)]


def fit(
    vectors: DataFrame,
    column: str = "embedding",
    components: int = COMPONENTS,
    scale: float = SCALE,
    shift: int = SHIFT,
) -> dict[int, Whitening]:
    """A whitening for every vector length of ``vectors``, fitted on all distinct x vectors."""
    distinct = kept(fit_list(vectors, column, scale, shift), "whitening-fit")

    def plain(size: int, y: np.ndarray) -> np.ndarray:
        if float(np.abs(y).max(initial=0)) * len(y) >= SAFE:
            y = y.astype(object)
        return np.concatenate([[len(y)], y.sum(axis=0)]).reshape(1, -1)

    first = _aggregated(distinct, plain)
    counts = {size: t[0, 0] for size, t in first.items()}
    sums = {size: [t[0, k + 1] for k in range(size)] for size, t in first.items()}
    centres = {
        size: np.array([(2 * s + counts[size]) // (2 * counts[size]) for s in total], np.int64)
        for size, total in sums.items()
    }
    squares = _aggregated(distinct, lambda size, y: _square_sums(y - centres[size]))
    fitted = {
        size: Whitening(counts[size], sums[size], shift, squares[size], components) for size in sums
    }
    for size, error in _identity_errors(distinct, fitted).items():
        fitted[size].identity_error = error
    return fitted


def _identity_errors(distinct: DataFrame, fitted: dict[int, Whitening]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance less the identity. Its values
    are centred as they are made; the covariance comes from squares of sums as above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, y in _unpacked(batch):
                w = fitted[size].whitened(y)
                part = np.vstack([_square_sums(w), w.sum(axis=0)])
                totals[size] = totals[size] + part if size in totals else part
        for size, total in totals.items():
            i, j = map(np.ravel, np.indices(total.shape, np.int32))
            place = [np.full(total.size, size, np.int32), i, j, total.ravel()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, place)), ["size", "i", "j", "total"])

    sums = distinct.mapInArrow(run, "size int, i int, j int, total double")
    found: dict[int, dict] = {}
    for size, i, j, total in sums.groupBy("size", "i", "j").agg(F.sum("total")).collect():
        found.setdefault(size, {})[i, j] = total
    errors = {}
    for size, model in fitted.items():
        k, n, t = model.k, model.n, found.get(size, {})
        mean = [t[k, i] / n for i in range(k)]
        var = {(i, j): t[i, j] / n - (mean[i] + (mean[j] if i != j else 0)) ** 2
               for i in range(k) for j in range(i, k)}
        errors[size] = max(
            (abs(v - 1) if i == j else abs(v - var[i, i] - var[j, j]) / 2 for (i, j), v in var.items()),
            default=0.0,
        )
    return errors


def whiten(
    vectors: DataFrame,
    id_column: str = "vec_id",
    column: str = "embedding",
    components: int = COMPONENTS,
    scale: float = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """One row per row of ``vectors`` and component: vec_id, component (from 1), n (fit list),
    deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, has null or non-finite entries, or entries that as x don't
    fit a bigint are left out. Rows that repeat, and equal vectors, each get their own rows but
    count once in the fit list; a null id stays null. Components without spread (fewer distinct
    vectors than components, or equal dimensions) have no rows. Other columns are not read. An
    empty table gives an empty result.
    """
    fitted = fit(vectors, column, components, scale, shift)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1), scale, shift):
                model, y = fitted[x.shape[1]], x - shift
                if not model.k:
                    continue
                each, m = np.repeat(np.arange(len(rows)), model.k), len(rows)
                deviation = pa.array(model.deviations(y), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows[each])),
                        pa.array(np.tile(np.arange(1, model.k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * model.k, model.n, np.int64)),
                        deviation.take(pa.array(each)),
                        pa.array(model.whitened(y).ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * model.k, model.identity_error)),
                    ],
                    names,
                )

    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    read = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"),
        F.col(f"`{column}`").cast("array<double>").alias("v"),
    )
    return read.where("v IS NOT NULL").mapInArrow(run, schema)
