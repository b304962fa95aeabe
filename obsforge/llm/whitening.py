"""Whitening of vectors by a covariance from polarisation: squares only, no product of two dimensions.

Entries become whole numbers, so that every sum is exact. With n distinct vectors and sums S, each task adds up the squares
of n x_i - S_i for every dimension and of their sums for every pair of dimensions; half of what the variance of a sum has
beyond the two variances is the covariance. Squares are taken of two or three short digits each, so that they fit
64 bits, and the digits' sums are put together as whole numbers of any size in the driver, d (d + 1) / 2 of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

SCALE = 256.0
COMPONENTS = 4
DIGIT = 24  # bits of a digit of a centred entry
CHUNK = 4096  # vectors whose squares are added at once: 2 ** 12 products of 2 ** 50 fit 64 bits
MAX_LONG = (1 << 63) - 1


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as 64-bit numbers; what lies beyond them becomes the nearest one."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values.astype(np.float64))
    inside = np.clip(scaled, -(2.0**63), 2.0**62)
    out = inside.astype(np.int64)
    large = scaled > 2.0**62
    if large.any():
        out[large] = [min(int(x), MAX_LONG) if math.isfinite(x) else MAX_LONG for x in scaled[large].tolist()]
    return out


def narrow(row: np.ndarray) -> bytes:
    """The same bytes for the same numbers, two or eight a number."""
    small = row.astype("<i2")
    return b"2" + small.tobytes() if (small == row).all() else b"8" + row.astype("<i8").tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"2" else "<i8", offset=1).astype(np.int64)


def vectors_of(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, x) of the vectors that are not null and hold only finite entries."""
    flat = column.flatten().cast(pa.float64())
    good = np.isfinite(flat.to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0, bool)  # null becomes NaN
    x = quantised(np.where(good, flat.to_numpy(zero_copy_only=False), 0.0)) if len(flat) else np.zeros(0, np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(there, np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    ends = np.cumsum(lengths)
    for k in np.flatnonzero(there).tolist():
        a, b = int(ends[k] - lengths[k]), int(ends[k])
        if b > a and good[a:b].all():
            yield k, x[a:b]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S of each row, in 64 bits if it surely fits them, else as whole numbers of any size."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(z: np.ndarray) -> list[int]:
    """Exact sum of the squares of each column."""
    if z.dtype == object:
        return [int(s) for s in (z * z).sum(axis=0)]
    z = np.abs(z)
    most, total, digits = int(z.max()) if z.size else 0, [0] * z.shape[1], []
    while most:
        digits.append(z & ((1 << DIGIT) - 1))
        z, most = z >> DIGIT, most >> DIGIT
    for i, a in enumerate(digits):
        for j, b in enumerate(digits[i:], i):
            part = np.einsum("ij,ij->j", a, b)
            total = [t + (int(p) << (DIGIT * (i + j) + (i != j))) for t, p in zip(total, part.tolist(), strict=True)]
    return total


def pair_squares(y: np.ndarray) -> list[int]:
    """Of each dimension i, the sums of y_i ** 2 and of (y_i + y_j) ** 2 for j > i, in sequence."""
    out = []
    for i in range(y.shape[1]):
        own = y[:, i : i + 1]
        out += squares(np.concatenate([own, y[:, i + 1 :] + own], axis=1))
    return out


class Fit(NamedTuple):
    n: int
    sums: list[int]
    axes: np.ndarray  # unit eigenvectors in rows, the largest eigenvalue first
    values: np.ndarray  # their eigenvalues
    trace: float


def fit_axes(n: int, sums: list[int], pairs: list[int]) -> Fit:
    """Eigenvectors of the covariance that the squares of pair_squares over all n vectors give."""
    d, at = len(sums), 0
    own, both = [0] * d, {}
    for i in range(d):
        own[i] = pairs[at]
        for j in range(i + 1, d):
            both[i, j] = pairs[at + j - i]
        at += d - i
    covariance = np.diag([q / n**3 for q in own])
    for (i, j), q in both.items():
        covariance[i, j] = covariance[j, i] = (q - own[i] - own[j]) / (2 * n**3)
    # Not numpy's trace: its sum of doubles would do as well, this one is rounded once.
    values, vectors = np.linalg.eigh(covariance)
    values, axes = values[::-1], vectors.T[::-1]
    turned = axes * np.sign(axes[np.arange(d), np.abs(axes).argmax(axis=1)])[:, None]
    return Fit(n, sums, turned, np.where(values > values.max(initial=0) * 1e-13, values, 0.0), sum(own) / n**3)


def projected(fit: Fit, y: np.ndarray, components: int) -> np.ndarray:
    """Whitened values of rows n x - S; NaN for a component without variance."""
    values = fit.values[:components]
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(values > 0, 1 / np.sqrt(values), np.nan)
    return (y / fit.n).astype(np.float64) @ fit.axes[:components].T * scale


def rows_by_length(vectors: list[bytes]) -> dict[int, np.ndarray]:
    """Matrices of the vectors of each length."""
    found: dict[int, list[np.ndarray]] = {}
    for x in map(widened, vectors):
        found.setdefault(len(x), []).append(x)
    return {d: np.stack(x) for d, x in found.items()}


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Each entry c becomes x = floor(256 c), kept within 64 bits. The covariance is that of the distinct vectors x, n of them. deviation,
    the sum over dimensions of (n x - S) ** 2, is a decimal(38, 0), null where it has more digits. A vector has as many
    components as dimensions if those are fewer; whitened is null for a component without variance, as are all for n = 1.
    identity_error is the largest difference between the covariance of all whitened distinct vectors and the identity.

    Vectors that are null, empty or hold a null or non-finite entry have no row. Rows that repeat an id or a vector each have their
    own rows, but a repeated vector counts once in the fit; a null id stays null; an empty table gives no row. Vectors of
    another length have a fit of their own.
    """
    source = rows.select(F.col(id).alias("id"), F.col(vector).alias("vector"))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [(len(v), narrow(v)) for _, v in vectors_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in x], pa.int32()), pa.array([raw for _, raw in x], pa.binary())], names=["d", "x"])

    distinct = written(source.select("vector").mapInArrow(quantise, "d int, x binary").distinct())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in slices(batches, CHUNK):
            for d, x in rows_by_length(batch.column(1).to_pylist()).items():
                high, low = x >> 32, x & 0xFFFFFFFF
                parts = [(int(a) << 32) + int(b) for a, b in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
                before = sums.setdefault(d, [0] * (d + 1))
                sums[d] = [a + b for a, b in zip(before, [len(x), *parts], strict=True)]
        yield entries(sums)

    totals = summed(distinct.mapInArrow(add, ENTRY))
    counted = {d: (x[0], x[1:]) for d, x in totals.items()}

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for batch in slices(batches, CHUNK):
            for d, x in rows_by_length(batch.column(1).to_pylist()).items():
                part = pair_squares(centred(x, *counted[d]))
                found[d] = [a + b for a, b in zip(found[d], part, strict=True)] if d in found else part
        yield entries(found)

    fits = {d: fit_axes(*counted[d], pairs) for d, pairs in summed(distinct.mapInArrow(square, ENTRY)).items()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments: dict[int, np.ndarray] = {}
        for batch in slices(batches, CHUNK):
            for d, x in rows_by_length(batch.column(1).to_pylist()).items():
                w = projected(fits[d], centred(x, *counted[d]), components)
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                moments[d] = moments.get(d, 0) + w.T @ w
        flat = [(d, k, v) for d, m in moments.items() for k, v in enumerate(m.ravel().tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate([pa.int32(), pa.int32(), pa.float64()])], names=["d", "k", "v"])

    moments = distinct.mapInArrow(spread, "d int, k int, v double").groupBy("d", "k").agg(F.sum("v").alias("v")).collect()
    errors = {}
    for d, fit in fits.items():
        side = min(d, components) + 1
        m = np.zeros(side * side)
        for r in moments:
            if r.d == d:
                m[r.k] = r.v
        m = m.reshape(side, side) / fit.n
        error = np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(side - 1))
        errors[d] = float(np.nanmax(error)) if np.isfinite(error).any() else None

    kind = T.StructType([source.schema["id"]]).add("component", T.IntegerType()).add("n", "long").add("deviation", T.DecimalType(38, 0)).add("whitened", "double").add("explained", "double").add("identity_error", "double")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in slices(batches, CHUNK):
            by_length: dict[int, tuple[list[int], list[np.ndarray]]] = {}
            for k, x in vectors_of(batch.column(1)):
                places, found = by_length.setdefault(len(x), ([], []))
                places.append(k)
                found.append(x)
            for d, (places, found) in by_length.items():
                fit, c = fits[d], min(d, components)
                y = centred(np.stack(found), *counted[d])
                whitened = projected(fit, y, components)
                deviation = [v if v < 10**38 else None for v in (squares(np.ascontiguousarray(r[:, None]))[0] for r in y)]
                values = [
                    batch.column(0).take(pa.array(np.repeat(places, c))), np.tile(np.arange(1, c + 1), len(y)), [fit.n] * (c * len(y)),
                    [v for v in deviation for _ in range(c)], pa.array(whitened.ravel(), from_pandas=True),
                    np.tile(fit.values[:c] / fit.trace if fit.trace else np.zeros(c), len(y)), [errors[d]] * (c * len(y)),
                ]
                columns = [v if isinstance(v, pa.Array) else decimals(v) if pa.types.is_decimal(f.type) else pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(project, kind).withColumnRenamed("id", id)


def decimals(values: list[int | None]) -> pa.Array:
    from decimal import Context, Decimal

    wide = Context(prec=40)
    return pa.array([None if v is None else wide.create_decimal(v) for v in values], pa.decimal128(38, 0))


#: Entry k of a length's sums in digits of 2 ** 32, the highest signed.
ENTRY = "d int, k int, place int, digit long"


def entries(sums: dict[int, list[int]]) -> pa.RecordBatch:
    flat = []
    for d, values in sums.items():
        for k, v in enumerate(values):
            place = 0
            while not -(1 << 31) <= v < 1 << 31:
                flat.append((d, k, place, v & 0xFFFFFFFF))
                v, place = v >> 32, place + 1
            flat.append((d, k, place, v))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate([pa.int32(), pa.int32(), pa.int32(), pa.int64()])], names=["d", "k", "place", "digit"])


def summed(rows: DataFrame) -> dict[int, list[int]]:
    """The tasks' entries added up; as many as a length has pairs of dimensions."""
    out: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("d", "k", "place").agg(F.sum("digit").alias("digit")).collect():
        of = out.setdefault(r.d, {})
        of[r.k] = of.get(r.k, 0) + (r.digit << (32 * r.place))
    return {d: [of[k] for k in range(len(of))] for d, of in out.items()}
