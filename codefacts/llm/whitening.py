"""Whitening of integer-scaled embeddings from exact covariances, which polarisation takes from sums of squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_table, new_table_path
from .common import named

#: Sums cross from tasks to Spark as digits to this base, the last of them signed; a sum of longs can't overflow.
DIGIT, DIGITS = 40, 6
_ROWS = 2048
_SUMS = "i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))


def _digits(value: int) -> list[int]:
    out = []
    for _ in range(DIGITS - 1):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def _value(row) -> int:
    return sum(int(row[f"d{k}"]) << (DIGIT * k) for k in range(DIGITS))


def _sum_rows(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """One row per key with the digits of its sum."""
    places, digits = list(totals), [_digits(t) for t in totals.values()]
    columns = [pa.array([p[k] for p in places], pa.int32()) for k in (0, 1)]
    columns += [pa.array([d[k] for d in digits], pa.int64()) for k in range(DIGITS)]
    return pa.RecordBatch.from_arrays(columns, ["i", "j", *(f"d{k}" for k in range(DIGITS))])


def _vectors(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, as longs where they fit and else as Python's integers."""
    if n * _largest(x) + max(abs(s) for s in sums) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of columns of longs, whose halves are summed apart, or of Python's integers."""
    if x.dtype == object:
        return [int(s) for s in x.sum(axis=0)]
    return [(int(h) << 31) + int(low) for h, low in zip((x >> 31).sum(axis=0), (x & ((1 << 31) - 1)).sum(axis=0), strict=True)]


def square_sums(y: np.ndarray) -> list[int]:
    """The exact sum of squares of every column."""
    most = _largest(y)
    if y.dtype == object or most >= 1 << 60:
        return _column_sums(y.astype(object) ** 2)
    if most < 1 << 31:
        return _column_sums(y * y)
    high, low = y >> 30, y & ((1 << 30) - 1)
    parts = (_column_sums(high * high), _column_sums(high * low), _column_sums(low * low))
    return [(a << 60) + (b << 31) + c for a, b, c in zip(*parts, strict=True)]


def _summed(df: DataFrame, partial) -> dict[tuple[int, int], int]:
    """Sums over all rows; a task passes on one row per key, whatever it reads."""
    parts = df.mapInArrow(partial, _SUMS).groupBy("i", "j").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)))
    return {(r["i"], r["j"]): _value(r) for r in parts.collect()}


def _add(totals: dict, more: Iterator[tuple[tuple[int, int], int]]) -> None:
    for key, value in more:
        totals[key] = totals.get(key, 0) + value


def covariances(fit: DataFrame, dim: int) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """n, the sums of every dimension, and n^3 times every covariance (i <= j) of the rows ``x`` of ``fit``, all exact.

    The second pass sums the squares of the centred values of every dimension, and of the sum of every two dimensions.
    Half the difference between the square of a sum and those of its terms is their product.
    """

    def totals(batches):
        out: dict = {}
        for _, x in _vectors(batches, dim):
            _add(out, (((0, 0), x.shape[0]),))
            _add(out, (((1, j), s) for j, s in enumerate(_column_sums(x))))
        yield _sum_rows(out)

    first = _summed(fit, totals)
    n, sums = first.get((0, 0), 0), [first.get((1, j), 0) for j in range(dim)]
    if not n:
        return 0, sums, {}

    def squares(batches):
        out: dict = {}
        for _, x in _vectors(batches, dim):
            y = centred(x, n, sums)
            _add(out, (((i, i), s) for i, s in enumerate(square_sums(y))))
            for i in range(dim - 1):
                _add(out, (((i, i + 1 + j), s) for j, s in enumerate(square_sums(y[:, i + 1 :] + y[:, i : i + 1]))))
        yield _sum_rows(out)

    q = _summed(fit, squares)
    return n, sums, {(i, j): q[i, j] if i == j else (q[i, j] - q[i, i] - q[j, j]) // 2 for i, j in q}


def components(n: int, cov: dict[tuple[int, int], int], dim: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues, their unit vectors as rows (largest entry positive) and the trace."""
    matrix = np.zeros((dim, dim))
    for (i, j), value in cov.items():
        matrix[i, j] = matrix[j, i] = value / n**3
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:k]
    rows = vectors.T[order]
    rows = rows * np.where(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return values[order], rows, float(np.trace(matrix))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """Each vector on the first ``k`` whitened components: (id, component from 1, n, deviation, whitened, explained,
    identity_error).

    Entries become ``floor(scale * c)``. The fit list is every distinct vector of those once; n, sums and covariances are
    exact integers over it, so order and partitions change nothing. The driver holds one number per pair of dimensions,
    never a number per row. ``deviation`` is a decimal(38,0), null beyond 38 digits.

    Defined cases: rows whose vector is null, empty, holds a null, NaN, infinite or (after scaling) 2^62 or larger entry
    are left out; so are rows of another length than most have (ties: the longer). Repeated rows are returned once
    each, with a null id too. A component without variance (at most dim * 2^-52 of the largest) has a null ``whitened``, and
    ``explained`` is null where nothing varies. With fewer than k dimensions there are as many components as dimensions.
    Other columns stay out, whatever their names. An empty table gives no rows.
    """
    spark = df.sparkSession
    c = named(vector_col)
    fine = F.forall(c, lambda e: F.coalesce(F.abs(e.cast("double") * scale) < 2.0**62, F.lit(False)))
    x = F.transform(c, lambda e: F.floor(F.when(F.abs(e.cast("double") * scale) < 2.0**62, e.cast("double") * scale)))
    rows = df.filter(c.isNotNull() & (F.size(c) > 0) & fine).select(named(id_col).alias("id"), x.cast("array<long>").alias("x"))
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    kind = dict(df.dtypes)[id_col]
    shape = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], shape).withColumnRenamed("id", id_col)
    dim = common["dim"]
    rows = rows.filter(F.size("x") == dim)

    # one row per distinct vector; copies meet before the shuffle, so a hot vector sends one row per task
    path = new_table_path(spark, "fit")
    rows.select("x").distinct().write.parquet(path)
    fit = spark.read.schema("x array<long>").parquet(path)
    n, sums, cov = covariances(fit, dim)
    values, vectors, trace = components(n, cov, dim, min(k, dim))
    alive = values > values[0] * dim * 2.0**-52
    unit = vectors / np.sqrt(np.where(alive, values, 1.0))[:, None]

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = centred(x, n, sums)
        return y, (y.astype(float) / n) @ unit.T

    def whitened_sums(batches):
        total = np.zeros(len(unit))
        for _, x in _vectors(batches, dim):
            total += projected(x)[1].sum(axis=0)
        yield pa.RecordBatch.from_pylist([{"v": total.tolist()}])

    def whitened_products(means):
        def partial(batches):
            total = np.zeros((len(unit), len(unit)))
            for _, x in _vectors(batches, dim):
                w = projected(x)[1] - means
                total += w.T @ w
            yield pa.RecordBatch.from_pylist([{"v": total.ravel().tolist()}])

        return partial

    def folded(partial, size: int) -> np.ndarray:
        parts = fit.mapInArrow(partial, "v array<double>").agg(*(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(size)))
        return np.array(list(parts.first()))

    m = len(unit)
    means = folded(whitened_sums, m) / n
    found = folded(whitened_products(means), m * m).reshape(m, m) / n
    off = np.abs(found - np.eye(m))[np.ix_(alive, alive)]
    error = float(off.max()) if off.size else None
    delete_table(spark, path)
    shares = [float(max(v, 0.0) / trace) if trace > 0 else None for v in values]
    decimal = pa.decimal128(38, 0)

    def project(batches):
        for batch, x in _vectors(batches, dim):
            y, w = projected(x)
            if y.dtype != object and dim * _largest(y) ** 2 < 1 << 62:
                far = (y * y).sum(axis=1).tolist()
            else:
                far = [int(f) for f in (y.astype(object) ** 2).sum(axis=1)]
            far = pa.array([f if f < 10**38 else None for f in map(int, far)], decimal)
            size = batch.num_rows
            once = pa.array(np.repeat(np.arange(size), m))
            shown = np.where(alive, w, 0.0).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(once), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                pa.array(np.full(size * m, n)), far.take(once), pa.array(shown, mask=np.tile(~alive, size)),
                pa.array(shares * size, pa.float64()), pa.array([error] * (size * m), pa.float64()),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, shape).withColumnRenamed("id", id_col)
