"""Whitening of vectors by an exact integer scatter.

Entries become whole numbers, x = floor(256 c). Tasks subtract a shift from them, cut what is left
into digits of 20 bits and multiply digit by digit: such products, of so many rows at a time, are
exact in double precision, and their sums are carried on as whole numbers. The digits are put
together as integers of any length, so n XᵀX - SSᵀ is exact whatever the shift, the offset of the
data or the order of the tasks; only then it becomes floating point and is decomposed. A dimension
far off zero loses no digit to it.

The model is fitted on each distinct x vector once and applied to all rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import discard, materialize, ship

#: Whole numbers a unit of an entry.
SCALE = 256
#: Bits of a digit, rows whose products of digits are summed in double precision (2 x 20 + 12 < 53),
#: and such sums that fit into a long.
DIGIT, ROWS, SUMS = 20, 4096, 1024
#: Vectors whose medians are the shift; it has no bearing on the result.
SHIFT_SAMPLE = 1000
#: Components that are kept.
COMPONENTS = 4
PRIMES = (2147483647, 2147483629)


def usable(vector: Column) -> Column:
    """The vector is there, not empty, and all of its entries are finite numbers."""
    value = lambda c: c.cast("double")
    broken = F.exists(vector, lambda c: c.isNull() | F.isnan(value(c)) | (F.abs(value(c)) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~broken


def whole(vector: Column) -> Column:
    """Entries as longs; such as leave the range of a long become its ends."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers (rows, d) as digits of 20 bits, lowest first; the last one has the sign."""
    out = []
    while max(abs(int(y.min())), abs(int(y.max()))) >> DIGIT:
        out.append((y & ((1 << DIGIT) - 1)).astype(np.float64))
        y = y >> DIGIT
    return [*out, y.astype(np.float64)]


def _minus(x: np.ndarray, shift: list[int], factor: int = 1) -> np.ndarray:
    """factor * x - shift without overflow: as longs where they hold it, else as Python's numbers."""
    far = factor * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, shift))
    return x * factor - np.array(shift, np.int64) if far < 1 << 62 else x.astype(object) * factor - np.array(shift, object)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for start in range(0, b.num_rows, ROWS):
            part = b.slice(start, ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _scatter(d: int, shift: list[int]):
    """Sums and cross-products of a task's vectors: rows (i, j, bits, value) say that value times
    2^bits belongs to entry (i, j), j >= i; j is -1 for the sum of dimension i, and both are for
    the number of vectors."""
    i, j = np.triu_indices(d)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, blocks, sums, products = 0, 0, {}, {}

        def told() -> Iterator[pa.RecordBatch]:
            out = [(np.full(1, -1), np.full(1, -1), 0, np.full(1, n))]
            out += [(np.arange(d), np.full(d, -1), bits, v) for bits, v in sums.items()]
            out += [(i, j, bits, v[i, j]) for bits, v in products.items()]
            columns = [np.concatenate([o[k] for o in out]) for k in (0, 1)] + [np.concatenate([np.full(len(o[0]), o[2]) for o in out]), np.concatenate([o[3] for o in out])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "bits", "value"])

        for _, x in _blocks(batches, 0, d):
            parts = _digits(_minus(x, shift))
            for a, left in enumerate(parts):
                sums[a * DIGIT] = sums.get(a * DIGIT, 0) + left.sum(axis=0).astype(np.int64)
                for b, right in enumerate(parts):
                    at = (a + b) * DIGIT
                    products[at] = products.get(at, 0) + (left.T @ right).astype(np.int64)
            n, blocks = n + len(x), blocks + len(parts)
            if blocks >= SUMS:
                yield from told()
                n, blocks, sums, products = 0, 0, {}, {}
        if n:
            yield from told()

    return of


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, n XᵀX - SSᵀ) of the column ``x`` (d longs a row), the matrix with Python's integers.
    What comes to the driver are sums by entry of the matrix, however many rows there are."""
    sample = np.array([r["x"] for r in fit.limit(SHIFT_SAMPLE).collect()], dtype=object)
    shift = [int(sorted(sample[:, k])[len(sample) // 2]) for k in range(d)]
    parts = fit.select("x").mapInArrow(_scatter(d, shift), "i int, j int, bits int, value long")
    n, t, c = 0, [0] * d, np.zeros((d, d), dtype=object)
    for r in parts.groupBy("i", "j", "bits").agg(F.sum(F.col("value").cast("decimal(28,0)")).alias("v")).toLocalIterator():
        value = int(r["v"]) << r["bits"]
        if r["i"] < 0:
            n += value
        elif r["j"] < 0:
            t[r["i"]] += value
        else:
            c[r["i"], r["j"]] += value
            c[r["j"], r["i"]] = c[r["i"], r["j"]]
    sums = np.array(t, dtype=object)
    return n, [a + n * b for a, b in zip(t, shift)], n * c - np.outer(sums, sums)


def least_rank(m: np.ndarray, most: int) -> int:
    """The rank of a matrix of integers, or ``most`` where it is more: by elimination modulo primes,
    so no rounding decides what is a zero."""
    def modulo(p: int) -> int:
        a = np.array(m % p, dtype=np.int64)
        for rank in range(most):
            rows, columns = np.nonzero(a)
            if not len(rows):
                return rank
            pivot = a[rows[0]] * pow(int(a[rows[0], columns[0]]), -1, p) % p
            a = (a - a[:, columns[0], None] * pivot[None, :]) % p
        return most

    return max(map(modulo, PRIMES)) if len(m) else 0


@dataclass
class Whitening:
    """n vectors with sums S; components: unit vectors as columns, by falling eigenvalues; these,
    and the trace of the covariance. There are fewer components than asked for if the vectors span
    fewer dimensions."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    trace: float

    @property
    def explained(self) -> list[float]:
        return [e / self.trace for e in self.eigenvalues]


def _rotated(b: np.ndarray) -> np.ndarray:
    """Jacobi rotations that make a nearly diagonal matrix diagonal, each entry measured by its own
    row and column, so that small eigenvalues beside large ones keep their digits."""
    b, v = b.copy(), np.eye(len(b))
    for _ in range(30):
        size = np.sqrt(np.abs(np.diag(b)))
        rows, columns = np.nonzero(np.triu(np.abs(b) > 1e-15 * np.outer(size, size), 1))
        if not len(rows):
            break
        for i, j in zip(rows.tolist(), columns.tolist()):
            if abs(b[i, j]) <= 1e-15 * np.sqrt(abs(b[i, i] * b[j, j])):
                continue
            tau = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            turn = np.array([[c, t * c], [-t * c, c]])
            b[:, [i, j]] = b[:, [i, j]] @ turn
            b[[i, j], :] = turn.T @ b[[i, j], :]
            b[i, j] = b[j, i] = 0.0
            v[:, [i, j]] = v[:, [i, j]] @ turn
    return v


def _whole_units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors as integers, 2^60 to one."""
    return np.array([[int(round(x * 2.0**60)) for x in row] for row in vectors], dtype=object)


#: How far the eigenvalues that are asked for may lie apart for eigh alone to be as exact as can be.
APART = 1e6


def decomposed(n: int, sums: list[int], m: np.ndarray, most: int = COMPONENTS) -> Whitening:
    """The components of the covariance m / n², by eigh. Where the eigenvalues that are asked for
    lie far apart, eigh tells small ones only to the rounding of the large ones: then the exact
    matrix is put into the basis that eigh found, where it is all but diagonal, and rotated on.
    Eigenvalues are Rayleigh quotients of the exact matrix."""
    k = least_rank(m, min(most, len(m)))
    values, vectors = np.linalg.eigh(np.array([[x / (n * n) for x in row] for row in m], dtype=np.float64))
    values, vectors = values[::-1], vectors[:, ::-1]
    if k and values[0] > APART * max(values[k - 1], 0.0):
        u = _whole_units(vectors)
        inside = u.T @ m @ u
        vectors = vectors @ _rotated(np.array([[x / (n * n << 120) for x in row] for row in inside], dtype=np.float64))
        vectors /= np.linalg.norm(vectors, axis=0)
    else:
        vectors = vectors[:, :k]
    exact = []
    for column in _whole_units(vectors.T):
        exact.append(int(column @ m @ column) / (int(column @ column) * n * n))
    order = np.argsort(exact, kind="stable")[::-1][:k]
    return Whitening(n, sums, vectors[:, order], [exact[i] for i in order], int(np.trace(m)) / (n * n))


def _projection(model: Whitening, d: int):
    """(deviation, whitened) of batches of (key, x)."""
    scaled = model.components / np.sqrt(model.eigenvalues)
    wide = pa.decimal128(38)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, d):
            y = _minus(x, model.sums, model.n)
            most = max(abs(int(y.min())), abs(int(y.max())))
            squares = (y * y if d * most * most < 1 << 62 else y.astype(object) ** 2).sum(axis=1)
            exact = pa.array(squares).cast(wide) if squares.dtype == np.int64 else pa.array([str(s) if len(str(s)) <= 38 else None for s in squares]).cast(wide)
            white = (y / model.n).astype(np.float64) @ scaled
            ends = pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), exact, pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], names=["key", "deviation", "whitened"])

    return of


def fit_and_whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """(rows, model, identity_error): rows are (key, deviation decimal(38), whitened array<double>),
    one for each row of ``df`` with a usable vector.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are
    those of another length than most vectors have (of equally frequent lengths the longest
    counts). Keys may be null or repeated, columns of ``df`` may have any names. Repeated vectors
    count once in the fit and have a row each. Without a usable vector, and with distinct ones
    that do not differ, there are no components: no rows, model None, and an error of 0. A
    deviation of more than 38 digits is null."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).filter(usable(F.col("v"))).select("key", whole(F.col("v")).alias("x"))
    rows = materialize(rows, "whole")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out_schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if lengths is None:
        return spark.createDataFrame([], out_schema), None, 0.0
    d = lengths["d"]
    rows_of = rows.filter(F.size("x") == d)
    fit = materialize(rows_of.select("x").distinct(), "fit")
    model = decomposed(*scatter(fit, d), most)
    k = len(model.eigenvalues)
    if not k:
        return spark.createDataFrame([], out_schema), None, 0.0
    applied = fit.select(F.lit(None).cast("int").alias("key"), "x").mapInArrow(_projection(model, d), "key int, deviation decimal(38,0), whitened array<double>")
    # Spark's covariances are centred; merging keeps them so.
    entries = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j)) for i in range(k) for j in range(i, k)]
    error = max(applied.agg(*[e.alias(f"e{i}") for i, e in enumerate(entries)]).first())
    discard(fit)
    return rows_of.mapInArrow(_projection(model, d), out_schema), model, float(error)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All whitened embeddings, a row for each of the first four components."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows, model, error = fit_and_whiten(e)
    shares = model.explained if model else []
    told = rows.select("key", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return told.select(
        F.col("key").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
