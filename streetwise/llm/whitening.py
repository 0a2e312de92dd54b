"""Operator 12: whitening of embeddings by their covariance, in two passes.

Components become integers, so the first pass is exact: Spark sums each dimension. The
second pass centres each vector by these sums, multiplies batches by NumPy's GEMM, and
merges the partitions' products by treeAggregate; LAPACK's symmetric eigh gives the
components. The projection goes to every task; a third pass of the same kind measures
the covariance of what came out.

No row leaves its partition but in sums: a matrix of dimensions squared for each, of
which few meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Integers are below this in size, so that they are exact as doubles.
LARGEST = 1 << 52
#: Vectors multiplied at once, and dimensions at most: their matrix is held by each task.
ROWS, MOST = 4096, 4096


def _integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vectors count (``size`` components, none null or not finite), and these as integers."""
    rows = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy() == size)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)  # null becomes nan
    whole = np.isfinite(values).all(axis=1)
    rows, values = rows[whole], np.floor(values[whole] * SCALE)
    if len(values) and size and np.abs(values).max() >= LARGEST:
        raise ValueError("a component is too large to be exact")
    return rows, values.astype(np.int64) + SHIFT


@dataclass
class Whitening:
    """What is fitted: count and sums of the vectors, eigenvalues and eigenvectors (columns) by number."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S over n: the difference is exact before it is rounded once."""
        if max(self.n * int(np.abs(x).max(initial=0)), *map(abs, self.sums), 0) < 1 << 62:
            return (self.n * x - np.array(self.sums, dtype=np.int64)) / self.n
        return ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sums of (n * x - S) squared."""
        n, sums = self.n, np.array(self.sums, dtype=object)
        top = max((n * int(np.abs(x[:, j]).max(initial=0)) + abs(s) for j, s in enumerate(self.sums)), default=0)
        if top < 1 << 62:
            d = n * x - sums.astype(np.int64)
            most = int(np.abs(d).max(initial=0))
            if len(sums) * most * most < 1 << 63:
                return (d * d).sum(axis=1).tolist()
            d = d.astype(object)
        else:
            d = n * x.astype(object) - sums
        return [sum(v * v for v in row) for row in d.tolist()]


def _products(rows: DataFrame, project, size: int, out: int) -> np.ndarray:
    """The sum over all rows of y y^T, y = project(x): a partition's batches by GEMM, partitions by treeAggregate."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((out, out))
        for batch in batches:
            _, x = _integers(batch["x"], size)
            for i in range(0, len(x), ROWS):
                y = project(x[i : i + ROWS])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    partial = rows.select("x").mapInArrow(products, "m binary").rdd.map(lambda r: np.frombuffer(r["m"]).reshape(out, out))
    add = lambda a, b: a + b
    return partial.treeAggregate(np.zeros((out, out)), add, add)


def _sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Count and exact sums of the vectors that count."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, dtype=object)
        for batch in batches:
            _, x = _integers(batch["x"], size)
            n += len(x)
            for i in range(0, len(x), 512):  # 512 integers of 52 bits fit a long
                total = total + x[i : i + 512].sum(axis=0).astype(object)
        values = [n, *total.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["place", "s"])

    found = {r["place"]: int(r["s"]) for r in rows.select("x").mapInArrow(summed, "place int, s decimal(38,0)").groupBy("place").agg(F.sum("s").alias("s")).collect()}  # a row for each dimension
    return found.get(-1, 0), [found.get(i, 0) for i in range(size)]


def _whole(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows of id and x (doubles), of the commonest count of components (ties: the largest), and that count."""
    vector = F.col(vector_col)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), (vector if kind in ("float", "double") else vector.cast("array<double>")).alias("x")).where("x is not null")
    commonest = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows, commonest["size"] if commonest else 0


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Two passes over rows of x, which has ``size`` components. Directions in which the vectors do not differ (an
    eigenvalue that rounding could have made) are no components."""
    if size > MOST:
        raise ValueError(f"vectors may have {MOST} components")
    n, sums = _sums(rows, size)
    out = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)
    if not n or not size:
        return out
    covariance = _products(rows, out.centred, size, size) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    held = int((values > max(values[0], 0) * size * np.finfo(float).eps).sum())
    k = min(components, held)
    vectors = vectors[:, :k]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0)[0] < 0, -1.0, 1.0) if k else vectors
    return Whitening(n, sums, values[:k].copy(), vectors, float(np.trace(covariance)))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """Returns rows of id, deviation (decimal), whitened (an array of a double for each
    component), the fit, and the identity error: the largest absolute entry of whitened's
    covariance minus the identity, measured over all rows.

    Vectors that are null or hold a component that is null or not finite are left out, and
    those of another count of components than the commonest one (ties: the larger count;
    vectors that hold such a component are counted as well).
    Components become floor(1024 * c) + 100000; one of 2 ** 52 or more raises an error.
    Rows that repeat an id, or have none, are vectors like others. Directions without any
    variance are no components, so equal vectors, or a single one, have none; an empty
    table gives no rows. A deviation of over 38 digits is null. Other columns are ignored."""
    in_small_batches(vectors.sparkSession)
    rows, size = _whole(vectors, id_col, vector_col)
    fitted = fit(rows, size, components)
    k = len(fitted.values)
    model = vectors.sparkSession.sparkContext.broadcast((fitted, fitted.vectors / np.sqrt(fitted.values)))  # at most MOST rows of ``components`` doubles

    def project(x: np.ndarray) -> np.ndarray:
        fit_, by = model.value
        return fit_.centred(x) @ by

    # The mean of whitened is that of n * x - S, which is exactly 0: it is centred as it is.
    error = float(np.abs(_products(rows, project, size, k) / fitted.n - np.eye(k)).max()) if k else 0.0

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, x = _integers(batch["x"], size)
            for i in range(0, len(x), ROWS):
                part, ids = x[i : i + ROWS], batch["id"].take(pa.array(held[i : i + ROWS]))
                deviation = pa.array([str(d) if d < 10**38 else None for d in model.value[0].deviations(part)], pa.string())
                flat = project(part).reshape(-1)
                white = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(part) + 1, k) if k else np.zeros(len(part) + 1, np.int64), pa.int32()), pa.array(flat, pa.float64()))
                yield pa.RecordBatch.from_arrays([ids, deviation, white], names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(projected, f"id {kind}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")), fitted, error


def op12_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that is no long is null."""
    found, fitted, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values]) if len(fitted.values) else F.array().cast("array<double>")
    out = found.select(F.col("id").alias("vec_id"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return out.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
