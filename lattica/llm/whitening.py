"""Embedding whitening by upper-triangle column aggregates.

One aggregation has a generated Spark SQL expression for every pair of dimensions, the sum of the products of both,
centred first. Its sums are assembled into the covariance, which LAPACK decomposes; rows are then projected in tasks.
The driver sees sums of dimensions and of pairs of dimensions only, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base as B

SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues below this part of the largest are noise of the arithmetic: their components do not exist.
LEAST_EIGENVALUE = 1e-12


def finite(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its entries are numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def as_columns(df: DataFrame, vector: str, dims: int) -> list[Column]:
    return [F.col(vector)[k].alias(f"c{k}") for k in range(dims)]


@dataclass
class Moments:
    """Count, mean and covariance (divisor n) of the columns c0, c1, ... of a table."""

    n: int
    sums: list
    covariance: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s) / self.n) for s in self.sums])


def centred(sums: list, n: int) -> list[Column]:
    """Each column less its mean. Whole sums are split into the mean's whole part and the rest, so no digit is lost."""
    out = []
    for k, s in enumerate(sums):
        whole = Fraction(s) // n
        rest = float(Fraction(s) / n - whole)
        out.append(F.coalesce((F.col(f"c{k}") - F.lit(int(whole))).cast("double") - F.lit(rest), F.lit(0.0)).alias(f"c{k}"))  # never null: sums of what cannot be null are cheaper
    return out


def upper_triangle(dims: int) -> list[str]:
    """A SQL expression for each pair i <= j of dimensions, row by row."""
    return [f"sum(c{i} * c{j}) AS p{i}_{j}" for i in range(dims) for j in range(i, dims)]


def moments(columns: DataFrame, dims: int, exact: bool) -> Moments | None:
    """Sums first (whole numbers exactly), then one aggregation of the products of the centred columns; None without rows."""
    total = lambda k: F.sum(F.col(f"c{k}").cast("decimal(38,0)") if exact else F.col(f"c{k}"))
    first = columns.agg(F.count("*"), *(total(k) for k in range(dims))).first()
    n, sums = first[0], [Fraction(int(s) if exact else float(s)) for s in first[1:]] if first[0] else []
    if not n:
        return None
    row = columns.select(*(centred(sums, n) if exact else [F.coalesce(F.col(f"c{k}") - F.lit(float(s / n)), F.lit(0.0)).alias(f"c{k}") for k, s in enumerate(sums)])).selectExpr(*upper_triangle(dims)).first()
    cov = np.zeros((dims, dims))
    cov[np.triu_indices(dims)] = np.array(row, float) / n
    return Moments(n, sums, cov + np.triu(cov, 1).T)


@dataclass
class Whitening:
    """Mean, unit components (rows, by falling eigenvalue), their eigenvalues, and the trace of the covariance."""

    moments: Moments
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def decompose(m: Moments, most: int) -> Whitening:
    """The first `most` components by LAPACK; each points so that its largest entry (the first of several) is positive."""
    values, vectors = np.linalg.eigh(m.covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, rows = values[order], vectors.T[order]
    real = values > LEAST_EIGENVALUE * max(values[0], 0.0)
    values, rows = values[real], rows[real]
    sign = np.sign(np.take_along_axis(rows, np.abs(rows).argmax(axis=1)[:, None], axis=1))
    return Whitening(m, rows * sign, values, float(np.trace(m.covariance)))


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x (whole numbers floor(SCALE * c) + SHIFT) of every row without a null or non-finite entry."""
    v = F.col(f"`{vector_col}`")
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))
    return vectors.filter(finite(v)).select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))


def common_length(x: DataFrame) -> int:
    """The length that most vectors have, of several the largest; 0 without vectors."""
    found = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def fit(x: DataFrame, dims: int, most: int = 32) -> Whitening | None:
    """The whitening of a table with arrays x of `dims` whole numbers; None without rows."""
    m = moments(x.select(*as_columns(x, "x", dims)), dims, exact=True)
    return decompose(m, most) if m else None


def project(x: DataFrame, model: Whitening) -> DataFrame:
    """The rows of x with `w`: x less the mean, projected on every component, over the root of its eigenvalue."""
    m = model.moments
    whole = np.array([int(s // m.n) for s in m.sums], np.int64)
    rest = np.array([float(s / m.n - s // m.n) for s in m.sums])
    turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
    place, dims, out = x.columns.index("x"), len(whole), B.schema_with(x, "w array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(place).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            w = ((flat - whole).astype(np.float64) - rest) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=out.names)

    return B.bounded_batches(x).mapInArrow(run, out)


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of w less the identity, measured over all rows."""
    m = moments(whitened.select(*as_columns(whitened, "w", k)), k, exact=False)
    return float(np.abs(m.covariance - np.eye(k)).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component up to `most`.

    Vectors that are null or empty or hold a null or non-finite entry are left out; so are vectors of another length
    than most have, as one covariance has one length. Repeated rows count as often as they stand and null ids as any
    other; other columns are ignored. Components whose eigenvalue is nothing but rounding do not exist, so equal
    vectors, one vector, and an empty table give no rows. Equal eigenvalues leave their components' choice to LAPACK.
    `deviation` is exact; entries or deviations that no long can hold are an error.
    """
    x = quantised(vectors, id_col, vector_col)
    x = B.materialize(x, "quantised")
    dims = common_length(x)
    own = x.filter(F.size("x") == dims)
    model = fit(own, dims, most) if dims else None
    if model is None or not len(model.eigenvalues):
        empty = x.filter(F.lit(False)).select(F.col("id").alias(id_col))
        return empty.select(id_col, *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in SCHEMA.split(", ")))
    m = model.moments
    # (n*x - S) = n * (x - floor(S/n)) - (S mod n): small numbers whose squares add up in a long wherever the result does
    parts = [F.lit(m.n) * (F.col("x")[k] - F.lit(int(s // m.n))) - F.lit(int(s % m.n)) for k, s in enumerate(m.sums)]
    squares = F.aggregate(F.array(*parts), F.lit(0).cast("long"), lambda a, d: a + d * d)
    whitened = B.materialize(project(own.withColumn("deviation", squares), model).drop("x"), "whitened")
    error = identity_error(whitened, len(model.eigenvalues))
    rows = whitened.select(F.col("id").alias(id_col), "deviation", F.posexplode("w").alias("at", "whitened"))
    part = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
    return rows.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", part[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
