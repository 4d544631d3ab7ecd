"""Vectors as array<double>: norms, products, means, blends, wide columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def as_vector(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """v / (|v| + 1e-12), with the norm computed once."""
    return F.transform(F.array(norm(v) + TINY), lambda n: F.transform(v, lambda x: x / n))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def blend(a: Column, b: Column, wa: float, wb: float) -> Column:
    """wa a + wb b; where one is null the other alone."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: wa * x + wb * y))


def mean_vector(df: DataFrame, keys: list[str], vector: str, dim: int | None = None, out: str = "vector") -> DataFrame:
    """Element-wise mean by key (over all rows without keys).

    With `dim`, one avg for each element: a partial aggregate of dim doubles a key, no explosion of rows.
    """
    if dim:
        means = [F.avg(F.get(F.col(vector), F.lit(i))).alias(f"__{i}") for i in range(dim)]
        found = df.groupBy(*keys).agg(*means) if keys else df.agg(*means)
        whole = F.array(*(F.col(f"__{i}") for i in range(dim)))
        return found.select(*keys, F.when(F.col("__0").isNotNull(), whole).alias(out)).filter(F.col(out).isNotNull())
    tall = df.select(*keys, F.posexplode(vector).alias("__at", "__x")).groupBy(*keys, "__at").agg(F.avg("__x").alias("__x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__x"))), lambda s: s["__x"]).alias(out)
    found = tall.groupBy(*keys).agg(listed) if keys else tall.agg(listed)
    return found.filter(F.size(out) > 0)


def vector_columns(df: DataFrame, prefix: str = "emb_") -> list[str]:
    """emb_0, emb_1, ... in numeric order, whatever their letter case."""
    found = [c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d+", c, re.I)]
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def wide_to_vector(df: DataFrame, prefix: str = "emb_", out: str = "vector") -> DataFrame:
    """Rows with a missing or non-numeric element go, as do the wide columns."""
    cols = vector_columns(df, prefix)
    if not cols:
        raise ValueError(f"no {prefix}* columns")
    typed = df.withColumn(out, F.array(*(F.col(f"`{c}`").cast("string").try_cast("double") for c in cols)))
    return typed.filter(~F.exists(out, lambda x: x.isNull())).drop(*cols)


def vector_to_wide(df: DataFrame, dim: int, vector: str = "vector", prefix: str = "emb_") -> DataFrame:
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *(F.get(F.col(vector), F.lit(i)).alias(f"{prefix}{i}") for i in range(dim)))


def tall_vector(df: DataFrame, keys: list[str], vector: str, digits: int = 6) -> DataFrame:
    """One row an element: keys, pos, val rounded."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "val")).withColumn("val", F.round("val", digits))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
