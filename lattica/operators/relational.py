"""Keyed picks, top-k, joins and set operations."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast by a checked size.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side whose checked row count is small; a plain shuffle join beyond it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed_first(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row of smallest order by key; the aggregate combines before the shuffle."""
    return _picked(df, keys, F.min_by, order)


def keyed_last(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    return _picked(df, keys, F.max_by, order)


def _picked(df: DataFrame, keys: Sequence[str], by, order: Column | str) -> DataFrame:
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(by(F.struct("*"), order).alias("__row")).select("__row.*")


def top_k(df: DataFrame, keys: Sequence[str], k: int | Column, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows by key with their rank from 1; the limit is pushed below the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def left_join_nullsafe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join in which a null key meets a null key."""
    r = right.withColumnRenamed(key, "__key")
    return left.join(r, left[key].eqNullSafe(r["__key"]), "left").drop("__key")


def union_by_name(*parts: DataFrame) -> DataFrame:
    """All rows; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def symmetrize(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every edge in both directions, from one scan of the edges."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    both = F.explode(F.array(F.struct(F.col(src).alias("s"), F.col(dst).alias("d")), F.struct(F.col(dst).alias("s"), F.col(src).alias("d"))))
    return edges.select(both.alias("e"), *rest).select(F.col("e.s").alias(src), F.col("e.d").alias(dst), *rest)


def ordered_pair_max(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """One row for each unordered pair with its largest weight."""
    return edges.groupBy(F.least(src, dst).alias(src), F.greatest(src, dst).alias(dst)).agg(F.max(weight).alias(weight))


def unpivot_genres(wide: DataFrame) -> DataFrame:
    """Wide genres to distinct (content_id, source, raw_genre), blanks left out."""
    from ..functions.columns import blank_to_null

    cols = [c for c in wide.columns if c.startswith("raw_genre_")]
    tall = wide.select("content_id", "source", F.explode(F.array(*cols)).alias("raw_genre"))
    return tall.withColumn("raw_genre", blank_to_null(F.col("raw_genre"))).filter("raw_genre is not null").distinct()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share. Only a session on one machine may do without: it gets a temporary one."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("rows between steps need a folder that all executors share: set spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def kept_rows(df: DataFrame) -> DataFrame:
    """df written once to the session's checkpoint folder, compressed, and read from it, without its lineage."""
    return kept_table(df)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs within leaves no shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def kept_table(df: DataFrame, *partition: str) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, whose parts by the columns of `partition` can be read alone; the shuffles it took are freed."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_bounds(df: DataFrame, key: str, ranges: int) -> list:
    """Ascending values of `key` that cut its distinct values into about `ranges` parts.

    They come from a bounded sample of the keys drawn by hash, so they are the same each time.
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    sample = sorted(r[0] for r in keys.orderBy(F.xxhash64(key)).limit(20 * ranges).collect())
    return sample[:: max(1, len(sample) // ranges)]


def slice_of(value: Column, bounds: list) -> Column:
    """Number of the range that the value, which is not null, falls in; one binary search a row, in Arrow batches."""
    if not bounds:
        return F.lit(0)
    listed = np.array(bounds, dtype=None if isinstance(bounds[0], int) else object)

    @F.arrow_udf("int")
    def at(values: pa.Array) -> pa.Array:
        own = values.to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(listed, own, side="right").astype(np.int32))

    return at(value)


def dense_index(df: DataFrame, key: str, out: str = "idx", buckets: int = 200) -> DataFrame:
    """0-based index of each distinct key in sorted order, without one task that sorts them all.

    The keys are dealt into ranges; each range's rows are numbered from the count before it.
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    dealt = keys.withColumn("__p", slice_of(F.col(key), range_bounds(keys, key, buckets)))
    own = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(key)))
    sizes = dealt.groupBy("__p").count()  # one row a range
    before = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__before"))
    return own.join(F.broadcast(before), "__p").select(key, (F.col("__n") + F.col("__before") - 1).alias(out))


def placed_in_group(df: DataFrame, group: str, key: str, out: str = "pos", size: str = "deg", slices: int = 200) -> DataFrame:
    """df with each row's place in its group from 1, by ascending unique key, and the group's size; a group is numbered in ranges of the key."""
    dealt = df.withColumn("__p", slice_of(F.col(key), range_bounds(df, key, slices)))
    whole = Window.partitionBy(group)
    sizes = dealt.groupBy(group, "__p").agg(F.count("*").alias("__n"))  # one row a group and range
    sizes = sizes.select(group, "__p", (F.sum("__n").over(whole.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias(size))
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy(group, "__p").orderBy(key)))
    return own.join(sizes, [group, "__p"]).withColumn(out, F.col("__own") + F.col("__before")).drop("__p", "__own", "__before")


def prefix_sums(df: DataFrame, key: str, value: str, out: str = "upto", slices: int = 200) -> DataFrame:
    """df with the sum of `value` over all rows up to its own, by ascending unique key; summed in ranges of the key, exactly as far as its type is exact."""
    dealt = df.withColumn("__p", slice_of(F.col(key), range_bounds(df, key, slices)))
    sizes = dealt.groupBy("__p").agg(F.sum(value).alias("__s"))  # one row a range
    before = sizes.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__before"))
    own = Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("__own", F.sum(value).over(own)).join(F.broadcast(before), "__p").withColumn(out, F.col("__own") + F.col("__before")).drop("__p", "__own", "__before")


def running_max_at(points: DataFrame, marks: DataFrame, by: str, value: str | Sequence[str], slices: int = 200) -> DataFrame:
    """points with the largest `value` (or each of several) of all marks whose `by` is not above theirs, null where there is none.

    Both are dealt into ranges of `by` and swept side by side; a range begins with the largest value of those before
    it. No row holds several marks and nothing is joined within a range.
    """
    values = {f"__v{n}": v for n, v in enumerate([value] if isinstance(value, str) else value)}
    bounds = range_bounds(marks, by, slices)
    rest = [c for c in points.columns if c != by]
    none = [F.lit(None).cast(marks.schema[v].dataType).alias(name) for name, v in values.items()]
    both = points.select(F.col(by).alias("__by"), F.lit(1).cast("byte").alias("__point"), *none, *rest)
    both = both.unionByName(marks.select(F.col(by).alias("__by"), F.lit(0).cast("byte").alias("__point"), *(F.col(v).alias(name) for name, v in values.items())), allowMissingColumns=True)
    both = both.withColumn("__p", slice_of(F.col("__by"), bounds))
    own = marks.groupBy(slice_of(F.col(by), bounds).alias("__p")).agg(*(F.max(v).alias(f"{name}_top") for name, v in values.items()))  # one row a range
    ranges = marks.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("__p"))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.join(own, "__p", "left").select("__p", *(F.max(f"{name}_top").over(earlier).alias(f"{name}_before") for name in values))
    swept = Window.partitionBy("__p").orderBy("__by", "__point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.select("*", *(F.max(name).over(swept).alias(f"{name}_here") for name in values)).filter("__point = 1").join(F.broadcast(before), "__p")
    return found.select(F.col("__by").alias(by), *rest, *(F.greatest(f"{name}_here", f"{name}_before").alias(v) for name, v in values.items()))


def running_share(df: DataFrame, keys: Sequence[str], order: Column, value: str, out: str = "cum") -> DataFrame:
    """Cumulative share of `value` within the keys."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(upto) / F.sum(value).over(whole))


def ordered_string_agg(df: DataFrame, keys: Sequence[str], value: str, order: str, out: str, sep: str = "|") -> DataFrame:
    """Distinct values joined in order of first appearance."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("__o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda s: s[value])
    return first.groupBy(*keys).agg(F.array_join(listed, sep).alias(out))


def is_jsonish(df: DataFrame, col: str, sample: int = 20) -> bool:
    """Whether enough of the first non-null values look like JSON; a look at `sample` rows."""
    from ..functions.text import looks_json

    row = df.filter(F.col(col).isNotNull()).limit(sample).agg(F.count("*").alias("n"), F.count_if(looks_json(F.col(col))).alias("k")).first()
    return row["k"] >= max(3, row["n"] // 4)


def row_slice(df: DataFrame, order: str, start: int, n: int) -> DataFrame:
    return df.orderBy(order).offset(start).limit(n)
