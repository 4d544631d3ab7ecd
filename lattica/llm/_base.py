"""Shared plumbing of the corpus operators: projections, shared-storage tables, size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Upper bound of rows that a size-checked broadcast may ship (about 100 bytes a row at most).
BROADCAST_ROWS = 200_000
#: At most this many keys count as hot, so the broadcast side of a hot join has a proven bound.
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Only a session on one machine may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("tables between steps need a folder that all executors share: set spark.checkpoint.dir")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage with a Parquet table in shared storage, which survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/lattica-llm/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """df, after lowering the session's rows in an Arrow batch: at the default of 10,000, long texts fill a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)
    return df


def schema_with(df: DataFrame, fields: str) -> StructType:
    """The schema of df and further fields, given as DDL."""
    return StructType(df.schema.fields + StructType.fromDDL(fields).fields)


def beside(df: DataFrame, keep: Sequence[str], inputs: Sequence[str], fn: Callable[..., tuple[np.ndarray | None, pd.DataFrame]], schema: str, rows: int = 500) -> DataFrame:
    """The columns of `keep`, untouched, beside what `fn` makes of the columns of `inputs`.

    `fn` gets a list for each input and gives a frame of the fields of `schema`, and for each of its rows the
    number of the input row that it belongs to (None: one row each, in order). Kept columns stay in Arrow, so an id
    is never a float, whatever nulls are beside it. `rows` go to `fn` at a time.
    """
    out = StructType([df.schema[c] for c in keep] + StructType.fromDDL(schema).fields)
    own = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                at, made = fn(*(b.column(len(keep) + k).to_pylist() for k in range(len(inputs))))
                kept = [b.column(k) if at is None else b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
                new = [pa.Array.from_pandas(made.iloc[:, k], type=f.type) for k, f in enumerate(own)]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=out.names)

    renamed = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), *(F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)))
    return bounded_batches(renamed).mapInArrow(run, out)


def filtered(df: DataFrame, column: str, fn: Callable[[list], np.ndarray], rows: int = 500) -> DataFrame:
    """The rows of df that `fn` keeps by their values of one column; rows stay in Arrow."""
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                yield b.filter(pa.array(fn(b.column(place).to_pylist()), pa.bool_()))

    return bounded_batches(df).mapInArrow(run, df.schema)


class BitFilter:
    """Bits of a set of 64-bit hashes: a hash of the set always passes, another one seldom.

    About 16 bits a hash, two of them set: one other hash in 70 passes. Beyond `most_bits` (2^30: 128 MB)
    more pass, which costs work and changes no result, as what passes is checked.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def bits_for(n: int, least_bits: int = 16, most_bits: int = 30) -> int:
        return min(most_bits, max(least_bits, (16 * max(1, n) - 1).bit_length()))

    @classmethod
    def of(cls, hashes: DataFrame, most_bits: int = 30) -> "BitFilter":
        """The filter of a long column h; the bits are set in Spark, at most 2^bits / 64 words come back."""
        bits = cls.bits_for(hashes.count(), most_bits=most_bits)
        h = F.col("h")
        spot = hashes.select(F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(h, 8).bitwiseAND(F.lit((1 << bits) - 1)))).alias("s"))
        found = spot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
        words = np.zeros(1 << bits - 6, np.uint64)
        for batch in found.toArrow().to_batches():
            words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
        return cls(words, bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for spot in (h >> np.uint64(64 - self.bits), (h >> np.uint64(8)) & np.uint64((1 << self.bits) - 1)):
            out &= (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """`body(value)` with value evaluated once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def in_training(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a lookup table: broadcast where its checked size allows, shuffled otherwise."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, key, how)


def skew_join(left: DataFrame, right: DataFrame, key: str, n_col: str, total: int) -> DataFrame:
    """Inner join on a unique right key where a few keys may hold a large part of left.

    `right[n_col]` is the number of left rows with the key. Keys with at least total / HOT_KEYS
    rows number HOT_KEYS at most; those are broadcast, all others are shuffled.
    """
    least = max(64, -(-total // HOT_KEYS))
    rest = [c for c in right.columns if c != key]
    hot = F.broadcast(right.filter(F.col(n_col) >= least).select(key, F.struct(*rest).alias("__hot"), F.lit(True).alias("__is_hot")))
    marked = left.join(hot, key, "left").withColumn("__is_hot", F.coalesce("__is_hot", F.lit(False)))
    often = marked.filter("__is_hot").select(key, *(c for c in left.columns if c != key), *(F.col(f"__hot.{c}").alias(c) for c in rest))
    return often.unionByName(marked.filter("not __is_hot").drop("__hot", "__is_hot").join(right.filter(F.col(n_col) < least), key))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, n_col: str, per: int = 10_000) -> DataFrame:
    """Inner join to a table with one row for each of a part of the keys, whose column n_col says how many rows of left have it.

    A key's rows are dealt by their column `by` among a place for each `per` of them (for more, where over HOT_KEYS keys
    would have several), and its row of right is sent to each; a cold key has one place.
    """
    part = max(per, -(-(right.agg(F.sum(n_col)).first()[0] or 0) // HOT_KEYS))
    places = F.ceil(F.col(n_col) / part).cast("int")
    none = right.sparkSession.range(1).select(*(F.lit(None).cast(right.schema[k].dataType).alias(k) for k in keys), F.lit(1).alias("__places"))
    hot = F.broadcast(right.filter(F.col(n_col) > part).select(*keys, places.alias("__places")).unionByName(none))  # never empty, so the plan is the same with and without hot keys
    dealt = left.join(hot, keys, "left").withColumn("__place", F.pmod(F.xxhash64(by), F.coalesce("__places", F.lit(1))).cast("int"))
    return dealt.join(right.withColumn("__place", F.explode(F.sequence(F.lit(0), places - 1))), [*keys, "__place"]).drop("__place", "__places")


def anti_join(left: DataFrame, keys: DataFrame, key: str, rows: int = 500_000) -> DataFrame:
    """The rows of left without those of `keys` (key, n: how many rows have it), whatever part of left a key holds.

    Up to `rows` digests are broadcast. Beyond that the most frequent ones are, so that they do not meet in one task.
    """
    if small_enough(keys, rows):
        return left.join(F.broadcast(keys.select(key)), key, "left_anti")
    hot = keys.orderBy(F.desc("n"), key).limit(HOT_KEYS).select(key)
    return left.join(F.broadcast(hot), key, "left_anti").join(keys.select(key), key, "left_anti")
