"""Writers: Parquet by default, CSV and JSON for exchange, records and profiles for reading."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_value


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", mode: str = "overwrite") -> None:
    """CSV with a header, any Java charset; Spark writes no byte order mark."""
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    df.write.mode(mode).options(header=True, encoding=encoding, quote='"', escape='"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv_lines(rows: list[tuple], names: list[str]) -> list[str]:
    """Each row as a line of CSV: quotes where they are needed, nothing for null."""
    out = []
    for r in rows:
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerow(["" if v is None else v for v in r])
        out.append(text.getvalue()[:-1])
    return out


def json_texts(rows: list[tuple], names: list[str]) -> list[str]:
    """Each row as an indented JSON object within an array."""
    return ["  " + json.dumps(dict(zip(names, r)), indent=2, ensure_ascii=False, default=str).replace("\n", "\n  ") for r in rows]


def write_single_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """One UTF-8 CSV file with a byte order mark and a header, of any size; rows in order of `order`."""
    head = "\ufeff" + csv_lines([tuple(df.columns)], [])[0] + "\n"
    write_single(df, path, csv_lines, head, "\n", "\n", order)


def write_json_array(df: DataFrame, path: str, order: str | None = None) -> None:
    """One file with an indented JSON array of all rows, of any size; rows in order of `order`."""
    write_single(df, path, json_texts, "[\n", ",\n", "\n]", order)


def write_single(df: DataFrame, path: str, texts: Callable[[list[tuple], list[str]], list[str]], head: str, between: str, end: str, order: str | None) -> None:
    """One file: head, the rows' texts with `between` two of them, and end (without rows: the head and the end, less a line break).

    Tasks make the texts of ranges of `order`, and Spark commits them as parts beside the target; the driver then streams
    one after the other into a new file, which takes the target's place at last. So the target is there whole or as
    it was, whatever fails, and the driver holds no row.
    """
    spark, names = df.sparkSession, df.columns

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(texts(list(zip(*(c.to_pylist() for c in b.columns))), names), pa.string())], names=["value"])

    rows = df.repartitionByRange(F.col(f"`{order}`")).sortWithinPartitions(f"`{order}`") if order else df
    beside = f"{path}.{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    parts, whole, target = (hadoop.fs.Path(p) for p in (f"{beside}.parts", f"{beside}.whole", path))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        rows.mapInArrow(lines, "value string").write.option("lineSep", between).text(parts.toString())
        own = sorted((s for s in files.listStatus(parts) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
        out = files.create(whole)
        try:
            out.write(bytearray((head if own or end == "\n" else head.rstrip("\n")).encode()))
            for k, part in enumerate(own):
                source = files.open(part.getPath())
                spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, part.getLen() - (len(between) if k == len(own) - 1 else 0))
                source.close()
            out.write(bytearray((end if own else end.lstrip("\n")).encode()))
        finally:
            out.close()
        files.delete(target, True)
        if not files.rename(whole, target):
            raise OSError(f"{beside}.whole could not become {path}")
    finally:
        files.delete(parts, True)
        files.delete(whole, True)


def json_array(df: DataFrame, most: int = 100_000) -> str:
    """An indented JSON array of a table of checked size."""
    return json.dumps(records(df, most), indent=2, ensure_ascii=False, default=str)


def records(df: DataFrame, most: int = 100_000) -> list[dict]:
    """The rows as dicts; a table beyond `most` rows is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them instead")
    return [r.asDict(recursive=True) for r in rows]


def profile(df: DataFrame, n: int = 5, width: int = 200) -> str:
    """Column names and a few rows as `name=value | ...`."""
    rows = df.select(*(trim_value(F.col(f"`{c}`"), width).alias(c) for c in df.columns)).limit(n).collect()
    return "\n".join([", ".join(df.columns), *(" | ".join(f"{c}={r[c]}" for c in df.columns) for r in rows)])


def user_summary(recs: DataFrame) -> DataFrame:
    """One line of text for each user: rank, title and score in order."""
    title = next(c for c in ("content_title", "master_title", "content_id") if c in recs.columns)
    line = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(title).cast("string").alias("t"), F.round("score", 4).cast("string").alias("s")))), lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["t"], F.lit(" ("), x["s"], F.lit(")")))
    return recs.groupBy("user_id").agg(F.array_join(line, "; ").alias("summary"))
