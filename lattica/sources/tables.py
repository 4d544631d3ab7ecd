"""CSV, JSON and Parquet sources. Files are read by Spark alone, so any store it knows will do."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .records import quoted_records, within_after

#: Encodings tried in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin1")
COMMA = "⟐"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file, start): the bytes of every line that is not blank, its file, and where its split of it starts.

    A line feed is no part of a longer character in any of the encodings, so large files stay splittable.
    """
    at = F.col("_metadata")
    return spark.read.format("text").load(path).filter(F.trim("value") != "").select(F.col("value").cast("binary").alias("raw"), at["file_path"].alias("file"), at["file_block_start"].alias("start"))


def survey(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> tuple[str, bool]:
    """The first encoding that decodes every line strictly, and whether a quoted field may hold a line break.

    One pass over all files; a line that leaves a quoted field open says so, a bare quote within a field does not.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits, odd = [True] * len(encodings), False
        for b in batches:
            for raw in b["raw"]:
                odd = odd or within_after(raw.decode("latin1"), False)  # quotes and commas are the same bytes in all encodings
                if not raw.isascii():
                    fits = [ok and decodes(raw, e) for ok, e in zip(fits, encodings)]
        yield pd.DataFrame([[fits, odd]], columns=["fits", "odd"])

    found = raw_lines(spark, path).select("raw").mapInPandas(look, "fits array<boolean>, odd boolean")
    row = found.agg(F.max("odd").alias("odd"), *(F.min(F.get("fits", F.lit(i))).alias(f"e{i}") for i in range(len(encodings)))).first()
    if row["odd"] is None:
        return "utf-8", False
    for i, e in enumerate(encodings):
        if row[f"e{i}"]:
            return e, row["odd"]
    raise ValueError(f"{path}: no encoding fits")


def decodes(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def detect_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """The first encoding that decodes all files strictly."""
    return survey(spark, path, encodings)[0]


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, encodings: Sequence[str] = ENCODINGS, **options: Any) -> DataFrame:
    """CSV with a header in any of the encodings; all columns are strings unless a schema says otherwise.

    Quoted fields may hold line breaks; files are read in splits all the same.
    """
    encoding, broken = survey(spark, path, encodings)
    if broken:
        return read_records(spark, path, encoding, schema, options)
    if encoding in ("cp949", "euc-kr"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    java = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR", "latin1": "ISO-8859-1"}.get(encoding, encoding)
    reader = spark.read.options(header=True, encoding=java, quote='"', escape='"', **options)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read_records(spark: SparkSession, path: str, encoding: str, schema: StructType | str | None, options: dict[str, Any]) -> DataFrame:
    """The CSV table of records that line breaks in quoted fields run through."""
    found = quoted_records(spark, path, encoding, options.get("sep", ","))
    head = found.filter("header").select("record").limit(1).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = [n.strip() for n in next(csv.reader([head["record"].replace("\n", " ")], delimiter=options.get("sep", ",")))]
    kind = StructType([StructField(n, StringType()) for n in names]) if schema is None else StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = found.filter("not header").select(F.from_csv("record", ddl_of(kind), {k: str(v) for k, v in ({"quote": '"', "escape": '"'} | options).items()}).alias("r"))
    return rows.select("r.*")


def ddl_of(kind: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kind)


def read_optional(spark: SparkSession, path: str, **options: Any) -> DataFrame | None:
    """The CSV table, or None where it is missing or has no rows."""
    try:
        df = read_csv(spark, path, **options)
        return df if df.limit(1).count() else None
    except (AnalysisException, ValueError):
        return None


def read_embeddings(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Item embeddings from the first of two files that has rows."""
    for p in (path, fallback):
        if p and (df := read_optional(spark, p)) is not None:
            return df
    raise ValueError(f"no item embeddings in {path}" + (f" or {fallback}" if fallback else ""))


def from_records(spark: SparkSession, rows: list[dict] | dict | None, schema: StructType | str | None = None) -> DataFrame | None:
    """A JSON payload, one record or a list, as a table; None for nothing. Mixed value types become strings."""
    if not rows:
        return None
    rows = [rows] if isinstance(rows, dict) else rows
    if schema is not None:
        return spark.createDataFrame(rows, schema)
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return spark.createDataFrame([Row(*(text(r.get(n)) for n in names)) for r in rows], StructType.fromDDL(", ".join(f"`{n}` string" for n in names)))


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The objects of an array as `write_json_array` lays it out, in splits of the file; another layout is an error.

    JSON has no line breaks within strings, so a line with a brace at an indent of two ends an object of the array and nothing else.
    """
    values = spark.read.option("lineSep", "\n  },\n  {\n").text(path).filter(~F.col("value").rlike(r"\A\s*(\[\s*\]\s*)?\z"))
    record = F.concat(F.lit("{"), F.regexp_replace("value", r"\A\[\n  \{\n|\n  \}\n\]\n?\z", ""), F.lit("}"))
    return values.select(F.from_json(record, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def protect_commas(line: str) -> str:
    """Commas inside brackets become a placeholder; any closing bracket ends the innermost open one."""
    depth, out = 0, []
    for c in line:
        depth = depth + 1 if c in "{[(" else max(0, depth - 1) if c in "}])" else depth
        out.append(COMMA if c == "," and depth else c)
    return "".join(out)


def read_tolerant_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV whose unquoted fields may hold bracketed commas.

    A line with the header's number of fields is taken as it is; another one is parsed again with the
    commas inside brackets protected; what still does not fit is rejected with its text. Quoted fields may hold line
    breaks. Of each file the first record is the header; a later one like it is a row.
    """
    encoding, broken = survey(spark, path)
    records = quoted_records(spark, path, encoding) if broken else plain_records(spark, path, encoding)
    head = records.filter("header").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = [n.strip().strip('"') for n in head["record"].split(",")]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 31)
        for b in batches:
            rows = []
            for line in b["record"]:
                fields = next(csv.reader(io.StringIO(line)), [])
                if len(fields) != len(names):
                    fields = [f.replace(COMMA, ",") for f in next(csv.reader(io.StringIO(protect_commas(line))), [])]
                rows.append((fields if len(fields) == len(names) else None, line))
            yield pd.DataFrame(rows, columns=["fields", "line"])

    parsed = records.filter("not header").select("record").mapInPandas(split, "fields array<string>, line string")
    good = parsed.filter("fields is not null").select(*(F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return good, parsed.filter("fields is null").select("line")


def plain_records(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(record, header): every line that is not blank, and whether it is its file's first."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = set()
        for b in batches:
            first = []
            for file, start in zip(b["file"], b["start"]):
                first.append(start == 0 and file not in begun)
                begun.add(file)
            lines = [raw.decode(encoding, errors="ignore") for raw in b["raw"]]
            yield pd.DataFrame({"record": [x.lstrip("\ufeff") if f else x for x, f in zip(lines, first)], "header": first})

    return raw_lines(spark, path).mapInPandas(decode, "record string, header boolean")


def decoded_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The lines (value) of text files in an encoding that Spark's text reader does not take, blank ones left out."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": [raw.decode(encoding, errors="ignore") for raw in b["raw"]]})

    return raw_lines(spark, path).select("raw").mapInPandas(decode, "value string")


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the folder's CSV files in order."""
    return [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").orderBy("path").collect()]


def preview(df: DataFrame, n: int = 1) -> DataFrame:
    return df.limit(n)
