"""Records of CSV files whose quoted fields hold line breaks, read in splits.

Whether a line begins within a quoted field depends on all lines before it. Each split of a file is read once for what it
does to both cases, these are composed along the file, and then every split knows how it begins. Only a record that
crosses from one split into the next is put together from their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
_close = re.compile(r'(?:[^"]|"")*"(?!")')


def within_after(line: str, within: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open after the line, if one was (`within`) or none was open before it.

    A quote opens a field only where the field begins; a doubled one is text.
    """
    if '"' not in line:
        return within
    at = 0
    while True:
        if not within and line[at : at + 1] == '"':
            within, at = True, at + 1
        if within:
            end = _close.match(line, at)
            if not end:
                return True
            within, at = False, end.end()
        at = line.find(sep, at) + 1
        if not at:
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file, start): the bytes of every line, blank ones too, its file, and where its split of it starts."""
    at = F.col("_metadata")
    return spark.read.format("text").load(path).select(F.col("value").cast("binary").alias("raw"), at["file_path"].alias("file"), at["file_block_start"].alias("start"))


def split_states(lines: DataFrame, encoding: str, sep: str) -> DataFrame:
    """(file, start, within): whether each split begins within a quoted field; a row of some 100 bytes for each split."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: dict[tuple, list[bool]] = {}
        for b in batches:
            for raw, file, start in zip(b["raw"], b["file"], b["start"]):
                own = ends.setdefault((file, start), [False, True])
                if b'"' in raw:
                    line = raw.decode(encoding, errors="ignore")
                    own[:] = [within_after(line, w, sep) for w in own] if own[0] != own[1] else [within_after(line, own[0], sep)] * 2
        yield pd.DataFrame([(f, s, *e) for (f, s), e in ends.items()], columns=["file", "start", "plain", "quoted"])

    found = lines.mapInPandas(look, "file string, start long, plain boolean, quoted boolean")
    # A split either ends one way however it began, or keeps the state, or turns it round.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = found.withColumn("turns", F.coalesce(F.sum(F.when(F.col("plain") & ~F.col("quoted"), 1).otherwise(0)).over(before), F.lit(0)) % 2)
    fixed = F.when(F.col("plain") == F.col("quoted"), F.col("plain").cast("int") + F.col("turns"))
    state = F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.lit(0)) + F.col("turns")
    return turns.select("file", "start", (state % 2 == 1).alias("within"))


def quoted_records(spark: SparkSession, path: str, encoding: str = "utf-8", sep: str = ",") -> DataFrame:
    """(file, header, record): every record that is not blank, and whether it is its file's first; line breaks within a record are line feeds."""
    lines = lines_of(spark, path)
    known = lines.join(F.broadcast(split_states(lines, encoding, sep)), ["file", "start"])  # rows of a split stay in order

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, within, kind, held = None, False, False, WHOLE, []
        out: list[tuple] = []

        def done(kind: int) -> None:
            nonlocal first, held
            text = "\n".join(held)
            if kind != WHOLE or text.strip():
                out.append((*at, first, kind, text))
                first = False
            held = []

        for b in batches:
            for raw, file, start, begun in zip(b["raw"], b["file"], b["start"], b["within"]):
                if at != (file, start):
                    if held:
                        done(MIDDLE if kind == HEAD else TAIL)
                    at, first, within, kind = (file, start), start == 0, begun, HEAD if begun else WHOLE
                line = raw.decode(encoding, errors="ignore")
                held.append(line.lstrip("﻿") if first and not held else line)
                within = within_after(line, within, sep)
                if not within:
                    done(kind)
                    kind = WHOLE
            yield pd.DataFrame(out, columns=["file", "start", "header", "kind", "text"])
            out = []
        if held:
            done(MIDDLE if kind == HEAD else TAIL)
        yield pd.DataFrame(out, columns=["file", "start", "header", "kind", "text"])

    parts = known.select("raw", "file", "start", "within").mapInPandas(cut, "file string, start long, header boolean, kind int, text string")
    whole = parts.filter(F.col("kind") == WHOLE).select("file", "header", F.col("text").alias("record"))
    torn = parts.filter(F.col("kind") != WHOLE).withColumn("of", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", "kind")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))), lambda x: x["text"]), "\n")
    return whole.unionByName(torn.groupBy("file", "of").agg(F.max("header").alias("header"), text.alias("record")).drop("of"))
