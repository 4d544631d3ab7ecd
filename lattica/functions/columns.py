"""Column discovery, typing and cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted names of each logical column, first match wins.
CONTENT_ID = ("content_id", "contentid", "content id", "id", "unnamed: 0")
USER_ID_EMBEDDINGS = ("user_id", "id")
USER_ID_PREFERENCES = ("user_id", "id", "preference_id")
USER_ID_GENRES = ("user_id", "userid", "user id", "id")
USERNAME = ("username", "user_name")
TITLE = ("title", "name", "content_name", "ko_title", "ko_name", "master_title")
CONTENT_NAME = ("content_name", "master_title", "original_title", "title", "name")
GENRE = ("genre", "raw_genre")
WEBNOVEL_GENRE = ("genres", "genre", "genre_str")
EDGE_SRC = ("src_content_id", "from_content_id", "source")
EDGE_DST = ("dst_content_id", "to_content_id", "target")
EDGE_WEIGHT = ("weight", "score", "similarity")


def resolve_column(df: DataFrame, candidates: Iterable[str], required: bool = False) -> str | None:
    """The first candidate among the columns, letter case and outer blanks aside."""
    own: dict[str, str] = {}
    for c in df.columns:
        own.setdefault(c.strip().lower(), c)
    found = next((own[c.lower()] for c in candidates if c.lower() in own), None)
    if found is None and required:
        raise ValueError(f"none of the columns {', '.join(candidates)} is there")
    return found


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def order_first(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The named columns that exist, then the others in their order."""
    head = [c for c in first if c in df.columns]
    return df.select(*(F.col(f"`{c}`") for c in [*head, *(c for c in df.columns if c not in head)]))


def prefix_columns(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(c if c == key else prefix + c) for c in df.columns))


def to_bigint(x: Column) -> Column:
    """Whole numbers, also written as 2.0; everything else is null, fractions too."""
    number = x.cast("string").try_cast("double")
    return F.coalesce(x.cast("string").try_cast("bigint"), F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.try_cast("bigint")))


def to_weight(x: Column) -> Column:
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(1.0))


def py_strip(x: Column) -> Column:
    """Without any Unicode white space at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.when(py_strip(x) != "", py_strip(x))


def clean_username(own: Column, preferred: Column | None = None) -> Column:
    """A missing, nan or none username gives way to the preferred one, then to the empty string."""
    real = lambda c: F.when(~F.lower(F.trim(c)).isin("nan", "none", ""), c)
    return F.coalesce(real(own), real(preferred) if preferred is not None else F.lit(None), F.lit(""))
