"""row_to_json text exports: lines to JSON, JSON to the clean catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Genre name -> id of the film database.
GENRE_IDS = {
    "공포": 27, "스릴러": 53, "전쟁": 10752, "액션": 28, "범죄": 80, "판타지": 14, "음악": 10402, "코미디": 35, "애니메이션": 16,
    "드라마": 18, "가족": 10751, "미스터리": 9648, "역사": 36, "로맨스": 10749, "SF": 878, "다큐멘터리": 99, "모험": 12,
}
MAX_GENRES = 4


def json_lines(lines: DataFrame, unescape_always: bool = False, repair_backslash: bool = False) -> tuple[DataFrame, DataFrame]:
    """(json and its parsed form v, rejects) of lines in column `value`; a line is parsed once.

    Blank lines and the header are skipped. Outer quotes go and doubled quotes become single ones: in quoted
    lines, or in all. `repair_backslash` doubles a backslash before a blank. Lines that are no JSON object
    are rejected with their text.
    """
    bare = F.trim(F.regexp_replace("value", "^﻿", ""))
    kept = lines.filter((bare != "") & ~F.lower(bare).startswith('"row_to_json"'))
    text = X.unwrap_json(bare, unescape_always)
    if repair_backslash:
        text = F.regexp_replace(text, r"\\ ", r"\\\\ ")
    bare_json = kept.select(F.col("value").alias("line"), text.alias("json"))
    parsed = F.when(F.startswith(F.trim("json"), F.lit("{")), F.try_parse_json("json"))
    found = F.explode(F.filter(F.array(parsed), lambda v: v.isNotNull())).alias("v")  # a filter would be pushed below and parse again
    return bare_json.select("json", found), bare_json.filter(parsed.isNull()).select("line")


def read_export(spark: SparkSession, path: str, encoding: str = "utf-8", **dialect: bool) -> tuple[DataFrame, DataFrame]:
    from .tables import decoded_lines

    lines = spark.read.text(path) if encoding.lower().replace("-", "") in ("utf8", "utf8sig") else decoded_lines(spark, path, encoding)
    return json_lines(lines, **dialect)


def _field(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "string")


def _text(path: str) -> Column:
    return F.coalesce(_field(path), F.lit(""))


def _list(path: str) -> Column:
    return F.coalesce(F.try_variant_get("v", f"$.{path}", "array<string>"), F.array().cast("array<string>"))


def _flag(path: str) -> Column:
    return F.coalesce(_field(path).try_cast("boolean"), F.lit(False))


def av_contents(rows: DataFrame) -> DataFrame:
    """Upper-cased av_type and the first four genres with their ids; an unknown genre keeps its name, its id is blank."""
    ids = F.create_map(*(F.lit(v) for k, i in GENRE_IDS.items() for v in (k, str(i))))
    genre = lambda i: F.coalesce(F.get(_list("genres"), F.lit(i)), F.lit(""))
    wide = [c for i in range(MAX_GENRES) for c in (F.coalesce(F.try_element_at(ids, genre(i)), F.lit("")).alias(f"genres.tmdb_genres.{i}.id"), genre(i).alias(f"genres.tmdb_genres.{i}.name"))]
    return rows.select(F.upper(_text("av_type")).alias("av_type"), _text("content_id").alias("content_id"), *wide, _text("release_date").alias("release_date"), _text("tmdb_id").alias("tmdb_id"))


def contents(rows: DataFrame) -> DataFrame:
    plain = [_text(c).alias(c) for c in ("content_id", "domain", "master_title", "original_title", "poster_image_url")]
    return rows.select(*plain, X.year_prefix(_field("release_date")).alias("release_year"), X.date_prefix(_field("created_at")).alias("created_at"), X.date_prefix(_field("updated_at")).alias("updated_at"), _text("synopsis").alias("synopsis"))


def game_contents(rows: DataFrame) -> DataFrame:
    plain = [_text(c).alias(c) for c in ("content_id", "developer", "publisher", "release_date")]
    return rows.select(*plain, *(_flag(f"platforms.{p}").alias(f"platform_{p}") for p in ("mac", "linux", "windows")), F.array_join(_list("genres"), "|").alias("genres_str"))


def platform_data(rows: DataFrame) -> DataFrame:
    name = F.when(_text("platform_name").startswith("TMDB"), F.lit("TMDB")).otherwise(_text("platform_name"))
    head = [_text("platform_data_id").alias("platform_data_id"), _text("content_id").alias("content_id"), name.alias("platform_name"), _text("platform_specific_id").alias("platform_specific_id"), _text("url").alias("url")]
    counts = [F.size(_list(f"attributes.{c}")).alias(f"{c}_count") for c in ("cast", "crew")]
    return rows.select(*head, X.date_prefix(_field("last_seen_at")).alias("last_seen_at"), _text("attributes.runtime").alias("runtime"), F.coalesce(_field("attributes.season_count").try_cast("double"), F.lit(0.0)).alias("season_count"), *counts, F.array_join(_list("attributes.watch_providers"), "|").alias("watch_providers_keys"))


def raw_item(rows: DataFrame) -> DataFrame:
    """Name, type and release date fall back; release_date may be a string or an object with `date`."""
    p = "source_payload"
    filled = lambda c: F.when(c != "", c)
    either = lambda *names: F.coalesce(*(filled(_field(f"{p}.{n}")) for n in names), F.lit(""))
    date = _field(f"{p}.release_date")
    dated = F.coalesce(F.when(date.startswith("{"), _field(f"{p}.release_date.date")).otherwise(date), F.lit(""))
    has_date = F.try_variant_get("v", f"$.{p}.release_date", "variant").isNotNull()  # null in JSON is there, too
    released = F.when(has_date, dated).otherwise(_text(f"{p}.first_air_date"))
    head = [_text(c).alias(c) for c in ("raw_id", "domain", "platform_name", "platform_specific_id")]
    flags = [_flag(f"{p}.platforms.{x}").alias(f"platform_{x}") for x in ("mac", "linux", "windows")]
    return rows.select(
        *head, either("name", "original_name").alias("name"), either("type", "av_type").alias("content_type"), F.array_join(_list(f"{p}.genres"), "|").alias("genres_str"), _text(f"{p}.is_free").alias("is_free"),
        *flags, released.alias("release_date"), X.date_prefix(_field("fetched_at")).alias("fetched_at"), X.date_prefix(_field("processed_at")).alias("processed_at"), _text("url").alias("url"),
    )


def webnovel_contents(rows: DataFrame) -> DataFrame:
    plain = [_text(c).alias(c) for c in ("content_id", "age_rating", "author", "publisher")]
    return rows.select(*plain, F.array_join(_list("genres"), "|").alias("genres_str"), _text("started_at").alias("started_at"))


def clean_cells(df: DataFrame) -> DataFrame:
    """Dates as yyyy-MM-dd in columns named *date or *_at; JSON in cells as canonical JSON text."""
    import re

    dated = lambda c: re.search(r"(date|_at)$", c, re.I)
    strings = {c for c, t in df.dtypes if t == "string"}
    return df.select(*((X.iso_date(F.col(f"`{c}`")) if dated(c) else X.parse_json_cell(F.col(f"`{c}`")) if c in strings else F.col(f"`{c}`")).alias(c) for c in df.columns))
