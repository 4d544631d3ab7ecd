"""Genre, date and JSON text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import py_strip

#: Content type -> domain.
CTYPE_DOMAIN = {"movie": "AV", "tv": "AV", "game": "GAME", "webnovel": "WEBNOVEL", "webtoon": "WEBNOVEL"}


def norm_for_id(x: Column) -> Column:
    """Lower case, words joined by underscores; null becomes the empty string."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[^\w\s가-힣]", " "), r"(?U)\s+")
    return F.array_join(F.filter(words, lambda w: w != ""), "_")


def split_clean(x: Column, pattern: str) -> Column:
    """Stripped non-blank parts; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), pattern), py_strip), lambda w: w != "")


def parse_genres(x: Column) -> Column:
    return split_clean(x, r"[|,/·;]")


def split_semicolon(x: Column) -> Column:
    return split_clean(x, ";")


def split_multi(x: Column) -> Column:
    return split_clean(x, r"[;|/,]")


def prepend_take(first: Column, rest: Column, k: int = 3) -> Column:
    """The first k of rest, with `first` in front where it is neither blank nor among rest."""
    put = (F.coalesce(first, F.lit("")) != "") & ~F.coalesce(F.array_contains(rest, first), F.lit(False))
    return F.slice(F.when(put, F.array_prepend(rest, first)).otherwise(rest), 1, k)


def date_prefix(x: Column) -> Column:
    return F.coalesce(F.split_part(x.cast("string"), F.lit("T"), F.lit(1)), F.lit(""))


def year_prefix(x: Column) -> Column:
    return F.coalesce(F.substring(x.cast("string"), 1, 4), F.lit(""))


def iso_date(x: Column) -> Column:
    """yyyy-MM-dd of whatever parses as a date, else null."""
    return F.date_format(F.try_to_timestamp(x.cast("string")), "yyyy-MM-dd")


def trim_value(x: Column, most: int = 200) -> Column:
    """One line of at most `most` characters, an ellipsis where it was cut."""
    line = F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"[\r\n]", " ")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def unwrap_json(x: Column, doubled: bool = True) -> Column:
    """Without outer quotes, and doubled quotes undone (where quoted, or everywhere)."""
    bare = F.trim(x)
    quoted = bare.startswith('"') & bare.endswith('"') & (F.length(bare) >= 2)
    inner = F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2))
    undone = F.replace(inner, F.lit('""'), F.lit('"'))
    return F.coalesce(undone, F.replace(bare, F.lit('""'), F.lit('"')) if doubled else bare)


def parse_json_cell(x: Column) -> Column:
    """A JSON object or array as canonical JSON text; anything else as it was."""
    bare = unwrap_json(x)
    shaped = (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))
    return F.coalesce(F.when(shaped, F.to_json(F.try_parse_json(bare))), x)


def looks_json(x: Column) -> Column:
    bare = F.trim(x)
    return (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))


def ctype_domains(types: Column) -> Column:
    """Sorted distinct domains of an array of content types."""
    known = F.create_map(*(F.lit(v) for kv in CTYPE_DOMAIN.items() for v in kv))
    found = F.transform(types, lambda t: F.try_element_at(known, F.lower(t)))
    return F.sort_array(F.array_distinct(F.filter(found, lambda d: d.isNotNull())))


def polymorphic_date(json: Column, field: str = "release_date") -> Column:
    """A field that holds a string or an object with `date`."""
    whole = F.get_json_object(json, f"$.{field}")
    return F.coalesce(F.when(whole.startswith("{"), F.get_json_object(json, f"$.{field}.date")).otherwise(whole), F.lit(""))
