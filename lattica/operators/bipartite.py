"""Content nodes, raw genres and the bipartite content-meta graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from .relational import keyed_first, union_by_name, unpivot_genres

DOMAINS = ("AV", "GAME", "WEBNOVEL")
NODE_COLUMNS = ("content_id", "domain", "master_title", "original_title", "release_year", "poster_image_url", "created_at", "updated_at", "synopsis")
TALL = "content_id bigint, source string, raw_genre string"


def build_nodes(contents: DataFrame, av: DataFrame | None = None, game: DataFrame | None = None, webnovel: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Contents of the known domains, each with the columns of its own subtype table.

    Subtype columns carry the prefix of their table. A null id joins nothing. Of rows with the same id the
    first by `order` stays; without it, the first in domain order. Unknown domains go.
    """
    C.require_columns(contents, "content_id", "domain")
    base = contents.withColumn("content_id", C.to_bigint(F.col("content_id"))).filter(F.col("domain").isin(*DOMAINS))
    parts = []
    for k, (domain, own, prefix) in enumerate(zip(DOMAINS, (av, game, webnovel), ("av_", "game_", "webnovel_"))):
        rows = base.filter(F.col("domain") == domain).withColumn("__part", F.lit(k))
        if own is not None:
            right = C.prefix_columns(C.strip_headers(own), prefix, "content_id")
            rows = rows.join(right.withColumn("content_id", C.to_bigint(F.col("content_id"))), "content_id", "left")
        parts.append(rows)
    nodes = union_by_name(*parts)
    rank = F.struct("__part", *([order] if order else []), F.xxhash64(*(f"`{c}`" for c in nodes.columns if not c.startswith("__"))))
    return C.order_first(keyed_first(nodes, ["content_id"], rank).drop("__part", *([order] if order else [])), NODE_COLUMNS)


def raw_genres_tall(nodes: DataFrame, av: DataFrame | None = None, game: DataFrame | None = None, webnovel: DataFrame | None = None, game_delimiters: str = ";") -> DataFrame:
    """Distinct (content_id, source, raw_genre) of the nodes' contents from up to three sources.

    `game_delimiters`: the characters that part a game's genres; `|,/·;` also takes apart what the
    export joins with bars.
    """
    parts = []
    if av is not None:
        av = C.strip_headers(av)
        names = [c for c in av.columns if c.startswith("genres.tmdb_genres.") and c.endswith(".name")]
        if names and "content_id" in av.columns:
            parts.append(av.select("content_id", F.lit("tmdb").alias("source"), F.explode(F.array(*(F.col(f"`{c}`").cast("string") for c in names))).alias("raw_genre")))
    for df, cols, source, split in ((game, ["genres_str"], "steam", lambda c: X.split_clean(c, f"[{game_delimiters}]")), (webnovel, C.WEBNOVEL_GENRE, "webnovel", X.split_multi)):
        if df is not None:
            df = C.strip_headers(df)
            col = next((c for c in cols if c in df.columns), None)
            if col and "content_id" in df.columns:
                parts.append(df.select("content_id", F.lit(source).alias("source"), F.explode(split(F.col(col).cast("string"))).alias("raw_genre")))
    if not parts:
        return nodes.sparkSession.createDataFrame([], TALL)
    rows = union_by_name(*parts).select(C.to_bigint(F.col("content_id")).alias("content_id"), "source", C.blank_to_null(F.col("raw_genre")).alias("raw_genre"))
    known = nodes.select(C.to_bigint(F.col("content_id")).alias("content_id"))
    return rows.filter("content_id is not null and raw_genre is not null").join(known, "content_id", "left_semi").distinct()


def raw_genres_wide(tall: DataFrame, raw_item: DataFrame | None = None) -> DataFrame:
    """Up to three genres a row: the row's own in front of those of the raw item with the same id."""
    if raw_item is not None and {"raw_id", "genres_str"} <= {c.strip() for c in raw_item.columns}:
        items = C.strip_headers(raw_item).select(C.to_bigint(F.col("raw_id")).alias("content_id"), F.col("genres_str").cast("string").alias("genres_str")).filter("content_id is not null")
        tall = tall.join(items, "content_id", "left")
    else:
        tall = tall.withColumn("genres_str", F.lit(None).cast("string"))
    three = X.prepend_take(C.py_strip(F.col("raw_genre")), X.parse_genres(F.col("genres_str")))
    rows = tall.select("content_id", "source", three.alias("g"))
    return rows.select("content_id", "source", *(F.coalesce(F.get("g", F.lit(i)), F.lit("")).alias(f"raw_genre_{i + 1}") for i in range(3))).distinct()


def to_tall(genres: DataFrame) -> DataFrame:
    """Wide or tall genres as distinct tall ones; null and blank genres go."""
    if "raw_genre" in genres.columns:
        rows = genres.select("content_id", "source", C.blank_to_null(F.col("raw_genre").cast("string")).alias("raw_genre"))
        return rows.filter("raw_genre is not null").distinct()
    if not any(c.startswith("raw_genre_") for c in genres.columns):
        raise ValueError("neither raw_genre nor raw_genre_1.. is there")
    return unpivot_genres(genres)


def meta_nodes(nodes: DataFrame, tall: DataFrame | None) -> DataFrame:
    """(meta_id, meta_type, label, source) of domains and genres; labels that normalise alike keep their rows."""
    domains = nodes.filter("domain is not null").select(F.concat(F.lit("DOM:"), "domain").alias("meta_id"), F.lit("domain").alias("meta_type"), F.col("domain").alias("label"), F.lit("").alias("source"))
    if tall is None:
        return domains.distinct()
    label = C.py_strip(F.col("raw_genre"))
    genres = tall.filter(label != "").select(F.concat(F.lit("GEN:"), "source", F.lit(":"), X.norm_for_id(label)).alias("meta_id"), F.lit("genre").alias("meta_type"), label.alias("label"), "source")
    return domains.unionByName(genres).distinct()


def bipartite_edges(nodes: DataFrame, tall: DataFrame | None, domain_weight: float = 1.0, genre_weight: float = 1.0) -> DataFrame:
    """(src_content_id, dst_meta_id, edge_type, weight); a genre that normalises to nothing has no edge."""
    own = nodes.filter("content_id is not null and domain is not null")
    edges = own.select(F.col("content_id").cast("bigint").alias("src_content_id"), F.concat(F.lit("DOM:"), "domain").alias("dst_meta_id"), F.lit("content-domain").alias("edge_type"), F.lit(domain_weight).alias("weight"))
    if tall is not None:
        norm = X.norm_for_id(F.col("raw_genre"))
        edges = edges.unionByName(
            tall.filter(norm != "").select(F.col("content_id").cast("bigint").alias("src_content_id"), F.concat(F.lit("GEN:"), "source", F.lit(":"), norm).alias("dst_meta_id"), F.concat(F.lit("content-genre-"), "source").alias("edge_type"), F.lit(genre_weight).alias("weight"))
        )
    return edges.distinct()


def build_bipartite(nodes: DataFrame, genres: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    tall = to_tall(genres) if genres is not None else None
    return meta_nodes(nodes, tall), bipartite_edges(nodes, tall)
