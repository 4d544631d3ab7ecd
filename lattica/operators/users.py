"""User embeddings from genre and domain centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..functions import vectors as V
from .bipartite import to_tall


def genre_rows(genres: DataFrame) -> DataFrame:
    """(content_id, genre) in lower case; a genre written in two cases counts twice for its content."""
    tall = to_tall(genres.withColumn("source", F.lit("")) if "source" not in genres.columns else genres)
    return tall.select(C.to_bigint(F.col("content_id")).alias("content_id"), F.lower("raw_genre").alias("genre"), "raw_genre").distinct().drop("raw_genre").filter("content_id is not null")


def normalized(items: DataFrame) -> DataFrame:
    return items.select("content_id", V.l2_normalize(F.col("vector")).alias("vector"))


def centroids(rows: DataFrame, key: str, dim: int, normalize: bool = True) -> DataFrame:
    """(key, vector): mean of the rows' vectors by key, of unit length."""
    found = V.mean_vector(rows, [key], "vector", dim)
    return found.withColumn("vector", V.l2_normalize(F.col("vector"))) if normalize else found


def genre_centroids(items: DataFrame, genres: DataFrame, dim: int) -> DataFrame:
    return centroids(genre_rows(genres).join(normalized(items), "content_id"), "genre", dim)


def domain_centroids(items: DataFrame, contents: DataFrame, dim: int) -> DataFrame:
    own = contents.select(C.to_bigint(F.col("content_id")).alias("content_id"), "domain").filter("content_id is not null and domain is not null")
    return centroids(own.join(normalized(items), "content_id"), "domain", dim)


def global_mean(items: DataFrame, dim: int) -> DataFrame:
    return V.mean_vector(normalized(items), [], "vector", dim).withColumn("vector", V.l2_normalize(F.col("vector")))


def user_genres(prefs: DataFrame, genres: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """(user_id, username, genre[, the column `keep`]) from any accepted column names.

    Without a genre column, the preference's content id is matched with the genre table; without a user
    id, users are numbered by name. Usernames missing or written nan or none are empty.
    """
    prefs = C.strip_headers(prefs)
    genre = C.resolve_column(prefs, C.GENRE)
    if genre is None:
        key = C.resolve_column(prefs, ("content_id", "contentid", "content id"), required=True)
        if genres is None:
            raise ValueError("preferences without a genre need the genre table")
        own = genre_rows(genres).withColumnRenamed("content_id", "__c").withColumnRenamed("genre", "__genre")
        prefs = prefs.join(own, C.to_bigint(F.col(f"`{key}`")) == F.col("__c")).drop("__c")
        genre = "__genre"
    name, user = C.resolve_column(prefs, C.USERNAME), C.resolve_column(prefs, (*C.USER_ID_GENRES, "preference_id"))
    username = C.clean_username(F.col(f"`{name}`").cast("string")) if name else F.lit("")
    rest = [keep] if keep else []
    value = F.lower(C.py_strip(F.col(f"`{genre}`").cast("string")))
    if user:
        rows = prefs.select(C.to_bigint(F.col(f"`{user}`")).alias("user_id"), username.alias("username"), value.alias("genre"), *rest)
    elif name:
        from .relational import dense_index

        named = prefs.select(username.alias("username"), value.alias("genre"), *rest).filter("username != ''")
        rows = named.join(dense_index(named, "username", "i"), "username").select((F.col("i") + 1).alias("user_id"), "username", "genre", *rest)
    else:
        raise ValueError("preferences need a user id or a username")
    return rows.filter("user_id is not null and genre is not null and genre != ''")


def user_embeddings(items: DataFrame, genres: DataFrame, prefs: DataFrame, dim: int, dedupe_genres: bool = True, order: str | None = None) -> DataFrame:
    """(user_id, username, vector): unit mean of the user's genre centroids; users without a known genre go.

    The username is that of the user's first row, by `order` or else as the rows are read.
    """
    rows = user_genres(prefs.withColumn("__at", F.col(order) if order else F.monotonically_increasing_id()), genres, keep="__at")
    names = rows.groupBy("user_id").agg(F.min_by("username", "__at").alias("username"))
    wanted = rows.select("user_id", "genre")
    wanted = wanted.distinct() if dedupe_genres else wanted
    found = V.mean_vector(wanted.join(genre_centroids(items, genres, dim), "genre"), ["user_id"], "vector", dim)
    return found.join(names, "user_id").select("user_id", "username", V.l2_normalize(F.col("vector")).alias("vector"))


def user_embeddings_blended(items: DataFrame, contents: DataFrame, genres: DataFrame | None, users: DataFrame, content_types: DataFrame | None, user_genre_prefs: DataFrame | None, dim: int, domain_weight: float = 0.6, genre_weight: float = 0.4, dedupe_genres: bool = False) -> DataFrame:
    """(user_id, username, vector): domain and genre centroids blended, the items' mean where neither is known.

    users: id, username. content_types: preference_id, content_type. user_genre_prefs: preference_id, genre.
    Repeated genres of a user weigh more unless `dedupe_genres`.
    """
    base = users.select(C.to_bigint(F.col("id")).alias("user_id"), C.clean_username(F.col("username").cast("string") if "username" in users.columns else F.lit("")).alias("username")).filter("user_id is not null")
    empty = base.sparkSession.createDataFrame([], "user_id bigint, vector array<double>")
    by_domain = by_genre = empty
    if content_types is not None:
        types = content_types.groupBy(C.to_bigint(F.col("preference_id")).alias("user_id")).agg(F.collect_set(C.py_strip(F.col("content_type"))).alias("t"))
        own = types.select("user_id", F.explode(X.ctype_domains(F.col("t"))).alias("domain"))
        by_domain = V.mean_vector(own.join(domain_centroids(items, contents, dim), "domain"), ["user_id"], "vector", dim)
    if genres is not None and user_genre_prefs is not None:
        rows = user_genre_prefs.select(C.to_bigint(F.col("preference_id")).alias("user_id"), F.lower(C.py_strip(F.col("genre"))).alias("genre"))
        rows = rows.distinct() if dedupe_genres else rows
        by_genre = V.mean_vector(rows.join(genre_centroids(items, genres, dim), "genre"), ["user_id"], "vector", dim)
    unit = lambda d, n: d.select("user_id", V.l2_normalize(F.col("vector")).alias(n))
    both = base.join(unit(by_domain, "d"), "user_id", "left").join(unit(by_genre, "g"), "user_id", "left").crossJoin(F.broadcast(global_mean(items, dim)))
    blended = F.coalesce(V.blend(F.col("d"), F.col("g"), domain_weight, genre_weight), F.col("vector"))
    return both.select("user_id", "username", V.l2_normalize(blended).alias("vector"))
