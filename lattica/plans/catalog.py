"""Named queries over the test tables, one for each operator, each with the SQL that gives the same rows.

`part` plays the catalogue (name, type as domain, brand as genre source), `embeddings` the item vectors with
their label as genre, `events` the users' preferences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..functions import vectors as V
from ..operators import bipartite, embed, itemgraph, recommend, relational, sampling, users, walks
from ..sources import exports, sinks, tables
from ..streaming import preferences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# -- the tables' roles, in both languages ----------------------------------------------------------

THIRD = "CASE {0} % 3 WHEN 0 THEN 'AV' WHEN 1 THEN 'GAME' ELSE 'WEBNOVEL' END"
CONTENTS = f"contents AS (SELECT p_partkey AS content_id, {THIRD.format('p_partkey')} AS domain, p_name AS master_title, p_brand AS brand, p_type AS kind FROM part)"
NODES6 = "nodes AS (SELECT p_partkey AS content_id, p_type AS domain FROM part)"
TALL = "tall AS (SELECT DISTINCT p_partkey AS content_id, p_brand AS source, unnest(string_split(p_name, ' ')) AS raw_genre FROM part)"
NORM_SQL = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\pL\pN_\s]', ' ', 'g'), '\s+'), lambda w: w <> ''), '_')"
ITEMS = f"items AS (SELECT vec_id AS content_id, CAST(embedding AS DOUBLE[]) AS vector, CAST(label AS VARCHAR) AS genre, {THIRD.format('vec_id')} AS domain FROM embeddings)"
UNIT = "unit AS (SELECT content_id, genre, domain, list_transform(vector, lambda x: x / (sqrt(list_inner_product(vector, vector)) + 1e-12)) AS vector FROM items)"
PREFS = "prefs AS (SELECT user_id, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS genre, event_id FROM events)"


def tall_mean(source: str, keys: str, name: str) -> str:
    """CTEs for the unit mean of `source.vector` by key, as arrays."""
    key = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_t AS (SELECT {key}pos, avg(x) AS x FROM (SELECT {key}unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM {source}) GROUP BY {key}pos),
{name}_v AS (SELECT {key}list(x ORDER BY pos) AS vector FROM {name}_t {by}),
{name} AS (SELECT {key}list_transform(vector, lambda x: x / (sqrt(list_inner_product(vector, vector)) + 1e-12)) AS vector FROM {name}_v)"""


def tall_out(source: str, keys: str, digits: int = 5) -> str:
    return f"SELECT {keys + ', ' if keys else ''}CAST(pos - 1 AS INTEGER) AS pos, round(val, {digits}) AS val FROM (SELECT {keys + ', ' if keys else ''}unnest(vector) AS val, generate_subscripts(vector, 1) AS pos FROM {source})"


USERS = f"""{ITEMS}, {UNIT}, {PREFS},
{tall_mean('unit', 'genre', 'cent')},
mine AS (SELECT DISTINCT user_id, genre FROM prefs),
mine_v AS (SELECT user_id, vector FROM mine JOIN cent USING (genre)),
{tall_mean('mine_v', 'user_id', 'people')}"""


def contents(s: SparkSession, d: str) -> DataFrame:
    third = F.when(F.col("p_partkey") % 3 == 0, "AV").when(F.col("p_partkey") % 3 == 1, "GAME").otherwise("WEBNOVEL")
    return t(s, d, "part").select(F.col("p_partkey").alias("content_id"), third.alias("domain"), F.col("p_name").alias("master_title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))


def nodes6(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").select(F.col("p_partkey").alias("content_id"), F.col("p_type").alias("domain"))


def tall(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").select(F.col("p_partkey").alias("content_id"), F.col("p_brand").alias("source"), F.explode(F.split("p_name", " ")).alias("raw_genre")).distinct()


def items(s: SparkSession, d: str) -> DataFrame:
    third = F.when(F.col("vec_id") % 3 == 0, "AV").when(F.col("vec_id") % 3 == 1, "GAME").otherwise("WEBNOVEL")
    return t(s, d, "embeddings").select(F.col("vec_id").alias("content_id"), V.as_vector(F.col("embedding")).alias("vector"), F.col("label").cast("string").alias("genre"), third.alias("domain"))


def item_genres(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("content_id", F.lit("label").alias("source"), F.col("genre").alias("raw_genre"))


def prefs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 10).cast("string").alias("genre"), "event_id")


def item_contents(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("content_id", "domain", F.concat(F.lit("item "), "content_id").alias("title"))


def people(s: SparkSession, d: str) -> DataFrame:
    return users.user_embeddings(items(s, d), item_genres(s, d), prefs(s, d).select("user_id", "genre"), DIM)


def graph(s: SparkSession, d: str) -> DataFrame:
    """Suppliers and the parts they shipped, weighed by quantity."""
    return t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst")).agg(F.sum("l_quantity").alias("weight"))


GRAPH = "g AS (SELECT l_suppkey AS src, l_partkey + 10000000 AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)"
ROULETTE = f"""{GRAPH}, both_ AS (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g),
shares AS (SELECT src, dst, weight, sum(weight) OVER w / sum(weight) OVER (PARTITION BY src) AS hi, row_number() OVER w AS r, count(*) OVER (PARTITION BY src) AS n FROM both_ WINDOW w AS (PARTITION BY src ORDER BY dst, weight ROWS UNBOUNDED PRECEDING)),
rou AS (SELECT src, dst, weight, coalesce(lag(hi) OVER (PARTITION BY src ORDER BY dst, weight), 0.0) AS lo, CASE WHEN r = n THEN 1.0 ELSE hi END AS hi FROM shares)"""

# -- relational ------------------------------------------------------------------------------------


@query("SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def keyed_first(s, d):
    return relational.keyed_first(t(s, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], "p_partkey")


@query("SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1")
def keyed_last(s, d):
    return relational.keyed_last(t(s, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], "p_partkey")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(s, d):
    return t(s, d, "part").select("p_brand", "p_type").distinct()


@query(
    "WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer), r AS (SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END AS k, n_name FROM nation) "
    "SELECT c_custkey, CAST(l.k AS VARCHAR) AS k, n_name FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k"
)
def left_join_nullsafe(s, d):
    left = t(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("k"))
    right = t(s, d, "nation").select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("k"), "n_name")
    return relational.left_join_nullsafe(left, right, "k").withColumn("k", F.col("k").cast("string"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def semi_filter(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def anti_filter(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def union_by_name(s, d):
    return relational.union_by_name(t(s, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS bal"), t(s, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"))


@query("SELECT DISTINCT content_id, source, trim(g) AS raw_genre FROM (SELECT p_partkey AS content_id, p_brand AS source, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type]) AS g FROM part) WHERE trim(g) <> ''")
def unpivot_wide_tall(s, d):
    wide = t(s, d, "part").select(F.col("p_partkey").alias("content_id"), F.col("p_brand").alias("source"), *(F.split_part("p_name", F.lit(" "), F.lit(i)).alias(f"raw_genre_{i}") for i in (1, 2)), F.col("p_type").alias("raw_genre_3"))
    return bipartite.to_tall(wide)


@query("SELECT c_custkey, c_name AS cust_c_name, c_mktsegment AS cust_c_mktsegment FROM customer")
def prefix_columns(s, d):
    return C.prefix_columns(t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "cust_", "c_custkey")


@query("SELECT p_brand, string_agg(p_name, '|' ORDER BY o) AS names FROM (SELECT p_brand, p_name, min(p_partkey) AS o FROM part GROUP BY ALL) GROUP BY p_brand")
def ordered_string_agg(s, d):
    return relational.ordered_string_agg(t(s, d, "part"), ["p_brand"], "p_name", "p_partkey", "names")


@query(f"WITH {PREFS} SELECT user_id, array_to_string(list_sort(list(DISTINCT genre)), '|') AS genres FROM prefs GROUP BY user_id")
def sorted_set_per_user(s, d):
    return prefs(s, d).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("genre")), "|").alias("genres"))


@query(f"WITH {PREFS} SELECT user_id, count(*) AS n, array_to_string(list(genre ORDER BY event_id), '|') AS genres FROM prefs GROUP BY user_id")
def list_per_user(s, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "genre"))), lambda x: x["genre"])
    return prefs(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(listed, "|").alias("genres"))


@query(f"WITH {CONTENTS} SELECT domain, count(*) AS n FROM contents GROUP BY domain")
def group_count_domain(s, d):
    return contents(s, d).groupBy("domain").agg(F.count("*").alias("n"))


@query(f"WITH {CONTENTS} SELECT count(DISTINCT domain) AS n_domains, count(DISTINCT brand) AS n_brands, greatest(count(*), 1) AS n_items FROM contents")
def distinct_counts(s, d):
    return contents(s, d).agg(F.countDistinct("domain").alias("n_domains"), F.countDistinct("brand").alias("n_brands"), F.greatest(F.count("*"), F.lit(1)).alias("n_items"))


@query("SELECT l_partkey AS content_id, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING max(l_shipdate) >= TIMESTAMP '1998-06-01') GROUP BY l_partkey")
def recency_filter(s, d):
    lines = t(s, d, "lineitem")
    recent = lines.groupBy("l_partkey").agg(F.max("l_shipdate").alias("m")).filter(F.col("m") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    return lines.join(recent, "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("content_id")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT o_orderkey AS content_id, CAST(o_orderdate AS VARCHAR) AS created_at FROM orders) SELECT content_id FROM r WHERE year(try_cast(created_at AS TIMESTAMP)) >= 1997")
def recent_ids(s, d):
    return recommend.recent_ids(t(s, d, "orders").select(F.col("o_orderkey").alias("content_id"), F.col("o_orderdate").cast("string").alias("created_at")), 1997)


@query(
    "WITH u AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN ' None ' WHEN 2 THEN NULL ELSE c_name END AS username, CASE WHEN c_custkey % 8 < 5 THEN c_mktsegment END AS pref FROM customer) "
    "SELECT user_id, coalesce(CASE WHEN lower(trim(username)) NOT IN ('nan', 'none', '') THEN username END, pref, '') AS username FROM u"
)
def coalesce_username(s, d):
    k = F.col("c_custkey")
    own = F.when(k % 4 == 0, "nan").when(k % 4 == 1, " None ").when(k % 4 == 3, F.col("c_name"))
    return t(s, d, "customer").select(k.alias("user_id"), C.clean_username(own, F.when(k % 8 < 5, F.col("c_mktsegment"))).alias("username"))


@query("SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT user_id FROM events)")
def dense_index(s, d):
    return relational.dense_index(t(s, d, "events"), "user_id")


@query("SELECT n_regionkey, n_nationkey, round(sum(b) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) / sum(b) OVER (PARTITION BY n_regionkey), 6) AS cum FROM (SELECT n_regionkey, n_nationkey, count(*) AS b FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)")
def running_cdf(s, d):
    n = t(s, d, "nation").join(t(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("b"))
    return relational.running_share(n, ["n_regionkey"], F.col("n_nationkey"), "b").select("n_regionkey", "n_nationkey", F.round("cum", 6).alias("cum"))


@query("SELECT least(a, b) AS src, greatest(a, b) AS dst, max(w) AS weight FROM (SELECT l_suppkey AS a, l_partkey % 100 AS b, l_quantity AS w FROM lineitem) GROUP BY ALL")
def ordered_pair_max(s, d):
    return relational.ordered_pair_max(t(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.col("l_quantity").alias("weight")))


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5")
def top_k_per_group(s, d):
    return relational.top_k(t(s, d, "events"), ["event_type"], 5, F.desc("value"), F.col("event_id")).select("event_type", "event_id", "value")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey OFFSET 20 LIMIT 10")
def row_slice(s, d):
    return relational.row_slice(t(s, d, "part").select("p_partkey", "p_name"), "p_partkey", 20, 10)


# -- scalar ------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {NORM_SQL.format('text')} AS norm FROM documents")
def norm_for_id(s, d):
    return t(s, d, "documents").select("doc_id", X.norm_for_id(F.col("text")).alias("norm"))


GENRE_TEXT = "replace(replace(p_name, ' ', ' | ') || '/' || p_brand || ';;' || p_type, '#', ',')"


@query(f"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex({GENRE_TEXT}, '[|,/·;]'), lambda x: trim(x)), lambda x: x <> ''), '+') AS genres FROM part")
def parse_genres(s, d):
    return t(s, d, "part").select("p_partkey", F.array_join(X.parse_genres(F.expr(GENRE_TEXT)), "+").alias("genres"))


@query("SELECT p_partkey, unnest(list_filter(list_transform(string_split(p_brand || ' ; ' || p_name || ';', ';'), lambda x: trim(x)), lambda x: x <> '')) AS raw_genre FROM part")
def split_explode_semicolon(s, d):
    return t(s, d, "part").select("p_partkey", F.explode(X.split_semicolon(F.expr("p_brand || ' ; ' || p_name || ';'"))).alias("raw_genre"))


@query(f"SELECT p_partkey, unnest(list_filter(list_transform(string_split_regex({GENRE_TEXT}, '[;|/,]'), lambda x: trim(x)), lambda x: x <> '')) AS raw_genre FROM part")
def split_explode_multi(s, d):
    return t(s, d, "part").select("p_partkey", F.explode(X.split_multi(F.expr(GENRE_TEXT))).alias("raw_genre"))


@query("WITH x AS (SELECT p_partkey, p_type AS f, string_split(p_name || ' ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type ELSE '' END, ' ') AS r FROM part) SELECT p_partkey, array_to_string(list_slice(CASE WHEN list_contains(r, f) THEN r ELSE list_prepend(f, r) END, 1, 3), '|') AS g FROM x")
def prepend_take3(s, d):
    rest = F.split(F.expr("p_name || ' ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type ELSE '' END"), " ")
    return t(s, d, "part").select("p_partkey", F.array_join(X.prepend_take(F.col("p_type"), rest), "|").alias("g"))


@query(f"WITH {PREFS} SELECT event_id, user_id, genre FROM prefs")
def json_props_extract(s, d):
    return prefs(s, d)


@query("SELECT o_orderkey, split_part(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'T', 1) AS day FROM orders")
def date_prefix(s, d):
    return t(s, d, "orders").select("o_orderkey", X.date_prefix(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))


@query("SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS release_year FROM orders")
def year_extract(s, d):
    return t(s, d, "orders").select("o_orderkey", X.year_prefix(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("release_year"))


RAW_ID = "CASE c_custkey % 5 WHEN 0 THEN c_custkey || '.0' WHEN 1 THEN c_custkey || '.5' WHEN 2 THEN 'x' || c_custkey WHEN 3 THEN NULL ELSE CAST(c_custkey AS {0}) END"


@query(f"WITH x AS (SELECT c_custkey, {RAW_ID.format('VARCHAR')} AS raw FROM customer) SELECT c_custkey, CASE WHEN try_cast(raw AS DOUBLE) = floor(try_cast(raw AS DOUBLE)) THEN CAST(CAST(try_cast(raw AS DOUBLE) AS BIGINT) AS VARCHAR) END AS id FROM x")
def to_bigint_coerce(s, d):
    return t(s, d, "customer").select("c_custkey", C.to_bigint(F.expr(RAW_ID.format("STRING"))).cast("string").alias("id"))


CTYPES = "CASE event_id % 6 WHEN 0 THEN 'Movie' WHEN 1 THEN 'tv' WHEN 2 THEN 'GAME' WHEN 3 THEN 'webnovel' WHEN 4 THEN 'webtoon' ELSE 'radio' END"


@query(f"WITH x AS (SELECT user_id, lower({CTYPES}) AS c FROM events), m AS (SELECT user_id, CASE WHEN c IN ('movie', 'tv') THEN 'AV' WHEN c = 'game' THEN 'GAME' WHEN c IN ('webnovel', 'webtoon') THEN 'WEBNOVEL' END AS dom FROM x) SELECT user_id, array_to_string(list_sort(list_distinct(list(dom) FILTER (dom IS NOT NULL))), '|') AS domains FROM m GROUP BY user_id")
def map_lookup_ctype(s, d):
    types = t(s, d, "events").groupBy("user_id").agg(F.collect_set(F.expr(CTYPES)).alias("t"))
    return types.select("user_id", F.array_join(X.ctype_domains(F.col("t")), "|").alias("domains"))


POLY = "CASE o_orderkey % 3 WHEN 0 THEN '{\"release_date\":\"' || o_orderpriority || '\"}' WHEN 1 THEN '{\"release_date\":{\"date\":\"' || o_orderstatus || '\"}}' ELSE '{\"release_date\":null}' END"


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE '' END AS released FROM orders")
def polymorphic_json_field(s, d):
    return t(s, d, "orders").select("o_orderkey", X.polymorphic_date(F.expr(POLY)).alias("released"))


@query("SELECT doc_id, CASE WHEN length(x) > 200 THEN substr(x, 1, 200) || '...' ELSE x END AS v FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') AS x FROM documents)")
def trim_value(s, d):
    return t(s, d, "documents").select("doc_id", X.trim_value(F.col("text")).alias("v"))


# -- vectors -----------------------------------------------------------------------------------------


@query(f"WITH {ITEMS}, {UNIT} {tall_out('unit', 'content_id')}")
def l2_normalize(s, d):
    return V.tall_vector(items(s, d).select("content_id", V.l2_normalize(F.col("vector")).alias("vector")), ["content_id"], "vector", 5)


PAIRS = f"{ITEMS}, pairs AS (SELECT a.content_id AS a, b.content_id AS b, a.vector AS u, b.vector AS v FROM items a JOIN items b ON b.content_id = a.content_id + 1)"


def item_pairs(s: SparkSession, d: str) -> DataFrame:
    x = items(s, d).select("content_id", "vector")
    return x.toDF("a", "u").join(x.toDF("b", "v"), F.col("b") == F.col("a") + 1).select("a", "b", "u", "v")


@query(f"WITH {PAIRS} SELECT a, b, round(list_inner_product(u, v), 5) AS val FROM pairs")
def dot_product(s, d):
    return item_pairs(s, d).select("a", "b", F.round(V.dot(F.col("u"), F.col("v")), 5).alias("val"))


@query(f"WITH {PAIRS} SELECT a, b, round(list_cosine_similarity(u, v), 5) AS val FROM pairs")
def cosine_pairs(s, d):
    return item_pairs(s, d).select("a", "b", F.round(V.cosine(F.col("u"), F.col("v")), 5).alias("val"))


@query(f"WITH {ITEMS}, {UNIT}, {tall_mean('unit', 'genre', 'cent')} {tall_out('cent', 'genre')}")
def genre_centroid(s, d):
    return V.tall_vector(users.genre_centroids(items(s, d), item_genres(s, d), DIM), ["genre"], "vector", 5)


@query(f"WITH {ITEMS}, {UNIT}, {tall_mean('unit', 'domain', 'cent')} {tall_out('cent', 'domain')}")
def domain_centroid(s, d):
    return V.tall_vector(users.domain_centroids(items(s, d), item_contents(s, d), DIM), ["domain"], "vector", 5)


@query(f"WITH {ITEMS}, {UNIT}, {tall_mean('unit', '', 'cent')} {tall_out('cent', '')}")
def global_mean_vector(s, d):
    return V.tall_vector(users.global_mean(items(s, d), DIM), [], "vector", 5)


@query(f"WITH {PAIRS}, bl AS (SELECT a, CASE WHEN a % 3 = 0 THEN v WHEN a % 3 = 1 THEN u ELSE list_transform(list_zip(u, v), lambda z: 0.6 * z[1] + 0.4 * z[2]) END AS vector FROM pairs) {tall_out('bl', 'a')}")
def blend_vectors(s, d):
    u, v = F.when(F.col("a") % 3 != 0, F.col("u")), F.when(F.col("a") % 3 != 1, F.col("v"))
    return V.tall_vector(item_pairs(s, d).select("a", V.blend(u, v, 0.6, 0.4).alias("vector")), ["a"], "vector", 5)


RING = "ring AS (SELECT a.content_id AS src, b.content_id AS dst FROM items a JOIN items b ON b.content_id = (a.content_id * 7 + 3) % (SELECT count(*) FROM items) WHERE a.content_id <> b.content_id)"


def ring(s: SparkSession, d: str) -> DataFrame:
    x = items(s, d).select("content_id")
    n = F.broadcast(x.agg(F.count("*").alias("n")))
    return x.toDF("src").crossJoin(n).join(x.toDF("dst"), F.col("dst") == (F.col("src") * 7 + 3) % F.col("n")).filter("src != dst").select("src", "dst")


@query(f"WITH {ITEMS}, {RING}, near AS (SELECT src, vector FROM (SELECT src, dst FROM ring UNION ALL SELECT dst, src FROM ring) JOIN items ON content_id = dst), m AS (SELECT src AS content_id, pos, avg(x) AS x FROM (SELECT src, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM near) GROUP BY src, pos) SELECT content_id, CAST(pos - 1 AS INTEGER) AS pos, round(x, 5) AS val FROM m")
def neighbor_mean_sage(s, d):
    return V.tall_vector(embed.neighbor_mean(ring(s, d), items(s, d).select("content_id", "vector"), DIM), ["content_id"], "vector", 5)


LABELLED = f"{PAIRS}, lp AS (SELECT u, v, CAST(a % 3 = 0 AS INTEGER) AS label, 1.0 + a % 4 AS weight, list_inner_product(u, v) AS dt FROM pairs), sp AS (SELECT *, greatest(dt, 0) + ln(1 + exp(-abs(dt))) AS up, greatest(-dt, 0) + ln(1 + exp(-abs(dt))) AS down FROM lp)"


def labelled_pairs(s: SparkSession, d: str) -> DataFrame:
    return item_pairs(s, d).select("u", "v", (F.col("a") % 3 == 0).cast("int").alias("label"), (1.0 + F.col("a") % 4).alias("weight"))


@query(f"WITH {LABELLED} SELECT round(sum(weight * down) FILTER (label = 1) / sum(weight) FILTER (label = 1) + avg(up) FILTER (label = 0), 5) AS loss, round(avg(list_cosine_similarity(u, v)) FILTER (label = 1), 5) AS cos_pos, round(avg(list_cosine_similarity(u, v)) FILTER (label = 0), 5) AS cos_neg FROM sp")
def bce_link_loss(s, d):
    return embed.bce_link_loss(labelled_pairs(s, d)).select(*(F.round(c, 5).alias(c) for c in ("loss", "cos_pos", "cos_neg")))


@query(f"WITH {LABELLED} SELECT round(avg(down) FILTER (label = 1) + avg(up) FILTER (label = 0), 5) AS loss FROM sp")
def sgns_loss(s, d):
    return embed.sgns_loss(labelled_pairs(s, d)).select(F.round("loss", 5).alias("loss"))


# -- graph -------------------------------------------------------------------------------------------


@query(f"WITH {CONTENTS} SELECT c.content_id, domain, master_title, CASE WHEN domain = 'AV' THEN brand END AS av_brand, CASE WHEN domain = 'GAME' THEN kind END AS game_kind, CASE WHEN domain = 'WEBNOVEL' THEN brand END AS webnovel_brand FROM contents c")
def build_nodes(s, d):
    c = contents(s, d)
    return bipartite.build_nodes(c.select("content_id", "domain", "master_title"), c.select("content_id", "brand"), c.select("content_id", "kind"), c.select("content_id", "brand"))


@query(
    f"WITH {CONTENTS} SELECT DISTINCT content_id, source, raw_genre FROM (SELECT content_id, 'tmdb' AS source, unnest([brand, split_part(master_title, ' ', 1)]) AS raw_genre FROM contents UNION ALL "
    "SELECT content_id, 'steam', unnest(string_split(master_title, ' ')) FROM contents WHERE domain <> 'AV' UNION ALL SELECT content_id, 'webnovel', unnest([kind, brand]) FROM contents WHERE domain = 'WEBNOVEL') WHERE raw_genre <> ''"
)
def raw_genres_tall(s, d):
    return bipartite.raw_genres_tall(*genre_inputs(s, d))


def genre_inputs(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    c = contents(s, d)
    av = c.select("content_id", F.col("brand").alias("genres.tmdb_genres.0.name"), F.split_part("master_title", F.lit(" "), F.lit(1)).alias("genres.tmdb_genres.1.name"))
    game = c.filter("domain != 'AV'").select("content_id", F.replace("master_title", F.lit(" "), F.lit(" ; ")).alias("genres_str"))
    web = c.filter("domain = 'WEBNOVEL'").select("content_id", F.concat_ws("|", "kind", "brand").alias("genre"))
    return c, av, game, web


@query(
    f"WITH {CONTENTS}, {TALL}, x AS (SELECT content_id, source, raw_genre AS f, string_split(master_title, ' ') || [kind] AS r FROM tall JOIN contents USING (content_id)), y AS (SELECT content_id, source, CASE WHEN list_contains(r, f) THEN r ELSE list_prepend(f, r) END AS g FROM x) "
    "SELECT DISTINCT content_id, source, coalesce(g[1], '') AS raw_genre_1, coalesce(g[2], '') AS raw_genre_2, coalesce(g[3], '') AS raw_genre_3 FROM y"
)
def raw_genres_wide(s, d):
    raw = contents(s, d).select(F.col("content_id").cast("string").alias("raw_id"), F.concat(F.replace("master_title", F.lit(" "), F.lit("|")), F.lit("/"), "kind").alias("genres_str"))
    return bipartite.raw_genres_wide(tall(s, d), raw)


@query(f"WITH {NODES6}, {TALL} SELECT DISTINCT 'DOM:' || domain AS meta_id, 'domain' AS meta_type, domain AS label, '' AS source FROM nodes UNION SELECT DISTINCT 'GEN:' || source || ':' || {NORM_SQL.format('raw_genre')}, 'genre', raw_genre, source FROM tall")
def meta_nodes(s, d):
    return bipartite.meta_nodes(nodes6(s, d), tall(s, d))


@query(f"WITH {NODES6}, {TALL} SELECT content_id AS src_content_id, 'DOM:' || domain AS dst_meta_id, 'content-domain' AS edge_type, 1.0::DOUBLE AS weight FROM nodes UNION SELECT content_id, 'GEN:' || source || ':' || {NORM_SQL.format('raw_genre')}, 'content-genre-' || source, 1.0::DOUBLE FROM tall")
def bipartite_edges(s, d):
    return bipartite.bipartite_edges(nodes6(s, d), tall(s, d))


MEMBERS = f"{NODES6}, {TALL}, mem AS (SELECT 'DOM:' || domain AS meta_id, content_id FROM nodes UNION SELECT 'GEN:' || source || ':' || raw_genre || '@' || domain, content_id FROM tall JOIN nodes USING (content_id))"
CAPPED = f"{MEMBERS}, cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meta_id ORDER BY content_id) AS pos FROM mem) WHERE pos <= 2000), deg AS (SELECT *, count(*) OVER (PARTITION BY meta_id) AS deg FROM cap)"
UNCAPPED = f"{MEMBERS}, deg AS (SELECT *, row_number() OVER (PARTITION BY meta_id ORDER BY content_id) AS pos, count(*) OVER (PARTITION BY meta_id) AS deg FROM mem)"
EDGES = f"""{CAPPED}, nn AS (SELECT count(DISTINCT content_id) AS n FROM nodes),
wp AS (SELECT a.meta_id, a.content_id AS src, b.content_id AS dst, a.deg FROM deg a JOIN deg b ON a.meta_id = b.meta_id AND b.pos > a.pos AND b.pos <= a.pos + 100),
ie AS (SELECT src, dst, sum(pow(deg, -0.7) * ln(1 + n / deg)) AS weight, min(meta_id) AS first_meta FROM wp, nn GROUP BY src, dst)"""
ALL_EDGES = UNCAPPED + EDGES.removeprefix(CAPPED)


@query(f"WITH {MEMBERS} SELECT meta_id, count(DISTINCT content_id) AS deg FROM mem GROUP BY meta_id")
def meta_degree(s, d):
    return itemgraph.membership(nodes6(s, d), tall(s, d)).groupBy("meta_id").agg(F.countDistinct("content_id").alias("deg"))


@query(f"WITH {MEMBERS}, dg AS (SELECT meta_id, least(count(*), 2000) AS deg FROM mem GROUP BY meta_id), nn AS (SELECT count(DISTINCT content_id) AS n FROM nodes) SELECT meta_id, round(CASE WHEN deg <= 1 THEN 0.0 ELSE pow(deg, -0.7) * ln(1 + n / deg) END, 6) AS c FROM dg, nn")
def meta_contrib(s, d):
    deg = itemgraph.membership(nodes6(s, d), tall(s, d)).groupBy("meta_id").agg(F.least(F.count("*"), F.lit(itemgraph.MEMBER_CAP)).alias("deg"))
    n = nodes6(s, d).agg(F.countDistinct("content_id").alias("n"))
    return deg.crossJoin(F.broadcast(n)).select("meta_id", F.round(itemgraph.contribution(F.col("deg"), F.col("n")), 6).alias("c"))


@query(f"WITH {EDGES} SELECT meta_id, src, dst, deg FROM wp")
def window_pairs(s, d):
    return itemgraph.window_pairs(itemgraph.membership(nodes6(s, d), tall(s, d)))


@query(
    """WITH own AS (SELECT o_orderstatus AS meta_id, o_orderkey AS content_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS pos FROM orders QUALIFY pos <= 2000),
sized AS (SELECT meta_id, count(*) AS deg FROM own GROUP BY meta_id)
SELECT a.meta_id AS meta_id, a.content_id AS src, deg, count(*) AS n, min(b.content_id) AS first_dst, max(b.content_id) AS last_dst FROM own a JOIN own b ON a.meta_id = b.meta_id AND b.pos > a.pos AND b.pos <= a.pos + 100 JOIN sized ON sized.meta_id = a.meta_id GROUP BY ALL"""
)
def window_pairs_capped(s, d):
    """Metas of more members than the cap keeps: orders by status."""
    members = t(s, d, "orders").select(F.col("o_orderstatus").alias("meta_id"), F.col("o_orderkey").alias("content_id"))
    return itemgraph.window_pairs(members).groupBy("meta_id", "src", "deg").agg(F.count("*").alias("n"), F.min("dst").alias("first_dst"), F.max("dst").alias("last_dst"))


@query(f"WITH {ALL_EDGES} SELECT src, dst, round(weight, 6) AS weight FROM ie")
def item_edges_unpruned(s, d):
    return itemgraph.item_edges(nodes6(s, d), tall(s, d)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH {EDGES}, ends AS (SELECT src, dst, weight, first_meta, src AS own, dst AS other FROM ie UNION ALL SELECT src, dst, weight, first_meta, dst, src FROM ie),
ranked AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY round(weight, 9) DESC, first_meta, other) AS r FROM ends)
SELECT src AS src_content_id, dst AS dst_content_id, round(max(weight), 6) AS weight FROM ranked WHERE r <= 100 GROUP BY src, dst""")
def item_edges_topk(s, d):
    return itemgraph.build_item_graph(nodes6(s, d), tall(s, d)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {GRAPH} SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g")
def symmetrize(s, d):
    return relational.symmetrize(graph(s, d))


@query(f"WITH {ROULETTE} SELECT src, dst, round(lo, 6) AS lo, round(hi, 6) AS hi FROM rou")
def roulette_table(s, d):
    return walks.roulette(graph(s, d)).select("src", "dst", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def draw(walk: str, step: int) -> str:
    h0 = f"(({walk} * 48271 + {step} * 69621 + 42) % 2147483647)"
    h1 = f"(({h0} * {h0} + 12345) % 2147483647)"
    return f"((({h1} * {h1} + 67891) % 2147483647) / 2147483647.0::DOUBLE)"


def walk_sql(length: int, p: float = 1.0, q: float = 1.0) -> str:
    """Unrolled walks of one walk a node; from the second step on with the return and in-out bias."""
    steps = [f"w1 AS (SELECT DISTINCT src AS walk_id, [src] AS path, {draw('src', 1)} AS r FROM rou)"]
    for k in range(1, length):
        at = f"w{k + 1}"
        if k == 1 or p == q == 1.0:
            steps.append(f"{at} AS (SELECT walk_id, list_append(path, dst) AS path, {draw('walk_id', k + 1)} AS r FROM w{k} JOIN rou ON src = path[-1] AND w{k}.r >= lo AND w{k}.r < hi)")
        else:
            steps.append(
                f"c{k} AS (SELECT walk_id, path, w{k}.r AS r, c.dst AS dst, c.hi AS hi, c.weight * CASE WHEN c.dst = path[-2] THEN {1 / p} WHEN n.dst IS NOT NULL THEN 1.0 ELSE {1 / q} END AS w FROM w{k} JOIN rou c ON c.src = path[-1] LEFT JOIN rou n ON n.src = path[-2] AND n.dst = c.dst), "
                f"d{k} AS (SELECT *, sum(w) OVER (PARTITION BY walk_id ORDER BY hi, dst ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY walk_id) AS tot FROM c{k}), "
                f"{at} AS (SELECT walk_id, list_append(path, arg_min(dst, hi)) AS path, {draw('walk_id', k + 1)} AS r FROM d{k} WHERE cum > r * tot GROUP BY walk_id, path)"
            )
    return f"WITH {ROULETTE}, {', '.join(steps)} SELECT walk_id, array_to_string(path, '-') AS path FROM w{length}"


def path_text(paths: DataFrame) -> DataFrame:
    return paths.select("walk_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query(walk_sql(4))
def walks_first_order(s, d):
    return path_text(walks.walks(graph(s, d), 4, 1))


@query(walk_sql(4, 0.5, 2.0))
def walks_pq(s, d):
    return path_text(walks.walks(graph(s, d), 4, 1, 0.5, 2.0))


PATHS = "ord AS (SELECT user_id, list(genre ORDER BY event_id) AS path FROM prefs GROUP BY user_id)"


def user_paths(s: SparkSession, d: str) -> DataFrame:
    """The labels of every user as a path."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "genre"))), lambda x: x["genre"].cast("bigint"))
    return prefs(s, d).groupBy("user_id").agg(listed.alias("path"))


SKIP = f"{PREFS}, {PATHS}, spot AS (SELECT user_id, CAST(unnest(path) AS BIGINT) AS tok, generate_subscripts(path, 1) AS i FROM ord), sk AS (SELECT a.tok AS center, b.tok AS context FROM spot a JOIN spot b ON a.user_id = b.user_id AND a.i <> b.i AND abs(a.i - b.i) <= 5)"


@query(f"WITH {SKIP} SELECT center, context, count(*) AS n FROM sk GROUP BY ALL")
def skipgram_pairs(s, d):
    return walks.skipgram_pairs(user_paths(s, d)).groupBy("center", "context").agg(F.count("*").alias("n"))


@query(f"WITH {SKIP}, cn AS (SELECT tok AS token, count(*) AS cnt FROM (SELECT center AS tok FROM sk UNION ALL SELECT context FROM sk) GROUP BY tok) SELECT token, cnt, round(pow(cnt, 0.75) / sum(pow(cnt, 0.75)) OVER (), 6) AS prob FROM cn")
def noise_distribution(s, d):
    return walks.noise_distribution(walks.skipgram_pairs(user_paths(s, d))).select("token", "cnt", F.round("prob", 6).alias("prob"))


@query(f"WITH {PREFS}, {PATHS} SELECT count(*) AS n_walks, round(avg(len(path)), 6) AS mean_length FROM ord")
def walk_stats(s, d):
    return walks.walk_stats(user_paths(s, d)).select("n_walks", F.round("mean_length", 6).alias("mean_length"))


@query(f"WITH {GRAPH}, q AS (SELECT DISTINCT l_partkey + 10000000 AS src, l_suppkey + l_linenumber AS dst FROM lineitem) SELECT q.src, q.dst, coalesce(g.weight, 1.0) AS weight FROM q LEFT JOIN g ON g.src = q.dst AND g.dst = q.src")
def edge_weight_lookup(s, d):
    pairs = t(s, d, "lineitem").select((F.col("l_partkey") + 10_000_000).alias("src"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("dst")).distinct()
    return embed.edge_weights(pairs, graph(s, d))


@query(f"WITH {GRAPH}, x AS (SELECT src, dst, {draw('(src % 1000003)', 0).replace('0 * 69621', '(dst % 1000003) * 69621')} AS r FROM g) SELECT src, dst, CASE WHEN r < 0.1 THEN 'test' WHEN r < 0.2 THEN 'val' ELSE 'train' END AS part FROM x")
def link_split(s, d):
    return embed.link_split(graph(s, d)).select("src", "dst", "part")


def wide(number: str, step: int) -> str:
    """The whole number of two draws."""
    whole = lambda k: draw(number, k).removesuffix(" / 2147483647.0::DOUBLE)").removeprefix("(")
    return f"({whole(2 * step)} * 2147483647 + {whole(2 * step + 1)})"


BASKETS = """spot AS (SELECT l_orderkey, l_partkey AS tok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
pairs AS (SELECT a.tok AS center, b.tok AS context, count(*) AS n FROM spot a JOIN spot b ON a.l_orderkey = b.l_orderkey AND a.i <> b.i AND abs(a.i - b.i) <= 5 GROUP BY ALL)"""
ALIAS = f"""{BASKETS}, cn AS (SELECT tok, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT center AS tok, n FROM pairs UNION ALL SELECT context, n FROM pairs) GROUP BY tok),
wt AS (SELECT tok, CAST(floor(sqrt(cnt) * sqrt(sqrt(cnt)) * 65536) AS HUGEINT) AS w, row_number() OVER (ORDER BY tok) - 1 AS slot, count(*) OVER () AS size FROM cn),
ov AS (SELECT *, sum(w) OVER () AS cap, size * w - sum(w) OVER () AS o FROM wt),
li AS (SELECT *, sum(-o) OVER (ORDER BY slot) AS lacks FROM ov WHERE o < 0),
he AS (SELECT *, sum(o) OVER (ORDER BY slot) AS gives, row_number() OVER (ORDER BY slot) - 1 AS rank FROM ov WHERE o >= 0),
hg AS (SELECT gives, max(rank) + 1 AS nxt FROM he GROUP BY gives),
ll AS (SELECT slot, tok, cap, cap + o AS keep, coalesce(nxt, 0) AS nxt FROM (SELECT *, lacks + o AS begun FROM li) ASOF LEFT JOIN hg ON begun >= gives),
en AS (SELECT DISTINCT -lacks AS e FROM li UNION SELECT 0),
hh AS (SELECT slot, tok, cap, cap + e + gives AS keep, rank + 1 AS nxt FROM he ASOF LEFT JOIN en ON -gives >= e),
alias_ AS (SELECT a.slot AS slot, a.tok AS token, a.keep AS keep, coalesce(he.tok, a.tok) AS other, a.cap AS capacity FROM (FROM ll UNION ALL FROM hh) a LEFT JOIN he ON a.nxt = he.rank)"""


def baskets(s: SparkSession, d: str) -> DataFrame:
    """The parts of each order by line."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(listed.alias("path"))


def basket_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of parts at most five lines apart in an order, counted."""
    return walks.skipgram_pairs(baskets(s, d)).groupBy("center", "context").agg(F.count("*").alias("n"))


@query(f"WITH {ALIAS} SELECT slot, token, CAST(keep AS VARCHAR) AS keep, other, CAST(capacity AS VARCHAR) AS capacity FROM alias_")
def alias_table(s, d):
    return sampling.alias_table(walks.pair_sides(baskets(s, d))).withColumn("keep", F.col("keep").cast("string")).withColumn("capacity", F.col("capacity").cast("string"))


@query(
    f"""WITH {ALIAS}, first_ AS (SELECT center, context, n * 5 AS draws, sum(n * 5) OVER (ORDER BY center, context) - n * 5 AS begun FROM pairs),
num AS (SELECT center, context, CAST(begun + unnest(range(0, draws)) AS BIGINT) AS number FROM first_),
dr AS (SELECT center, context, {wide('number', 0)} % (SELECT count(*) FROM alias_) AS slot, {wide('number', 1)} AS u FROM num)
SELECT center, context, CASE WHEN u % capacity < keep THEN token ELSE other END AS negative, count(*) AS n FROM dr JOIN alias_ USING (slot) GROUP BY ALL"""
)
def negative_samples(s, d):
    return sampling.negative_samples(basket_pairs(s, d))


@query(
    f"""WITH {GRAPH}, nd AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT src AS id FROM g UNION SELECT dst FROM g)),
co AS (SELECT src, dst, a.pos AS i, b.pos AS j, a.n AS n, row_number() OVER (ORDER BY a.pos * a.n + b.pos) - 1 AS number FROM g JOIN nd a ON a.id = src JOIN nd b ON b.id = dst),
tk AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS below FROM (SELECT i * n + j AS code FROM co UNION SELECT j * n + i FROM co UNION SELECT pos * n + pos FROM nd)),
gap AS (SELECT code - below AS g, max(below) + 1 AS skip FROM tk GROUP BY g),
dr AS (SELECT src, dst, n, k, {wide('(number * 5 + k)', 0)} % (n * n - (SELECT count(*) FROM tk)) AS r FROM co, (SELECT unnest(range(0, 5)) AS k)),
hit AS (SELECT src, dst, k, n, r + coalesce(skip, 0) AS code FROM dr ASOF LEFT JOIN gap ON r >= g)
SELECT src, dst, CAST(k AS INTEGER) AS k, a.id AS neg_src, b.id AS neg_dst FROM hit JOIN nd a ON a.pos = code // hit.n JOIN nd b ON b.pos = code % hit.n"""
)
def non_edge_samples(s, d):
    return sampling.non_edges(graph(s, d))


# -- users and recommendations -----------------------------------------------------------------------


@query(f"WITH {USERS} {tall_out('people', 'user_id', 4)}")
def user_embedding_genre(s, d):
    return V.tall_vector(people(s, d), ["user_id"], "vector", 4)


@query(
    f"""WITH {ITEMS}, {UNIT}, {PREFS}, {tall_mean('unit', 'genre', 'gc')}, {tall_mean('unit', 'domain', 'dc')}, {tall_mean('unit', '', 'gm')},
ids AS (SELECT DISTINCT user_id FROM events), ty AS (SELECT DISTINCT user_id, CASE WHEN event_id % 6 IN (0, 1) THEN 'AV' WHEN event_id % 6 = 2 THEN 'GAME' ELSE 'WEBNOVEL' END AS domain FROM events WHERE event_id % 6 < 5 AND user_id % 3 > 0),
ud_rows AS (SELECT user_id, vector FROM ty JOIN dc USING (domain)), ug_rows AS (SELECT user_id, vector FROM prefs JOIN gc USING (genre) WHERE user_id % 4 > 0),
{tall_mean('ud_rows', 'user_id', 'ud')}, {tall_mean('ug_rows', 'user_id', 'ug')},
bl AS (SELECT ids.user_id, CASE WHEN ud.vector IS NULL THEN coalesce(ug.vector, gm.vector) WHEN ug.vector IS NULL THEN ud.vector ELSE list_transform(list_zip(ud.vector, ug.vector), lambda z: 0.6 * z[1] + 0.4 * z[2]) END AS v FROM ids LEFT JOIN ud USING (user_id) LEFT JOIN ug USING (user_id), gm),
fin AS (SELECT user_id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12)) AS vector FROM bl)
{tall_out('fin', 'user_id', 4)}"""
)
def user_embedding_domain_genre(s, d):
    e = t(s, d, "events")
    base = e.select(F.col("user_id").alias("id"), F.lit("").alias("username")).distinct()
    types = e.filter("user_id % 3 > 0").select(F.col("user_id").alias("preference_id"), F.expr(CTYPES).alias("content_type"))
    own = prefs(s, d).filter("user_id % 4 > 0").select(F.col("user_id").alias("preference_id"), "genre")
    return V.tall_vector(users.user_embeddings_blended(items(s, d), item_contents(s, d), item_genres(s, d), base, types, own, DIM), ["user_id"], "vector", 4)


SIMS = f"{USERS}, sims AS (SELECT user_id, content_id, domain, round(list_inner_product(people.vector, unit.vector), 6) AS score FROM people, unit)"
TOPK = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, content_id) AS rank, content_id, score FROM sims QUALIFY rank <= 5"


@query(f"WITH {SIMS} {TOPK}")
def topk_cosine(s, d):
    return recommend.topk_cosine(people(s, d), items(s, d), 5, 6)


@query(f"WITH {SIMS}, tk AS ({TOPK}) SELECT user_id, rank, content_id, score, 'item ' || content_id AS master_title, {THIRD.format('content_id')} AS domain FROM tk")
def topk_with_meta(s, d):
    return recommend.with_meta(topk_cosine(s, d), item_contents(s, d).withColumnRenamed("title", "master_title"))


QUOTA_SQL = f"""{SIMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY score DESC, content_id) AS dr FROM sims WHERE content_id % 3 <> 2 OR content_id < 6),
picked AS (SELECT * FROM ranked WHERE dr <= 3), cnt AS (SELECT user_id, 9 - count(*) AS remain FROM picked GROUP BY user_id),
rest AS (SELECT r.user_id, content_id, domain, score, row_number() OVER (PARTITION BY r.user_id ORDER BY score DESC, content_id) AS br FROM ranked r WHERE dr > 3)"""


def quota_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Few web novels have a title, so their quota falls short."""
    titles = item_contents(s, d).withColumn("title", F.when((F.col("content_id") % 3 != 2) | (F.col("content_id") < 6), F.col("title")))
    return people(s, d), items(s, d).select("content_id", "vector"), titles


@query(f"WITH {QUOTA_SQL} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, content_id) AS rank, content_id, 'item ' || content_id AS content_title, score, domain FROM picked")
def domain_quota(s, d):
    return recommend.domain_quota(*quota_inputs(s, d), fill=False).withColumn("score", F.round("score", 6))


@query(f"WITH {QUOTA_SQL}, filled AS (SELECT user_id, content_id, domain, score FROM picked UNION ALL SELECT user_id, content_id, domain, score FROM rest JOIN cnt USING (user_id) WHERE br <= remain) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, content_id) AS rank, content_id, 'item ' || content_id AS content_title, score, domain FROM filled")
def domain_quota_backfill(s, d):
    return recommend.domain_quota(*quota_inputs(s, d)).withColumn("score", F.round("score", 6))


def genre_sql(keep: str) -> str:
    return f"""WITH {ITEMS}, {UNIT}, {PREFS}, own AS (SELECT * FROM unit WHERE {keep}), {tall_mean('own', 'genre', 'cent')}, {tall_mean('own', '', 'gm')},
mine AS (SELECT DISTINCT user_id, genre FROM prefs), known AS (SELECT user_id, vector FROM mine JOIN cent USING (genre)), {tall_mean('known', 'user_id', 'pv')},
pe AS (SELECT u.user_id, coalesce(pv.vector, gm.vector) AS vector FROM (SELECT DISTINCT user_id FROM mine) u LEFT JOIN pv USING (user_id), gm),
sims AS (SELECT user_id, content_id, round(list_inner_product(pe.vector, own.vector), 6) AS score FROM pe, own)
{TOPK}"""


def genre_inputs6(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return items(s, d).select("content_id", "vector"), item_genres(s, d), prefs(s, d).select("user_id", "genre")


@query(genre_sql("true"))
def genre_topk(s, d):
    return recommend.genre_topk(*genre_inputs6(s, d), DIM, digits=6)


@query(genre_sql("content_id % 5 > 1"))
def genre_topk_recent(s, d):
    return recommend.genre_topk(*genre_inputs6(s, d), DIM, allowed=recommend.recent_ids(dated_items(s, d)), digits=6)


def dated_items(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).select("content_id", F.when(F.col("content_id") % 5 > 1, "2021-05-06T07:08:09").when(F.col("content_id") % 5 == 1, "2019-12-31").otherwise("unknown").alias("created_at"))


def named_sql(keep: str) -> str:
    """genre_sql's rows with the first username of each user, names and the genres of each content."""
    return f"""WITH tk AS ({genre_sql(keep)}), nm AS (SELECT user_id, coalesce(arg_min('user ' || event_type, event_id), '') AS username FROM events GROUP BY user_id),
gn AS (SELECT vec_id AS content_id, string_agg(g, '|' ORDER BY g) AS genres_str FROM (SELECT vec_id, unnest([CAST(label AS VARCHAR), 'of ' || (vec_id % 7)]) AS g FROM embeddings WHERE {keep.replace('content_id', 'vec_id')}) GROUP BY vec_id)
SELECT user_id, username, rank, content_id, 'item ' || content_id AS content_name, {THIRD.format('content_id')} AS domain, genres_str, score FROM tk LEFT JOIN nm USING (user_id) LEFT JOIN gn USING (content_id)"""


def named_inputs(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """genre_inputs6 with a second genre of each item and a username in every row, and the contents."""
    own, genres, _ = genre_inputs6(s, d)
    more = items(s, d).select("content_id", F.lit("more").alias("source"), F.concat(F.lit("of "), F.col("content_id") % 7).alias("raw_genre"))
    likes = t(s, d, "events").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 10).cast("string").alias("genre"), F.concat(F.lit("user "), "event_type").alias("username"), "event_id")
    return own, genres.unionByName(more), likes, item_contents(s, d)


@query(named_sql("true"))
def genre_topk_full(s, d):
    return recommend.genre_recommendations(*named_inputs(s, d), DIM, digits=6, order="event_id")


@query(named_sql("content_id % 5 > 1"))
def genre_topk_recent_full(s, d):
    return recommend.genre_recommendations(*named_inputs(s, d), DIM, allowed=recommend.recent_ids(dated_items(s, d)), digits=6, order="event_id")


@query(f"WITH {PREFS} SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, p.user_id AS user_id, genre, count(*) AS n FROM prefs p JOIN events USING (event_id) GROUP BY ALL")
def preference_windows(s, d):
    return preferences.preference_counts(t(s, d, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "user_id", "genre", "n")


# -- exports: lines of JSON made from the tables, and what the clean tables should hold ------------------


def export(df: DataFrame, *fields: Column) -> DataFrame:
    """The rows as the lines of a row_to_json export, read back as JSON."""
    lines = df.select(F.concat(F.lit('"'), F.replace(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit('"'), F.lit('""')), F.lit('"')).alias("value"))
    return exports.json_lines(lines)[0]


KEY = "CAST(p_partkey AS VARCHAR) AS content_id"


@query(f"SELECT {KEY}, {THIRD.format('p_partkey')} AS domain, p_name AS master_title, '' AS original_title, '' AS poster_image_url, CAST(1990 + p_partkey % 30 AS VARCHAR) AS release_year, '2023-01-0' || p_partkey % 9 AS created_at, '' AS updated_at, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS synopsis FROM part")
def etl_contents(s, d):
    k = F.col("content_id")
    rows = export(contents(s, d), k, F.col("domain"), F.col("master_title"), F.concat(1990 + k % 30, F.lit("-03-04")).alias("release_date"), F.concat(F.lit("2023-01-0"), k % 9, F.lit("T10:00:00")).alias("created_at"), F.when(k % 4 != 0, F.col("kind")).alias("synopsis"))
    return exports.contents(rows)


@query(f"SELECT {KEY}, p_brand AS developer, '' AS publisher, '' AS release_date, p_partkey % 2 = 0 AS platform_mac, false AS platform_linux, p_partkey % 3 = 0 AS platform_windows, replace(p_name, ' ', '|') AS genres_str FROM part")
def etl_game(s, d):
    k = F.col("content_id")
    platforms = F.struct((k % 2 == 0).alias("mac"), F.lit(None).cast("boolean").alias("linux"), (k % 3 == 0).alias("windows"))
    return exports.game_contents(export(contents(s, d), k, F.col("brand").alias("developer"), platforms.alias("platforms"), F.split("master_title", " ").alias("genres")))


@query(
    f"SELECT CAST(p_partkey + 7 AS VARCHAR) AS platform_data_id, {KEY}, CASE WHEN p_partkey % 2 = 0 THEN 'TMDB' ELSE 'STEAM' END AS platform_name, '' AS platform_specific_id, 'http://x/' || p_partkey AS url, '' AS last_seen_at, CAST(p_partkey % 200 AS VARCHAR) AS runtime, "
    "CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_partkey % 5 END::DOUBLE AS season_count, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS cast_count, 0 AS crew_count, p_brand || '|' || p_type AS watch_providers_keys FROM part"
)
def etl_platform_data(s, d):
    k = F.col("content_id")
    own = F.struct((k % 200).alias("runtime"), F.when(k % 5 != 0, k % 5).alias("season_count"), F.split("master_title", " ").alias("cast"), F.array("brand", "kind").alias("watch_providers"))
    return exports.platform_data(export(contents(s, d), (k + 7).alias("platform_data_id"), k, F.when(k % 2 == 0, "TMDB_TV").otherwise("STEAM").alias("platform_name"), F.concat(F.lit("http://x/"), k).alias("url"), own.alias("attributes")))


@query(
    f"SELECT CAST(p_partkey AS VARCHAR) AS raw_id, {THIRD.format('p_partkey')} AS domain, '' AS platform_name, '' AS platform_specific_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS name, 'tv' AS content_type, p_brand || '|' || p_type AS genres_str, CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END AS is_free, "
    "false AS platform_mac, p_partkey % 3 = 1 AS platform_linux, false AS platform_windows, CASE p_partkey % 3 WHEN 0 THEN '2001-02-03' WHEN 1 THEN '2004-05-06' ELSE '' END AS release_date, '2023-05-06' AS fetched_at, '' AS processed_at, '' AS url FROM part"
)
def etl_raw_item(s, d):
    k = F.col("content_id")
    released = F.when(k % 3 == 0, F.lit('"2001-02-03"')).when(k % 3 == 1, F.lit('{"date":"2004-05-06"}')).otherwise(F.lit("null"))
    rest = F.to_json(F.struct(F.when(k % 2 == 0, F.col("master_title")).otherwise("").alias("name"), F.col("kind").alias("original_name"), F.lit("tv").alias("av_type"), F.array("brand", "kind").alias("genres"), (k % 3 == 0).alias("is_free"), F.struct((k % 3 == 1).alias("linux")).alias("platforms")))
    payload = F.concat(F.lit('{"release_date":'), released, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    head = F.to_json(F.struct(k.alias("raw_id"), "domain", F.lit("2023-05-06T07:08:09").alias("fetched_at")))
    lines = contents(s, d).select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"source_payload":'), payload, F.lit("}")).alias("value"))
    return exports.raw_item(exports.json_lines(lines)[0])


@query(
    f"SELECT upper(p_type) AS av_type, {KEY}, '28' AS \"genres.tmdb_genres.0.id\", '액션' AS \"genres.tmdb_genres.0.name\", '' AS \"genres.tmdb_genres.1.id\", p_brand AS \"genres.tmdb_genres.1.name\", CASE WHEN p_partkey % 2 = 0 THEN '18' ELSE '' END AS \"genres.tmdb_genres.2.id\", CASE WHEN p_partkey % 2 = 0 THEN '드라마' ELSE '' END AS \"genres.tmdb_genres.2.name\", "
    "'' AS \"genres.tmdb_genres.3.id\", '' AS \"genres.tmdb_genres.3.name\", '' AS release_date, CAST(p_partkey * 2 AS VARCHAR) AS tmdb_id FROM part"
)
def etl_av(s, d):
    k = F.col("content_id")
    genres = F.array_compact(F.array(F.lit("액션"), F.col("brand"), F.when(k % 2 == 0, F.lit("드라마"))))
    return exports.av_contents(export(contents(s, d), k, F.col("kind").alias("av_type"), genres.alias("genres"), (k * 2).alias("tmdb_id")))


@query(f"SELECT {KEY}, '' AS age_rating, p_brand AS author, p_type AS publisher, replace(p_name, ' ', '|') AS genres_str, '2020-01-0' || p_partkey % 9 AS started_at FROM part")
def etl_webnovel(s, d):
    k = F.col("content_id")
    return exports.webnovel_contents(export(contents(s, d), k, F.col("brand").alias("author"), F.col("kind").alias("publisher"), F.split("master_title", " ").alias("genres"), F.concat(F.lit("2020-01-0"), k % 9).alias("started_at")))


@query("SELECT 2 AS dialect, CAST(p_partkey AS VARCHAR) AS content_id, p_name AS name FROM part UNION ALL SELECT 3, CAST(p_partkey AS VARCHAR), chr(92) || ' ' || p_name FROM part")
def etl_dialects(s, d):
    """Doubled quotes in lines without outer ones; a backslash before a blank."""
    k, name = F.col("content_id").cast("string"), F.col("master_title")
    doubled = F.concat(F.lit('{""content_id"": '), k, F.lit(', ""name"": ""'), name, F.lit('""}'))
    slashed = F.concat(F.lit('{"content_id": '), k, F.lit(', "name": "\\ '), name, F.lit('"}'))
    own = lambda line, n, **dialect: exports.json_lines(contents(s, d).select(line.alias("value")), **dialect)[0].select(F.lit(n).alias("dialect"), exports._text("content_id").alias("content_id"), exports._text("name").alias("name"))
    return own(doubled, 2, unescape_always=True).unionByName(own(slashed, 3, repair_backslash=True))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN '{\"a\":' || o_orderkey || '}' ELSE o_orderstatus END AS payload FROM orders")
def etl_clean_cells(s, d):
    k = F.col("o_orderkey")
    cell = F.when(k % 2 == 0, F.concat(F.lit('"{""a"": '), k, F.lit('}"'))).otherwise(F.col("o_orderstatus"))
    when = F.when(k % 3 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return exports.clean_cells(t(s, d, "orders").select(k.cast("string").alias("id"), when.alias("created_at"), cell.alias("payload")))


@query(f"WITH {SIMS}, tk AS ({TOPK}) SELECT user_id, string_agg(rank || '. item ' || content_id || ' (' || CAST(round(score, 4) AS VARCHAR) || ')', '; ' ORDER BY rank) AS summary FROM tk GROUP BY user_id")
def user_summary(s, d):
    return sinks.user_summary(topk_with_meta(s, d))


# -- files written from the tables and read back ------------------------------------------------------------


def new_path(s: SparkSession, name: str) -> str:
    return f"{relational.shared_dir(s)}/files/{uuid.uuid4().hex}/{name}"


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, replace(p_name, ' ', chr(10)) || CASE WHEN p_partkey % 3 = 0 THEN ' 5\", \"so\"' ELSE '' END AS note, p_brand AS brand FROM part")
def quoted_breaks_csv(s, d):
    """Line breaks, quotes and commas within quoted fields, read in splits."""
    k, path = F.col("p_partkey"), new_path(s, "notes")
    note = F.concat(F.replace("p_name", F.lit(" "), F.lit("\n")), F.when(k % 3 == 0, ' 5", "so"').otherwise(""))
    sinks.write_csv(t(s, d, "part").select(k.alias("id"), note.alias("note"), F.col("p_brand").alias("brand")), path)
    return tables.read_csv(s, path)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus || ', \"' || o_orderpriority || '\"' AS note, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS customer FROM orders")
def single_csv(s, d):
    """One file with a byte order mark."""
    path = new_path(s, "orders.csv")
    note = F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('"'))
    sinks.write_single_csv(t(s, d, "orders").select(F.col("o_orderkey").alias("id"), note.alias("note"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("customer")), path, "id")
    return tables.read_csv(s, path)


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag || '\"' || chr(10) || l_linestatus AS note, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR) END AS part FROM lineitem")
def json_array_file(s, d):
    """One file with an indented array of all lines."""
    path = new_path(s, "lines.json")
    note = F.concat("l_returnflag", F.lit('"\n'), "l_linestatus")
    sinks.write_json_array(t(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), note.alias("note"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey").cast("string")).alias("part")), path, "id")
    return tables.read_json_array(s, path, "id long, line int, note string, part string")


# -- learned stages: rows only -----------------------------------------------------------------------


@query()
def item_embeddings_sgns(s, d):
    return embed.item_embeddings(graph(s, d))


@query()
def item_embeddings_word2vec(s, d):
    return embed.word2vec(walks.walks(graph(s, d)))


@query()
def item_embeddings_graphsage(s, d):
    return embed.train_graphsage(itemgraph.build_item_graph(nodes6(s, d), tall(s, d), cap=None))
